"""Hierarchical packing of token sequences into windows of several lengths.

Documents are cut into full windows of the longest tier; the rest of each goes to the tier of the
smallest window that holds it. From the longest tier down, every window takes one such rest and its
gap is filled from the shorter tiers: whole rests that fit best, then a part of one. The shortest
tier is filled end to end. Windows are powers of two and full, so nothing is padded; what is left
at the end of a partition is cut at powers of two.

Windows are then dealt to step groups, longest first. As window lengths divide the tokens of a step,
every group holds exactly that many, but for the last one of a block.

A task packs its own documents block by block, so no shuffle is needed and a lost task is repeated
with the same result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.tokens import encoder, tokenizer_path

TIERS = (512, 1024, 2048, 4096)
#: Tokens packed together in one task, and tokens of a training step.
BLOCK_TOKENS, STEP_TOKENS = 1 << 21, 1 << 15
END_ID = 2
#: Documents encoded at once.
DOCS_AT_ONCE = 512


class Shelf:
    """Rests of one tier, by length; gives the longest that fits."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []  # length, document, start

    def add(self, length: int, doc: int, start: int) -> None:
        bisect.insort(self.items, (length, doc, start))

    def fill(self, items: list[tuple[int, int, int]]) -> None:
        self.items = sorted(items)

    def fitting(self, room: int) -> tuple[int, int, int] | None:
        at = bisect.bisect_right(self.items, (room, 1 << 62, 0))
        return self.items.pop(at - 1) if at else None

    def longest(self) -> tuple[int, int, int] | None:
        return self.items.pop() if self.items else None


def plan(
    lengths: Sequence[int], tiers: Sequence[int] = TIERS, last: bool = True
) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows, each a list of (document, start, length), and what is left for the next block.

    With ``last`` nothing is left. Documents of no tokens lie in no window.
    """
    top, windows = tiers[-1], []
    rests: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        full = n - n % top
        windows.extend([(doc, at, top)] for at in range(0, full, top))
        if n > full:
            rest = n - full
            rests[tiers[bisect.bisect_left(tiers, rest)]].append((rest, doc, full))
    shelves = {t: Shelf() for t in tiers}
    for t in tiers:
        shelves[t].fill(rests[t])

    def put_back(length: int, doc: int, start: int) -> None:
        shelves[tiers[bisect.bisect_left(tiers, length)]].add(length, doc, start)

    left: list[tuple[int, int, int]] = []
    for level in range(len(tiers) - 1, -1, -1):
        size = tiers[level]
        while (item := shelves[size].longest()) is not None:
            window, room = [(item[1], item[2], item[0])], size - item[0]
            below = tiers[level::-1]
            while room:
                found = next((x for t in below if (x := shelves[t].fitting(room))), None)
                if found is None:
                    found = next((x for t in reversed(below) if (x := shelves[t].longest())), None)
                if found is None:
                    break
                length, doc, start = found
                used = min(length, room)
                window.append((doc, start, used))
                room -= used
                if used < length:
                    put_back(length - used, doc, start + used)
            if not room:
                windows.append(window)
            else:  # nothing is left on any shelf: this window is all that remains
                left.extend((length, doc, start) for doc, start, length in window)
                break
        if left:
            break
    if not last:
        return windows, left
    return windows + _by_powers(left, top), []


def _by_powers(items: list[tuple[int, int, int]], top: int) -> list[list[tuple[int, int, int]]]:
    """Pieces laid end to end and cut into windows at the powers of two of their sum."""
    total, windows, queue = sum(x[0] for x in items), [], [(d, s, n) for n, d, s in items]
    while total:
        size = min(top, 1 << (total.bit_length() - 1))
        window, room = [], size
        while room:
            doc, start, length = queue.pop(0)
            used = min(length, room)
            window.append((doc, start, used))
            room -= used
            if used < length:
                queue.insert(0, (doc, start + used, length - used))
        windows.append(window)
        total -= size
    return windows


def _rows(docs, windows, first, base, step_tokens, with_ids, with_place):
    """Arrow batch of the pieces of finished windows. ``docs`` has (key, ids, start, all ids, place)."""
    names = ["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
             "window", "step_group", *(["place"] if with_place else [])]
    cols: dict[str, list] = {n: [] for n in [*names, *(["ids"] if with_ids else [])]}
    sized = sorted(windows, key=lambda w: -sum(x[2] for x in w))
    filled = 0
    for n, window in enumerate(sized):
        size, offset = sum(x[2] for x in window), 0
        place = (min(docs[x[0]][4] for x in window),) if with_place else ()
        for doc, start, length in window:
            key, ids, skipped, total, _ = docs[doc]
            piece = ids[start * 4 : (start + length) * 4]
            row = (key, skipped + start, length, zlib.crc32(piece), total, base + first + n, offset,
                   size, base + first + filled // step_tokens, *place)
            for name, value in zip(names, row, strict=True):
                cols[name].append(value)
            if with_ids:
                cols["ids"].append(piece)
            offset += length
        filled += size
    kinds = {"ids": pa.binary()}
    return pa.RecordBatch.from_pydict(
        {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in cols.items()}
    )


def packed(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, tiers: Sequence[int] = TIERS,
    key: str = "doc_id", text: str = "text", with_ids: bool = False, place: str | None = None,
) -> DataFrame:
    """Pieces of all documents and where they lie.

    Columns: the key, ``start`` and ``length`` (ids of the document before the piece, ids in it),
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence), ``window`` (its
    length), ``step_group``; with ``with_ids`` also ``ids`` (little-endian 32-bit). ``place`` names a
    column of whole numbers that orders the documents: each sequence then has the smallest ``place`` of
    its documents, by which sequences follow that order. A NULL or empty
    text is the end id alone. Rows with equal or NULL keys are packed one by one. Keys are whole
    numbers. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) or t > STEP_TOKENS for t in tiers):
        raise ValueError("windows are powers of two, at most a step's tokens")
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        base, first = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []  # key, ids not yet packed, ids before them, all ids, place
        tokens = 0

        def flush(last: bool):
            nonlocal held, tokens, first
            windows, left = plan([len(x[1]) // 4 for x in held], tiers, last)
            batch = _rows(held, windows, first, base, STEP_TOKENS, with_ids, place is not None)
            first += len(windows)
            held = [
                (k, ids[start * 4 : (start + n) * 4], skipped + start, total, at)
                for n, doc, start in left
                for k, ids, skipped, total, at in [held[doc]]
            ]
            tokens = sum(len(x[1]) for x in held) // 4
            return batch

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            places = batch.column(2).to_pylist() if place else [0] * len(keys)
            for at in range(0, len(keys), DOCS_AT_ONCE):
                found = encode(texts.slice(at, DOCS_AT_ONCE), end_id)
                own = slice(at, at + DOCS_AT_ONCE)
                for k, ids, lies in zip(keys[own], found, places[own], strict=True):
                    held.append((k, ids, 0, len(ids) // 4, lies))
                    tokens += len(ids) // 4
                if tokens >= BLOCK_TOKENS:
                    yield flush(False)
        if held:
            yield flush(True)

    schema = "_key long, start long, length long, ids_crc32 long, doc_tokens long, "
    schema += "sequence_id long, offset long, window long, step_group long"
    if place:
        schema += ", place long"
    if with_ids:
        schema += ", ids binary"
    named = [F.col(place).cast("long").alias("_place")] if place else []
    return (
        docs.select(
            F.col(key).cast("long").alias("_key"), F.col(text).cast("binary").alias("_text"), *named
        )
        .mapInArrow(pack, schema)
        .withColumnRenamed("_key", key)
    )


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
