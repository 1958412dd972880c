"""Token ids in raw binary shards, with a minimal perfect hash index for keyed access.

Documents are range-sorted by key; every task encodes its range and writes raw ids, little-endian
and as wide as the vocabulary needs (16 or 32 bits), to shards that appear under their names when
complete. The index is cut into buckets by a hash of the key. Each bucket holds a minimal perfect
hash function of its keys (levels of bit arrays: a key sits at the first level where no other key
shares its bit, and its number is the count of bits before) and, by that number, a fingerprint, the
shard, the offset and the length. A look-up is one bucket, a few bits and one read; the stored
fingerprint turns an unknown key into a miss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.common import running_sum, scratch, written
from lunario.llm.files import Folder
from lunario.llm.tokens import encoder, tokenizer_path

END_ID = 1
#: Ids of a shard before the next one is begun, documents encoded at once.
SHARD_IDS, DOCS_AT_ONCE = 1 << 26, 512
#: Keys of an index bucket, on average, and bits of a level for each key that reaches it.
BUCKET_KEYS, SPREAD = 20_000, 2.0
_HASHES = "_h1 long, _h2 long"


# --- minimal perfect hash -------------------------------------------------------------------------


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser of a hash and a salt."""
    with np.errstate(over="ignore"):
        x = a ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (_mix(_mix(h1, level) ^ h2, level + 1) % np.uint64(bits)).astype(np.int64)


def build_hash(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Levels of bits for keys given as distinct pairs of 64-bit hashes."""
    levels: list[np.ndarray] = []
    while len(h1):
        bits = max(8, int(len(h1) * SPREAD))
        at = _slot(h1, h2, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(alone)
        stay = ~alone[at]
        h1, h2 = h1[stay], h2[stay]
        if len(levels) > 400:
            raise ValueError("keys of a bucket are not distinct")
    return levels


def find(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Number of each key, -1 where no level holds it; keys that were not built in may get any."""
    found = np.full(len(h1), -1, dtype=np.int64)
    todo, before = np.arange(len(h1)), 0
    for n, level in enumerate(levels):
        at = _slot(h1[todo], h2[todo], n, len(level))
        hit = level[at]
        ranks = np.cumsum(level) - 1
        found[todo[hit]] = before + ranks[at[hit]]
        before += int(level.sum())
        todo = todo[~hit]
    return found


# --- writing --------------------------------------------------------------------------------------


def write_shards(
    docs: DataFrame, folder: str, path: str, end_id: int = END_ID, key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write the shards; one row per document: key, shard, place in it, ids.

    Rows are in ascending key order, NULL keys first; rows of one key follow each other in an order
    fixed by their text.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, target = encoder(path), Folder(folder)
        part, number, out, at = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for begin in range(0, len(keys), DOCS_AT_ONCE):
                rows = []
                for ids in coder.encode(texts.slice(begin, DOCS_AT_ONCE), end_id):
                    if out is not None and at >= SHARD_IDS:
                        out.commit()
                        number, out, at = number + 1, None, 0
                    if out is None:
                        out = target.create(f"ids-{part:06d}-{number:06d}.u{coder.width * 8}")
                    if coder.width == 2:
                        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                    n = len(ids) // coder.width
                    out.write(ids)
                    rows.append((out.name, at, n))
                    at += n
                names, places, sizes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(begin, DOCS_AT_ONCE),
                        pa.array(names),
                        pa.array(places, pa.int64()),
                        pa.array(sizes, pa.int64()),
                    ],
                    ["_key", "shard", "at", "n"],
                )
        if out is not None:
            out.commit()

    return (
        docs.select(
            F.col(key).cast("long").alias("_key"),
            F.col(text).cast("binary").alias("_text"),
        )
        .withColumn("_tie", F.xxhash64("_text"))
        .repartitionByRange("_key", "_tie")
        .sortWithinPartitions("_key", "_tie")
        .select("_key", "_text")
        .mapInArrow(write, "_key long, shard string, at long, n long")
    )


def build_index(entries: DataFrame) -> DataFrame:
    """One row per bucket of keys: the hash function and its table.

    ``entries`` has ``_key``, ``_nth`` (0 for the first row of a key, 1 for the next), ``shard``,
    ``at`` and ``n``. Rows of one key are told apart by ``_nth``.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (rows[c].to_numpy().view(np.uint64) for c in ("_h1", "_h2"))
        levels = build_hash(h1, h2)
        order = np.argsort(find(levels, h1, h2))
        table = {c: rows[c].to_numpy()[order] for c in ("shard_no", "at", "n")}
        return pd.DataFrame(
            {
                "_bucket": [rows["_bucket"].iloc[0]],
                "bits": [[np.packbits(x).tobytes() for x in levels]],
                "sizes": [[len(x) for x in levels]],
                "fingerprints": [(h2[order] >> np.uint64(32)).astype("<u4").tobytes()],
                "shards": [table["shard_no"].astype("<i4").tobytes()],
                "places": [table["at"].astype("<i8").tobytes()],
                "lengths": [table["n"].astype("<i8").tobytes()],
            }
        )

    return entries.groupBy("_bucket").applyInPandas(
        build,
        "_bucket int, bits array<binary>, sizes array<long>, fingerprints binary, shards binary, "
        "places binary, lengths binary",
    )


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Add the two hashes of (key, nth) and the bucket; a NULL key has hashes of its own."""
    named = F.concat_ws(":", F.coalesce(F.col("_key").cast("string"), F.lit("null")), F.col("_nth"))
    return keys.withColumns(
        {
            "_h1": F.xxhash64(named, F.lit(1)),
            "_h2": F.xxhash64(F.lit(2), named),
        }
    ).withColumn("_bucket", F.pmod(F.col("_h1"), F.lit(buckets)).cast("int"))


class TokenFiles:
    """Shards in ``folder`` and their index; made by ``write``."""

    def __init__(self, folder: str, entries: DataFrame, shards: DataFrame, index: DataFrame,
                 buckets: int, width: int):
        self.folder, self.entries, self.shards, self.index = folder, entries, shards, index
        self.buckets, self.width = buckets, width

    @classmethod
    def write(
        cls, docs: DataFrame, folder: str | None = None, path: str | None = None,
        end_id: int = END_ID, key: str = "doc_id", text: str = "text",
    ) -> TokenFiles:
        """Encode and write ``docs``; a NULL or empty text is the end id alone.

        Keys are whole numbers and may be NULL or repeated. Other columns are not read.
        """
        spark = docs.sparkSession
        path = path or tokenizer_path()
        folder = folder or scratch(spark, "token-ids")
        rows = written(write_shards(docs, folder, path, end_id, key, text), "token-entries")
        # one row per shard: its number and the ids and documents before it
        earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        shards = written(
            rows.groupBy("shard")
            .agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("docs"))
            .select(
                "shard",
                (F.row_number().over(Window.orderBy("shard")) - 1).alias("shard_no"),
                F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("ids_before"),
            ),
            "token-shards",
        )
        # nth row of its key; only keys that repeat are counted through, however often they do
        repeated = written(
            rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"),
            "token-repeated",
        ).select(F.col("_key").alias("_again"))
        same = F.col("_key").eqNullSafe(F.col("_again"))
        if repeated.isEmpty():
            entries = rows.withColumn("_nth", F.lit(0))
        else:
            many = running_sum(
                rows.join(repeated, same, "left_semi").withColumns(
                    {
                        "_name": F.coalesce(F.col("_key").cast("string"), F.lit("null")),
                        "_one": F.lit(1),
                    }
                ),
                ["shard", "at"],
                "_one",
                "_nth",
                ["_name"],
            )
            entries = (
                rows.join(repeated, same, "left_anti")
                .withColumn("_nth", F.lit(0))
                .unionByName(many.select(*rows.columns, F.col("_nth").cast("int")))
            )
        entries = written(entries.join(shards, "shard"), "token-index-entries")
        buckets = max(1, -(-entries.count() // BUCKET_KEYS))
        index = written(build_index(_hashed(entries, buckets)), "token-index")
        return cls(folder, entries, shards, index, buckets, encoder(path).width)

    def locate(self, keys: DataFrame) -> DataFrame:
        """``keys`` (``_key``, ``_nth``) that the index knows, with ``shard_no``, ``at`` and ``n``."""

        def look_up(rows: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({c: [] for c in ("_key", "_nth", "shard_no", "at", "n")})
            if not len(bucket) or not len(rows):
                return empty
            b = bucket.iloc[0]
            levels = [
                np.unpackbits(np.frombuffer(raw, np.uint8), count=int(size)).astype(bool)
                for raw, size in zip(b["bits"], b["sizes"], strict=True)
            ]
            h1, h2 = (rows[c].to_numpy().view(np.uint64) for c in ("_h1", "_h2"))
            at = find(levels, h1, h2)
            marks = np.frombuffer(b["fingerprints"], "<u4")
            known = (at >= 0) & (marks[at] == (h2 >> np.uint64(32)).astype(np.uint32))
            at = at[known]
            return pd.DataFrame(
                {
                    "_key": rows["_key"][known],
                    "_nth": rows["_nth"][known],
                    "shard_no": np.frombuffer(b["shards"], "<i4")[at],
                    "at": np.frombuffer(b["places"], "<i8")[at],
                    "n": np.frombuffer(b["lengths"], "<i8")[at],
                }
            )

        asked = _hashed(keys.select("_key", "_nth"), self.buckets)
        return (
            asked.groupBy("_bucket")
            .cogroup(self.index.groupBy("_bucket"))
            .applyInPandas(look_up, "_key long, _nth int, shard_no int, at long, n long")
        )

    def read(self, keys: DataFrame, with_ids: bool = True) -> DataFrame:
        """Ids of the given keys: ``_key``, ``_nth``, ``start``, ``n_tokens``, ``ids`` and ``ids_crc32``.

        ``ids`` are little-endian 32-bit, left out unless ``with_ids``. ``start`` counts the ids of
        all documents before. Requests are sorted by place, so each task
        reads its shards from front to back.
        """
        folder, width = self.folder, self.width

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            source, name, file = Folder(folder), None, None
            for batch in batches:
                raw = []
                for shard, at, n in zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)],
                                        strict=True):
                    if shard != name:
                        name, file = shard, source.open(shard)
                    data = file.read_at(n * width, at * width)
                    if len(data) != n * width:
                        raise OSError(f"{shard} ends before the ids at {at}")
                    if width == 2:
                        data = np.frombuffer(data, "<u2").astype("<u4").tobytes()
                    raw.append(data)
                columns = {
                    "_key": batch.column(0),
                    "_nth": batch.column(1),
                    "start": batch.column(5),
                    "n_tokens": batch.column(4),
                    **({"ids": pa.array(raw, pa.binary())} if with_ids else {}),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

        ids = "ids binary, " if with_ids else ""

        placed = (
            self.locate(keys)
            .join(self.shards, "shard_no")
            .select("_key", "_nth", "shard", "at", "n", (F.col("ids_before") + F.col("at")).alias("start"))
        )
        return (
            placed.repartitionByRange("shard", "at")
            .sortWithinPartitions("shard", "at")
            .mapInArrow(
                fetch, f"_key long, _nth int, start long, n_tokens long, {ids}ids_crc32 long"
            )
        )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = TokenFiles.write(docs)
    return files.read(files.entries, with_ids=False).select(
        F.col("_key").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )
