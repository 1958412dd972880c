"""Near-duplicate groups by SimHash fingerprints and a self-join of their binary trie.

Two fingerprints link when they differ in at most BUDGET bits. The distinct fingerprints form a
binary trie. Its self-join walks pairs of nodes of one depth, counts the bits in which their paths
differ, and drops a pair as soon as that count exceeds the budget. The upper part of the walk is a
Spark loop over node pairs and their counts, down to pairs that hold few enough fingerprints for one
task; the lower part runs on arrays inside those tasks. A dense region is split at ever deeper bits
until it fits, so no task depends on how alike the documents are.

Tasks return links that connect the same fingerprints as all of theirs do (a star for each local
group), and the links of all tasks are joined to components by repeated hooking and shortcutting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lunario.llm.common import addressed, written

SHINGLE_WORDS, HASH_SEED, BUDGET = 3, 42, 2
#: Fingerprints of a node pair that one task takes, and bits by which larger pairs are split.
PAIR_ROWS, STEP = 1 << 15, 2
DOCS_AT_ONCE = 512
#: Node pairs walked at once in a task, comparisons below which a pair is compared outright.
WALK_AT_ONCE, OUTRIGHT = 1 << 17, 32


# --- fingerprints ---------------------------------------------------------------------------------

#: For each byte value, its eight bits, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned 64-bit hashes of all shingles of a UTF-8 text, repeats included."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        raw = digest(joined, HASH_SEED)
    else:
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(parts) - words + 1].tolist()
        raw = b"".join(
            [
                digest(joined[a:b], HASH_SEED)
                for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)
            ]
        )
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64)


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints of a list of texts: a bit is set if it is set in over half of the hashes."""
    hashes = [shingle_hashes(x) for x in texts]
    counts = np.array([len(x) for x in hashes])
    octets = np.concatenate(hashes).view(np.uint8).reshape(-1, 8) if counts.sum() else None
    result = np.zeros(len(texts), dtype=np.uint64)
    if octets is None:
        return result
    owner = np.repeat(np.arange(len(texts)) * 256, counts)
    for n in range(8):  # little-endian: byte n holds the bits from 8n
        seen = np.bincount(owner + octets[:, n], minlength=len(texts) * 256)
        ones = seen.reshape(len(texts), 256) @ _BITS
        for bit in range(8):
            result |= (2 * ones[:, bit] > counts).astype(np.uint64) << np.uint64(8 * n + bit)
    return result


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_doc`` (the columns of ``docs`` but the text, as a struct) and ``_print``, a signed long."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_doc")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                found = fingerprints_of(part.column(1).to_pylist()).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["_doc", "_print"])

    slim = docs.select(rest, F.col(text).cast("binary").alias("_text"))
    schema = T.StructType([slim.schema["_doc"], T.StructField("_print", T.LongType())])
    return slim.mapInArrow(take, schema)


# --- trie self-join -------------------------------------------------------------------------------


def _prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, 64 - depth) if depth else F.lit(0).cast("long")


def node_pairs(prints: DataFrame, rows: int, budget: int) -> list[tuple[int, DataFrame]]:
    """(depth, pairs) of trie nodes that may hold links and have ``rows`` fingerprints at most.

    ``pairs`` has the nodes ``a`` <= ``b`` as prefixes and ``errors``, the bits in which they differ.
    """
    ready, depth = [], 0
    total = prints.count()
    spark = prints.sparkSession
    front = spark.range(1).select(
        *[F.lit(0).cast("long").alias(c) for c in ("a", "b")],
        F.lit(0).alias("errors"),
        F.lit(total).cast("long").alias("size"),
    )
    while True:
        fits = (F.col("size") <= rows) if depth < 64 else F.lit(True)
        ready.append((depth, front.filter(fits).select("a", "b", "errors")))
        large = written(front.filter(~fits), f"nodes-{depth}")
        if large.isEmpty():
            return ready
        depth += STEP
        nodes = written(
            prints.groupBy(_prefix(F.col("_print"), depth).alias("node")).agg(
                F.count(F.lit(1)).alias("n")
            ),
            f"counts-{depth}",
        ).withColumn("parent", F.shiftrightunsigned("node", STEP))
        a, b = (
            nodes.select(*[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "parent")])
            for side in "ab"
        )
        errors = F.col("errors") + F.bit_count(F.col("node_a").bitwiseXOR(F.col("node_b"))
                                               .bitwiseAND(F.lit((1 << STEP) - 1)))
        front = written(
            large.join(a, F.col("a") == F.col("parent_a"))
            .join(b, F.col("b") == F.col("parent_b"))
            .filter((F.col("a") != F.col("b")) | (F.col("node_a") <= F.col("node_b")))
            .select(
                F.col("node_a").alias("a"),
                F.col("node_b").alias("b"),
                errors.alias("errors"),
                F.when(F.col("node_a") == F.col("node_b"), F.col("n_a"))
                .otherwise(F.col("n_a") + F.col("n_b"))
                .alias("size"),
            )
            .filter(F.col("errors") <= budget),
            f"front-{depth}",
        )


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: every linked value with the least one of its group, itself left out."""
    values, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b):
            np.minimum.at(new, ends, low)
            np.minimum.at(new, label[ends], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = label != np.arange(len(values))
    return values[leaf], values[label[leaf]]


def walk(
    first: np.ndarray, second: np.ndarray | None, depth: int, errors: int, budget: int = BUDGET
) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sorted arrays of distinct fingerprints that share a prefix each.

    ``second`` is None for a node with itself. ``depth`` and ``errors`` tell where the pair stands.
    """
    same, second = second is None, first if second is None else second
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    start = np.array([[0], [len(first)], [0], [len(second)], [errors]], dtype=np.int64)
    stack = [(depth, start)]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > WALK_AT_ONCE:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        alo, ahi, blo, bhi, err = pairs
        na, nb = ahi - alo, bhi - blo
        own = same & (alo == blo)
        outright = (na * nb <= OUTRIGHT) | (depth == 64)
        if outright.any():
            n = (na * nb)[outright]
            which = np.repeat(np.flatnonzero(outright), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = alo[which] + k // nb[which], blo[which] + k % nb[which]
            near = np.bitwise_count(first[i] ^ second[j]) <= budget
            near &= ~own[which] | (i < j)
            if near.any():
                links.append((first[i[near]], second[j[near]]))
                held += int(near.sum())
                if held > 1 << 20:
                    links = [_stars(*map(np.concatenate, zip(*links, strict=True)))]
                    held = len(links[0][0])
        pairs, own = pairs[:, ~outright], own[~outright]
        if not pairs.shape[1]:
            continue
        alo, ahi, blo, bhi, err = pairs
        shift = np.uint64(63 - depth)
        cut = []
        for values, lo, hi in ((first, alo, ahi), (second, blo, bhi)):
            one = ((values[lo] >> shift) | np.uint64(1)) << shift
            cut.append(np.clip(np.searchsorted(values, one), lo, hi))
        amid, bmid = cut
        children = [
            np.stack([alo, amid, blo, bmid, err]),
            np.stack([amid, ahi, bmid, bhi, err]),
            np.stack([alo, amid, bmid, bhi, err + 1]),
            np.stack([amid, ahi, blo, bmid, err + 1])[:, ~own],
        ]
        below = np.concatenate(children, axis=1)
        keep = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)
        if keep.any():
            stack.append((depth + 1, below[:, keep]))
    if not links:
        none = np.zeros(0, dtype=np.uint64)
        return none, none
    return _stars(*map(np.concatenate, zip(*links, strict=True)))


def links(prints: DataFrame, rows: int = PAIR_ROWS, budget: int = BUDGET) -> DataFrame:
    """Pairs ``u``, ``v`` of distinct fingerprints (column ``_print``) that connect all that link.

    A node travels as one array of its fingerprints, ``rows`` at most, to every pair it is part of.
    """
    sent = None
    for depth, pairs in node_pairs(prints, rows, budget):
        if pairs.isEmpty():
            continue
        named = pairs.withColumn("depth", F.lit(depth)).withColumn(
            "pair", F.concat_ws("-", F.lit(depth), "a", "b")
        )
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        nodes = written(
            prints.withColumn("node", _prefix(F.col("_print"), depth))
            .join(wanted, "node", "left_semi")
            .groupBy("node")
            .agg(F.collect_list("_print").alias("prints")),
            f"trie-nodes-{depth}",
        )
        for side, part in (("a", named), ("b", named.filter("a != b"))):
            own = part.withColumnRenamed(side, "node").join(nodes, "node").select(
                "pair", "depth", "errors", F.lit(side).alias("side"), "prints"
            )
            sent = own if sent is None else sent.unionByName(own)
    if sent is None:
        return prints.limit(0).select(F.col("_print").alias("u"), F.col("_print").alias("v"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        sides = {s: np.sort(x.view(np.uint64)) for s, x in zip(group["side"], group["prints"], strict=True)}
        depth, errors = int(group["depth"].iloc[0]), int(group["errors"].iloc[0])
        u, v = walk(sides["a"], sides.get("b"), depth, errors, budget)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return sent.groupBy("pair").applyInPandas(join, "u long, v long")


# --- components -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node of ``edges`` (``u``, ``v``); one root for each component.

    Each round hooks a node and its parent below the least grandparent among its neighbours and then
    halves the paths; rounds grow with the logarithm of the longest path.
    """
    both = written(
        edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        .distinct(),
        "edges",
    )
    parent = written(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")),
                     "roots")
    while True:
        seen = both.join(parent.select(F.col("node").alias("v"), F.col("root").alias("other")), "v")
        offers = seen.select(F.col("u").alias("node"), "other")
        hooks = seen.join(
            parent.select(F.col("node").alias("u"), F.col("root").alias("mine")), "u"
        ).select(F.col("mine").alias("node"), "other")
        least = offers.unionByName(hooks).groupBy("node").agg(F.min("other").alias("other"))
        hooked = written(
            parent.join(least, "node", "left").select(
                "node", F.col("root").alias("was"), F.least("root", "other").alias("root")
            ),
            "hooked",
        )
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        parent = written(
            hooked.join(up, "root").select("node", F.col("above").alias("root"), "was"), "roots"
        )
        moved = not parent.filter("root != was").isEmpty()
        parent = parent.select("node", "root")
        if not moved:
            return parent


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = PAIR_ROWS,
    budget: int = BUDGET,
) -> DataFrame:
    """Fingerprint and component of every row of ``docs``.

    Columns: ``_doc`` (the columns of ``docs`` but the text, as a struct), ``fingerprint`` (16 hex
    digits), ``component_id`` (the smallest key that chains of links reach; NULL if all are NULL).
    Texts with fewer words than a shingle are one shingle; texts without words have fingerprint zero
    and link like any other. Equal texts and repeated rows share a component. An empty table gives an
    empty result.
    """
    marked = written(fingerprints(docs, text), "fingerprints")
    prints = written(
        marked.groupBy("_print").agg(F.min(F.col("_doc")[key]).alias("least")), "distinct-prints"
    )
    roots = components(written(links(prints.select("_print"), rows, budget), "links"))
    rooted = prints.join(roots, F.col("_print") == F.col("node"), "left").select(
        "_print", "least", F.coalesce("root", "_print").alias("root")
    )
    ends = written(rooted, "rooted")
    component = ends.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(ends.join(component, "root").select("_print", "component_id", "root"), "components")
    return marked.join(named, "_print").select(
        "_doc",
        F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"),
        "component_id",
        "root",
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, less all but one of each component.

    The row with the smallest key stays, the first of them if rows repeat it; NULL keys come last.
    """
    rows = addressed(docs)
    slim = rows.select("_id", F.col("_all")[key].alias(key), F.col("_all")[text].alias(text))
    found = near_duplicates(slim, key, text)
    k = F.col("_doc")[key]
    stays = found.groupBy("root").agg(
        F.min(F.struct(k.isNull().alias("none"), k.alias("key"), F.col("_doc")["_id"].alias("_id")))
        .alias("_best")
    )
    kept = stays.select(F.col("_best")["_id"].alias("_id"))
    return rows.join(kept, "_id", "left_semi").select("_all.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        F.col("_doc")["doc_id"].alias("doc_id"), "fingerprint", "component_id"
    )
