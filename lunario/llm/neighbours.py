"""Nearest neighbours by inner product with multiprobe p-stable hashing.

A hash function projects a vector on a Gaussian direction and cuts the line into slots of one width;
a table joins several of them to a bucket code. Vectors first get one more component that makes all
of them equally long, so that the largest inner product is the smallest distance. A query visits its
own bucket and the perturbed ones (a slot up, down or none in each function) in the order of their
estimated success: the smaller the sum of squared distances to the slots' bounds, the earlier.

Buckets are dealt to shards by their code, a bucket with many vectors in several chunks, and each
query goes once to every shard that holds one of its probes. A task holds the vectors of a shard while
its queries stream past, and multiplies those of a bucket with its vectors, so pairs never become rows;
what leaves it is the best few for each query.
Candidates of all tables are merged and ranked by their exact inner product. Queries that met too
few candidates are searched again over all vectors, in blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.common import written

K, QUERY_EVERY = 20, 20
#: Tables, hash functions of a table, slot width as a share of the vectors' length, and probes of a
#: table (of 3 ** FUNCTIONS steps). The same at every size: chosen so that vectors without any structure,
#: where neighbours are hardly nearer than others, are still found with a recall above 0.9.
TABLES, FUNCTIONS, WIDTH, PROBES = 5, 5, 1.4, 100
#: Vectors of a chunk of a bucket, and bytes of the vectors of a shard, on average. Every shard that a
#: query visits returns its best few, so shards are as large as a task can hold with ease.
CHUNK, SHARD_BYTES = 4096, 24 << 20
#: Queries that a task holds at once.
QUERIES_AT_ONCE = 512
SEED = 7


class Hashing:
    """The hash functions of all tables, from a seed."""

    def __init__(self, dim: int, length: float, functions: int, tables: int = TABLES):
        rng = np.random.default_rng(SEED)
        self.functions, self.tables, self.length = functions, tables if functions else 1, length
        shape = (self.tables, functions)
        self.planes = rng.normal(size=(*shape, dim + 1))
        self.width = WIDTH * length
        self.offset = rng.uniform(0, self.width, shape)
        self.factor = rng.integers(1, 1 << 62, shape) * 2 + 1
        self.probes = min(PROBES, 3**functions)

    def _places(self, vectors: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each vector, table and function, and how far from its lower bound."""
        more = np.zeros(len(vectors))
        if not query:
            more = np.sqrt(np.maximum(self.length**2 - (vectors**2).sum(axis=1), 0))
        at = np.einsum("nd,tfd->ntf", np.column_stack([vectors, more]), self.planes) + self.offset
        slot = np.floor(at / self.width)
        return slot.astype(np.int64), at - slot * self.width

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket code of each vector in each table."""
        with np.errstate(over="ignore"):
            return (self._places(vectors, False)[0] * self.factor).sum(axis=2)

    def visits(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of the buckets that each query visits in each table, most promising first."""
        slot, above = self._places(vectors, True)
        steps = np.array(list(itertools.product((-1, 0, 1), repeat=self.functions)), dtype=np.int64)
        costs = np.stack([above**2, np.zeros_like(above), (self.width - above) ** 2])
        cost = np.zeros((*slot.shape[:2], len(steps)))
        for f in range(self.functions):
            cost += np.moveaxis(costs[:, :, :, f], 0, -1)[:, :, steps[:, f] + 1]
        order = np.argsort(cost, axis=2, kind="stable")[:, :, : self.probes]
        with np.errstate(over="ignore"):
            base = (slot * self.factor).sum(axis=2)
            shift = np.einsum("sf,tf->ts", steps, self.factor)
        return base[:, :, None] + np.take_along_axis(shift[None], order, axis=2)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal rows give equal numbers wherever they stand."""
    return (left * right).sum(axis=1)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best distinct ids of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q, v = query[order], ids[order]
    # an id met in several tables or buckets has one score, so its copies follow each other
    fresh = np.ones(len(q), dtype=bool)
    fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    order, q = order[fresh], q[fresh]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


class Shard:
    """The vectors of a shard by bucket."""

    def __init__(self, index: pa.Table):
        self.ids = index.column("id").to_numpy()
        self.vectors = _vectors(index.column("vector").combine_chunks())
        keys = index.select(["table", "code", "chunk"]).to_pandas()
        self.rows = keys.groupby(["table", "code", "chunk"]).indices

    def search(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        """The k best of the shard for each of some queries, in the buckets that they visit."""
        queries = _vectors(asked.column("vector"))
        probes = asked.column("probes")
        flat = probes.flatten()
        table, code, chunk = (flat.field(n).to_numpy() for n in ("table", "code", "chunk"))
        sizes = np.diff(probes.offsets.to_numpy())
        owner = np.repeat(np.arange(len(asked)), sizes)
        order = np.lexsort((owner, chunk, code, table))
        table, code, chunk, owner = table[order], code[order], chunk[order], owner[order]
        fresh = np.ones(len(owner), dtype=bool)
        fresh[1:] = (np.diff(table) != 0) | (code[1:] != code[:-1]) | (np.diff(chunk) != 0)
        cuts = np.flatnonzero(fresh)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for begin, end in zip(cuts, np.append(cuts[1:], len(owner)), strict=True):
            at = self.rows.get((table[begin], code[begin], chunk[begin]))
            if at is None:
                continue
            q = owner[begin:end]
            score = queries[q] @ self.vectors[at].T
            if len(at) > k:
                least = np.partition(score, len(at) - k, axis=1)[:, len(at) - k]
                # rounding may order equal vectors either way, so near ties stay
                row, col = np.nonzero(score >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
            else:
                row, col = (x.ravel() for x in np.indices(score.shape))
            found.append((q[row], at[col]))
        if not found:
            return None
        q, v = (np.concatenate(x) for x in zip(*found, strict=True))
        # a vector met in several tables counts once
        pair = np.unique(q * len(self.ids) + v)
        q, v = pair // len(self.ids), pair % len(self.ids)
        score = np.concatenate(
            [exact(queries[q[a : a + 65536]], self.vectors[v[a : a + 65536]]) for a in range(0, len(q), 65536)]
        )
        best = _best(q, self.ids[v], score, k)
        names = asked.column("id").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(names[q[best]]), pa.array(self.ids[v[best]]), pa.array(score[best])],
            ["query_id", "vec_id", "score"],
        )


def _streamed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, a shard's vectors before its queries: the vectors are held, the queries
    pass by a few at a time."""
    number, held, shard = None, [], None
    for batch in batches:
        mark = batch.column("shard").to_numpy() * 2 + batch.column("asks").to_numpy()
        cuts = np.flatnonzero(np.diff(mark)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(mark)], strict=True):
            part = batch.slice(begin, end - begin)
            if mark[begin] // 2 != number:
                number, held, shard = mark[begin] // 2, [], None
            if mark[begin] % 2 == 0:
                held.append(part)
                continue
            if shard is None and held:
                shard, held = Shard(pa.Table.from_batches(held)), []
            for at in range(0, len(part) if shard else 0, QUERIES_AT_ONCE):
                found = shard.search(part.slice(at, QUERIES_AT_ONCE), k)
                if found is not None:
                    yield found


def _round(vectors: DataFrame, queries: DataFrame, hashing: Hashing, k: int, total: int) -> DataFrame:
    """The k best candidates of each query in the buckets it visits."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                codes = hashing.codes(_vectors(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(list(codes), pa.list_(pa.int64()))],
                    ["vec_id", "vector", "codes"],
                )

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                visits = hashing.visits(_vectors(part.column(1)))
                n, tables, probes = visits.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(), tables * probes)),
                        pa.array(np.tile(np.repeat(np.arange(tables), probes), n), pa.int32()),
                        pa.array(visits.ravel()),
                    ],
                    ["query_id", "table", "code"],
                )

    kind = vectors.schema["vector"].dataType.simpleString()
    index = written(
        vectors.mapInArrow(coded, f"vec_id long, vector {kind}, codes array<long>").select(
            "vec_id", "vector", F.posexplode("codes").alias("table", "code")
        ),
        "hash-index",
    )
    buckets = written(
        index.groupBy("table", "code")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("table", "code", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")),
        "hash-buckets",
    )
    shards = max(1, total * hashing.tables * hashing.planes.shape[2] * 8 // SHARD_BYTES)
    shard = F.pmod(F.xxhash64("table", "code", "chunk"), F.lit(shards)).alias("shard")
    placed = (
        index.join(buckets, ["table", "code"])
        .withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
        .select(shard, "table", "code", "chunk", "vec_id", "vector")
    )
    visits = (
        queries.mapInArrow(probed, "query_id long, table int, code long")
        .distinct()
        .join(buckets, ["table", "code"])
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .groupBy("query_id", shard)
        .agg(F.collect_list(F.struct("table", "code", "chunk")).alias("probes"))
        .join(queries, "query_id")
        .select("shard", "query_id", "vector", "probes")
    )

    columns = ("shard", "asks", "table", "code", "chunk", "id", "vector", "probes")
    probe = "array<struct<table: int, code: bigint, chunk: int>>"
    vectors_first = placed.withColumns(
        {"asks": F.lit(0), "id": F.col("vec_id"), "probes": F.lit(None).cast(probe)}
    ).select(*columns)
    then_queries = visits.withColumns(
        {
            "asks": F.lit(1),
            "id": F.col("query_id"),
            "table": F.lit(None).cast("int"),
            "code": F.lit(None).cast("long"),
            "chunk": F.lit(None).cast("int"),
        }
    ).select(*columns)
    found = (
        vectors_first.unionByName(then_queries)
        .repartition("shard")
        .sortWithinPartitions("shard", "asks")
        .mapInArrow(lambda batches: _streamed(batches, k), "query_id long, vec_id long, score double")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct().withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k)
        .drop("_rank")
    )


def _usable(vector: Column) -> Column:
    """Not NULL, not zero, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id",
    vector: str = "embedding", functions: int = FUNCTIONS,
) -> DataFrame:
    """The ``k`` found with the largest inner product for each query row of ``vectors``.

    Columns: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the smaller id. Rows
    with a NULL key, and vectors that are NULL, zero, hold NULL or a number that is not finite, or
    have not the commonest number of components, take no part. A query never finds its own key; with
    k others or fewer it gets them all. Of rows that repeat a key the one with the least vector counts.
    Other columns are not read. An empty table gives an empty result.

    Of equal vectors only the k + 1 smallest keys are kept: no query can be given more of them.
    """
    slim = written(
        vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"),
                       is_query.alias("asks"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .filter(_usable(F.col("vector")))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")),
        "vectors",
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    kinds = (
        slim.groupBy(F.size("vector").alias("dim"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("length"))
        .orderBy(F.desc("n"), F.desc("dim"))
        .limit(1)
        .collect()
    )
    if not kinds:
        return slim.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
            F.lit(0.0).alias("score"),
        )
    dim, length = kinds[0]["dim"], kinds[0]["length"]
    slim = slim.filter(F.size("vector") == dim)
    same = Window.partitionBy("vector").orderBy("vec_id")
    apart = written(
        slim.select("vec_id", "vector")
        .withColumn("_n", F.row_number().over(same))
        .filter(F.col("_n") <= k + 1)
        .drop("_n"),
        "distinct-vectors",
    )
    total = apart.count()
    asking = slim.filter("asks").select(F.col("vec_id").alias("query_id"), "vector")
    # equal queries are searched once, under the smallest of their keys
    firsts = written(
        asking.groupBy("vector").agg(F.min("query_id").alias("first")), "distinct-queries"
    )
    members = asking.join(firsts, "vector").select("query_id", "first")
    queries = firsts.select(F.col("first").alias("query_id"), "vector")
    found = written(
        _round(apart, queries, Hashing(dim, length, functions), k + 1, total), "found"
    )
    if functions:
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        short = written(
            queries.join(enough.filter(F.col("n") > min(k, total - 1)), "query_id", "left_anti"),
            "short-queries",
        )
        if not short.isEmpty():
            again = _round(apart, short, Hashing(dim, length, 0), k + 1, total)
            found = found.join(short, "query_id", "left_anti").unionByName(again)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        members.join(found.withColumnRenamed("query_id", "first"), "first")
        .filter("vec_id != query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % QUERY_EVERY == 0)
