"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule: its relative weight as a piecewise-linear function of training time,
which runs from 0 to 1. Its demand for words up to time t is its target times the share of the
schedule's integral that lies before t. Inverting that demand gives each document, taken in seeded
order, the time at which it is trained on. The mix is the documents range-sorted by that time.

A document is taken whole, once for each pass over its source in which the middle of its words lies
before the target; so a source misses its target by half a document at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.common import BLANK, addressed, numbered, running_sum, shuffle_key, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most passes over a source.
SHARE, PASSES = 1.5, 2
#: (time, weight) knots for each of WEIGHTS: the heaviest fades, the lightest grows.
SCHEDULES = (
    ((0.0, 1.2), (1.0, 0.8)),
    ((0.0, 1.0), (0.5, 1.1), (1.0, 0.9)),
    ((0.0, 0.6), (0.5, 1.0), (1.0, 1.4)),
)
SEED = 8


def training_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time by which the given share of a schedule's integral is used up."""
    if len(knots) < 2 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("a schedule needs at least two knots in increasing time")
    if any(w < 0 for _, w in knots) or not any(w > 0 for _, w in knots):
        raise ValueError("weights are not negative, and one is above zero")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    used, result = 0.0, F.lit(knots[-1][0])
    pieces = []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        part = share * F.lit(sum(areas)) - F.lit(used)
        slope = (w1 - w0) / (t1 - t0)
        if slope:
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * F.lit(slope) * part, F.lit(0.0)))
            time = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
        else:
            time = F.lit(t0) + part / F.lit(w0 or 1.0)
        used += area
        pieces.append((used, F.least(F.greatest(time, F.lit(t0)), F.lit(t1))))
    for end, time in reversed(pieces):
        result = F.when(share * F.lit(sum(areas)) <= F.lit(end), time).otherwise(result)
    return result


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    passes: float = PASSES,
) -> DataFrame:
    """Words wanted of each source; input: one row per source with ``_source`` and ``source_size``.

    Sources in order of ``_source`` get ``weights`` in turn and share ``share`` of all words; none
    gets more than ``passes`` times its size, and what it cannot give is shared again by weight.
    The sources that end at their limit are those with the least limit per weight, so one pass in
    that order finds them. The windows run over one row per source.
    """
    if share > passes:
        raise ValueError("the mix is larger than all passes together")
    every = Window.partitionBy()
    weight = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("_rank", F.row_number().over(Window.orderBy("_source")) - 1).withColumn(
        "weight", F.get(weight, F.col("_rank") % len(weights))
    )
    w = w.withColumns(
        {
            "_limit": F.col("source_size") * F.lit(float(passes)),
            "_total": F.sum("source_size").over(every) * F.lit(float(share)),
        }
    )
    by_need = Window.orderBy(F.col("_limit") / F.col("weight"), "_rank")
    above = by_need.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns(
        {
            "_given": F.coalesce(F.sum("_limit").over(above), F.lit(0.0)),
            "_weights": F.sum("weight").over(every)
            - F.coalesce(F.sum("weight").over(above), F.lit(0.0)),
        }
    )
    per_weight = (F.col("_total") - F.col("_given")) / F.col("_weights")
    # the first source that is not filled fixes the level of all that follow
    w = w.withColumn(
        "_level", F.when(F.col("_limit") >= F.col("weight") * per_weight, per_weight)
    ).withColumn("_level", F.max("_level").over(every))
    open_ended = F.col("_limit") / F.col("weight") >= F.col("_level")
    return w.select(
        "_source",
        "source_size",
        "weight",
        (F.col("_rank") % len(weights)).alias("_kind"),
        F.when(open_ended, F.col("weight") * F.col("_level"))
        .otherwise(F.col("_limit"))
        .alias("target"),
    )


def mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, seed: int = SEED,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, key: str = "doc_id",
    text: str = "text", source: str = "source",
) -> DataFrame:
    """How often and when each row of ``docs`` is trained on.

    Columns: ``_row``, ``_doc`` (the columns of ``docs`` but the text, as a struct), ``size`` (words;
    NULL and blank texts have none), ``source_size``, ``target``, ``copies`` (0 to 2), ``taken``
    (copies times size) and ``times`` (training time of each copy). A NULL source is a source of its
    own, after all others; NULL keys are ordered like any other. Documents without words are never
    taken. An empty table gives an empty result. Reruns on the same rows agree.
    """
    if len(schedules) != len(weights):
        raise ValueError("one schedule for each weight is needed")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = written(
        numbered(
            docs.select(
                F.struct(*rest).alias("_doc"),
                F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANK}]+"))
                .cast("long")
                .alias("size"),
                F.concat(F.col(source).isNull().cast("string"), F.coalesce(source, F.lit(""))).alias(
                    "_source"
                ),
                shuffle_key(seed, key).alias("_shuffle"),
            )
        ),
        "sizes",
    )
    wanted = targets(
        rows.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, share
    )
    placed = running_sum(rows, ["_shuffle", "size", "_row"], "size", "_before", ["_source"])
    both = placed.join(wanted, "_source")
    copies, times = F.lit(0), []
    for n in range(PASSES):
        start = F.col("_before") + n * F.col("source_size")
        middle = start + F.col("size") / 2
        hit = (F.col("size") > 0) & (middle < F.col("target"))
        copies = copies + hit.cast("int")
        reached = F.least(middle / F.col("target"), F.lit(1.0))
        time = F.lit(None).cast("double")
        for kind, knots in enumerate(schedules):
            time = F.when(F.col("_kind") == kind, training_time(reached, knots)).otherwise(time)
        times.append(F.when(hit, time))
    return both.select(
        "_row",
        "_doc",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        F.array_compact(F.array(*times)).alias("times"),
    )


def training_order(mix: DataFrame) -> DataFrame:
    """Place of every copy in the training order of ``mix``, a result of ``mixed``.

    Columns: ``_row``, ``_copy`` (from 0), ``_time`` and ``position``, which counts the copies before.
    """
    copies = mix.select("_row", F.posexplode("times").alias("_copy", "_time"), F.lit(1).alias("_one"))
    return running_sum(copies, ["_time", "_row", "_copy"], "_one", "position").drop("_one")


def mixture(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings
) -> DataFrame:
    """The documents of the mix in training order, repeats included, with their own columns."""
    rows = addressed(docs)
    slim = rows.select("_id", *[F.col("_all")[c].alias(c) for c in (key, text, source)])
    taken = mixed(slim, key=key, text=text, source=source, **settings).filter("copies > 0")
    when = taken.select(F.col("_doc")["_id"].alias("_id"), F.explode("times").alias("_time"))
    return (
        rows.join(when, "_id")
        .repartitionByRange("_time", "_id")
        .sortWithinPartitions("_time", "_id")
        .select("_all.*")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mix = written(mixed(docs), "mix")
    # the counts are those of the training order, and a document's places in it are told
    order = written(training_order(mix), "training-order")
    dealt = order.groupBy("_row").agg(
        F.count("position").cast("int").alias("_dealt"),
        *[F.min(F.when(F.col("_copy") == n, F.col("position"))).alias(f"position_{n + 1}")
          for n in range(PASSES)],
    )
    copies = F.coalesce("_dealt", F.lit(0))
    return mix.join(dealt, "_row", "left").select(
        F.col("_doc")["doc_id"].alias("doc_id"),
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
        *[f"position_{n + 1}" for n in range(PASSES)],
    )


def _time_sql(kind: int) -> str:
    """SQL of the time at which the share ``f`` of a schedule's integral is reached."""
    knots = SCHEDULES[kind]
    pieces, used = [], 0.0
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        slope, area = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
        root = f"sqrt({w0 * w0!r}::DOUBLE + 2 * ({slope!r}::DOUBLE) * (f * {whole!r}::DOUBLE - {used!r}::DOUBLE))"
        used += area
        pieces.append(f"WHEN f * {whole!r}::DOUBLE <= {used!r}::DOUBLE THEN {t0!r}::DOUBLE + ({root} - {w0!r}::DOUBLE) / ({slope!r}::DOUBLE)")
    return f"CASE {' '.join(pieces)} ELSE 1.0::DOUBLE END"


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+')) AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
  FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(i % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), fill(round, i, full_at) AS (
  SELECT 0, i, false FROM w
  UNION ALL
  SELECT round + 1, i, full_at OR cap < weight * level FROM (
    SELECT f.round, f.i, f.full_at, w.weight, w.cap,
           ((SELECT sum(source_size) * 1.5::DOUBLE FROM w)
             - coalesce(sum(w.cap) FILTER (f.full_at) OVER (PARTITION BY f.round), 0))
           / sum(w.weight) FILTER (NOT f.full_at) OVER (PARTITION BY f.round) AS level
    FROM fill f JOIN w ON f.i = w.i WHERE f.round <= (SELECT count(*) FROM w))
), last AS (
  SELECT i, full_at FROM fill WHERE round = (SELECT max(round) FROM fill)
), lv AS (
  SELECT ((SELECT sum(source_size) * 1.5::DOUBLE FROM w) - coalesce(sum(cap) FILTER (full_at), 0))
         / sum(weight) FILTER (NOT full_at) AS level
  FROM w JOIN last USING (i)
), t AS (
  SELECT source, source_size, i, CASE WHEN full_at THEN cap ELSE weight * level END AS target
  FROM w JOIN last USING (i), lv
), c AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
), p AS (
  SELECT c.doc_id, c.size, c.before, t.source_size, t.target, t.i,
    CASE WHEN size = 0 THEN 0 ELSE (before + size / 2.0 < target)::INT
      + (source_size + before + size / 2.0 < target)::INT END AS n
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT p.doc_id, p.size, p.source_size, p.target, p.n::INT AS copies, (p.n * p.size)::BIGINT AS taken,
  max(place) FILTER (copy = 0) AS position_1, max(place) FILTER (copy = 1) AS position_2
FROM p LEFT JOIN (
  SELECT doc_id, copy, row_number() OVER (ORDER BY time, doc_id, copy) - 1 AS place FROM (
    SELECT doc_id, copy, CASE i % 3 {" ".join(f"WHEN {k} THEN {_time_sql(k)}" for k in range(3))} END AS time
    FROM (
      SELECT doc_id, copy, i, least((copy * source_size + before + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS f
      FROM p, (SELECT unnest([0, 1]) AS copy) WHERE copy < n
    )
  )
) o ON p.doc_id = o.doc_id
GROUP BY ALL
"""
