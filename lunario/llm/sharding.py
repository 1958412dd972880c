"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key within their source; the r-th of n rows gets the fractional rank
(2r - 1) / 2n. Sorting all rows by it interleaves the sources in proportion, so any stretch of the
order holds the mixture of the whole, and cutting it into equal stretches gives shards whose row
counts differ by one at most (law ``rows``).

Only keys, sizes and checksums are ranked; the texts never move. Ranks come from range-sorted
partitions and one carried count for each, so a source of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.common import addressed, numbered, running_sum, shuffle_key, written

SHARDS = 24
SEED = 20


def interleaved(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id",
    text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: its shard, its slot there, size and checksum.

    Columns: ``_doc`` (the columns of ``docs`` but the text, as a struct), ``size`` (UTF-8 bytes of
    the text, none for NULL, plus 8), ``text_crc32``, ``shard`` (0 to shards - 1), ``slot``
    (gapless from 0). A NULL source is a source of its own, the last one. NULL keys are ranked like
    any other; rows that repeat key, size and checksum are interchangeable. With fewer rows than
    shards some shards stay empty; an empty table gives an empty result.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = written(
        numbered(
            docs.select(
                F.struct(*rest).alias("_doc"),
                (F.octet_length(body).cast("long") + 8).alias("size"),
                F.crc32(body).alias("text_crc32"),
                F.concat(F.col(source).isNull().cast("string"), F.coalesce(source, F.lit(""))).alias(
                    "_source"
                ),
                shuffle_key(seed, key).alias("_shuffle"),
                F.lit(1).cast("long").alias("_one"),
            )
        ),
        "digest",
    )
    tie = ["_shuffle", "size", "text_crc32", "_row"]
    ranked = running_sum(rows, tie, "_one", "_before", ["_source"], "_count").withColumn(
        "_fraction", (2 * F.col("_before") + 1) / (2 * F.col("_count"))
    )
    ordered = running_sum(ranked, ["_fraction", "_source", *tie], "_one", "_position")
    total = max(rows.count(), 1)
    # whole numbers only: position * shards stays below 2^63 for any table Spark can hold
    shard = F.expr(f"(_position * {shards}L) div {total}L").alias("shard")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        ordered.select("_doc", "size", "text_crc32", "_position", shard)
        .withColumn("slot", F.col("_position") - first)
        .withColumn("shard", F.col("shard").cast("int"))
        .drop("_position")
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id",
    text: str = "text", source: str = "source",
) -> None:
    """Write the rows of ``docs`` as Parquet folders ``shard=n``, each in the order of its slots.

    The texts are shuffled once, by (shard, slot).
    """
    rows = addressed(docs)
    slim = rows.select("_id", *[F.col("_all")[c].alias(c) for c in (key, text, source)])
    places = interleaved(slim, shards, seed, key, text, source).select(
        F.col("_doc")["_id"].alias("_id"), "shard", "slot"
    )
    (
        rows.join(places, "_id")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("shard", "slot", F.col("_all").alias("row"))
        .write.partitionBy("shard")
        .parquet(path)
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return interleaved(docs).select(
        F.col("_doc")["doc_id"].alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_doc")["source"].alias("source"),
    )


#: CRC-32 is worked out bit by bit, as DuckDB has no function for it.
SQL = f"""
WITH h AS (
  SELECT *, hex(encode(coalesce(text, ''))) AS x, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-')) AS k
  FROM documents
), d AS (
  SELECT doc_id, source, k, (length(x) // 2 + 8)::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
               lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
             lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS text_crc32
  FROM h
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, size, text_crc32, doc_id) - 1 AS before,
         count(*) OVER (PARTITION BY source) AS n FROM d
), o AS (
  SELECT *, row_number() OVER (ORDER BY (2 * before + 1) / (2 * n), source NULLS LAST, k, size,
                               text_crc32, doc_id) - 1 AS position, count(*) OVER () AS total FROM r
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * {SHARDS} // total)::INT AS shard,
       (position - ((position * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot,
       NULL::INT AS grown_shard, source
FROM o
"""
