"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters. Equal blocks get one integer
name, their rank in sorted order; then adjacent names are paired and the pairs named the same way,
level after level, until every document has one name. A name at a level stands for exactly one
sequence of blocks, so (level, name) is an identity without collisions.

Blocks are sorted by (64-bit hash, block). The hash alone decides nearly everywhere, so only whole
numbers travel in the naming rounds; where two different blocks share a hash, the block text breaks
the tie. The text itself is shuffled once, to find the distinct blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.common import BLANK, addressed, numbered, running_sum, written

#: Characters of a block. Most documents are one or two blocks; a longer block would make the rows
#: of the first naming too large, a shorter one adds levels.
BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """Text without blank characters; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", "")


def blocks(text: Column, chars: int) -> Column:
    """Array of consecutive blocks, cut in one pass over the text; an empty one has an empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _names(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows with ``name``: their rank in ``order``."""
    return running_sum(distinct.withColumn("_one", F.lit(1)), order, "_one", "name").drop("_one")


def block_hash(block: Column) -> Column:
    """Sort prefix of a block; only speed depends on how rarely it repeats."""
    return F.xxhash64(block)


def _block_names(texts: DataFrame, chars: int) -> tuple[DataFrame, DataFrame]:
    """Names of the distinct blocks: by hash where it is unambiguous, else by hash and block."""
    block = texts.select(F.explode(blocks(F.col("_text"), chars)).alias("_block"))
    # the hash is part of the key for the sake of the next step; the block itself decides equality
    distinct = block.groupBy(block_hash(F.col("_block")).alias("_hash"), "_block").agg(
        F.count(F.lit(1)).alias("_uses")
    )
    hashes = written(distinct.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")), "hashes")
    shared = hashes.filter("_n > 1").select("_hash")
    if shared.isEmpty():
        tied = texts.sparkSession.range(0).selectExpr("id AS _hash", "string(id) AS _block")
    else:
        tied = written(distinct.join(shared, "_hash", "left_semi").select("_hash", "_block"), "tied")
    # a tie is numbered inside its hash; blocks of one hash are as few as 64-bit collisions
    tie = Window.partitionBy("_hash").orderBy("_block")
    ties = tied.withColumn("_tie", F.row_number().over(tie).cast("long"))
    keys = hashes.filter("_n = 1").select("_hash", F.lit(0).cast("long").alias("_tie")).unionByName(
        ties.select("_hash", "_tie")
    )
    named = written(_names(keys, ["_hash", "_tie"]), "names-0")
    return (
        named.filter("_tie = 0").select("_hash", "name"),
        named.filter("_tie > 0").join(ties, ["_hash", "_tie"]).select("_hash", "_block", "name"),
    )


def identities(docs: DataFrame, text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: its identity ``level`` and ``name``.

    The caller's columns but the text travel in the struct ``_doc``, so any names may occur. Further
    columns: ``_row`` (row number), ``_points`` (code points of the original text), ``_sha`` (digest
    of the normalised text).
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    texts = docs.select(
        F.struct(*rest).alias("_doc"),
        F.coalesce(F.char_length(F.col(text)), F.lit(0)).alias("_points"),
        normalised(F.col(text)).alias("_text"),
    )
    by_hash, by_block = _block_names(texts, chars)
    ambiguous = not by_block.isEmpty()
    cut = blocks(F.col("_text"), chars)
    rows = written(
        numbered(
            texts.select(
                "_doc",
                "_points",
                F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"),
                F.transform(cut, block_hash).alias("_hashes"),
                *([cut.alias("_blocks")] if ambiguous else []),
            )
        ),
        "rows",
    )
    parts = rows.select("_row", F.posexplode("_hashes").alias("_at", "_hash"))
    named = parts.join(by_hash, "_hash").select("_row", "_at", "name")
    if ambiguous:
        # blocks whose hash belongs to several blocks are looked up by hash and text
        exact = rows.select("_row", F.posexplode("_blocks").alias("_at", "_block")).withColumn(
            "_hash", block_hash(F.col("_block"))
        )
        named = named.unionByName(
            exact.join(by_block, ["_hash", "_block"]).select("_row", "_at", "name")
        )
    done, level = [], 0
    named = written(named, "level-0")
    while True:
        width = named.groupBy("_row").agg(F.max("_at").alias("_last"))
        single = width.filter("_last = 0").select("_row")
        done.append(
            named.filter("_at = 0")
            .join(single, "_row", "left_semi")
            .select("_row", F.lit(level).alias("level"), "name")
        )
        longer = named.join(single, "_row", "left_anti")
        pairs = written(
            longer.groupBy("_row", F.shiftright("_at", 1).alias("_at")).agg(
                F.max(F.when(F.col("_at") % 2 == 0, F.col("name"))).alias("_left"),
                # the odd one at the end pairs with -1, which is no name
                F.coalesce(F.max(F.when(F.col("_at") % 2 == 1, F.col("name"))), F.lit(-1)).alias(
                    "_right"
                ),
            ),
            f"pairs-{level}",
        )
        if pairs.isEmpty():
            break
        level += 1
        known = written(
            _names(pairs.select("_left", "_right").distinct(), ["_left", "_right"]),
            f"names-{level}",
        )
        named = written(
            pairs.join(known, ["_left", "_right"]).select("_row", "_at", "name"), f"level-{level}"
        )
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return rows.select("_row", "_doc", "_points", "_sha").join(result, "_row")


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", chars: int = BLOCK_CHARS
) -> DataFrame:
    """Which document of each group of equal normalised texts stays.

    The one with the most code points in its original text stays, then the smallest key. A NULL key
    is larger than any other. Of rows that repeat key and text, one stays. NULL, empty and
    all-blank texts are equal. Columns: ``_row``, ``_doc`` (the other columns of ``docs``),
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. An empty table gives an empty result.
    """
    named = written(identities(docs, text, chars), "identities")
    k = F.col("_doc")[key]
    named = named.withColumn(
        "_rank",
        F.struct(
            (-F.col("_points")).alias("points"), k.isNull().alias("none"), k.alias("key"), "_row"
        ),
    )
    groups = written(
        named.groupBy("level", "name").agg(
            F.min("_rank").alias("_best"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    return named.join(groups, ["level", "name"]).select(
        "_row",
        "_doc",
        F.col("_best")["key"].alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best")["_row"]).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; see ``exact_duplicates``."""
    rows = addressed(docs)
    slim = rows.select("_id", F.col("_all")[key].alias(key), F.col("_all")[text].alias(text))
    found = exact_duplicates(slim, key, text)
    # the rows that go are fewer than those that stay
    gone = found.filter("NOT kept").select(F.col("_doc")["_id"].alias("_id"))
    return rows.join(gone, "_id", "left_anti").select("_all.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs).select(
        F.col("_doc")["doc_id"].alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents
), g AS (
  SELECT body, count(*) AS group_size, min(struct_pack(a := -points, b := doc_id)) AS best
  FROM t GROUP BY body
)
SELECT doc_id, best.b AS keep_id, group_size, doc_id = best.b AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
