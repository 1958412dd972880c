"""Helpers shared by the operators: the shared folder, written intermediate tables, running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the text contracts, as the inside of a regular-expression class.
BLANK = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor see, as a URI.

    It is the cluster's ``spark.checkpoint.dir``. Only in local mode, as in tests, may that be unset:
    a fresh local folder is then made and remembered in the session. What is written there stays
    until whoever owns the folder removes it, as results are read from it lazily.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "lunario.shared.dir", None
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lunario-shared-")
        spark.conf.set("lunario.shared.dir", folder)
    return folder if ":" in folder else f"file://{folder}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs only the tasks that read the files. What follows sees
    plain files, so joins on skewed keys have an exchange on both sides that AQE can split.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    into: str,
    group: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows before each one in ``order``, by ``group``.

    ``total`` names a column for the group's whole sum. The rows are range-sorted by (group, order),
    so a group of any size is spread over as many partitions as it needs; per group and partition
    one sum is carried forward. ``group`` and ``order`` must hold no NULL, and ``order`` must be
    unique but for rows that are equal in every column.
    """
    keys = [*group, *order]
    ranged = written(
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), f"ranged-{into}"
    )
    inside = ranged.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    by_group = Window.partitionBy(*[F.col(g) for g in group])
    earlier = by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = inside.select(
        *group,
        "_part",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"),
        *([F.sum("_sum").over(by_group).alias(total)] if total else []),
    )
    above = (
        Window.partitionBy(*group, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(carried, [*group, "_part"])
        .withColumn(into, F.col("_carry") + F.coalesce(F.sum(value).over(above), F.lit(0)))
        .drop("_part", "_carry")
    )


def shuffle_key(seed: int, *columns: str) -> Column:
    """Seeded pseudo-random text that depends on the named columns alone."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def numbered(df: DataFrame, into: str = "_row") -> DataFrame:
    """Add a row number that is unique, and fixed once the result is written."""
    return df.withColumn(into, F.monotonically_increasing_id())


def _one_scan(df: DataFrame) -> bool:
    """Whether ``df`` is one table read, at most filtered and projected: no row occurs twice."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def addressed(df: DataFrame) -> DataFrame:
    """``_all`` (all columns as a struct) and ``_id``, which names a row for good.

    Rows of one Parquet table, filtered and projected, are named by file and position (``file_path``
    and ``row_index``), so the table may be read again and again. Any other table (joined, exploded,
    unioned, not Parquet) is written once, and its rows are named by their place in what was written.
    """
    whole = F.struct("*").alias("_all")
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("_id")
    if _one_scan(df):
        try:
            return df.select(place, whole)
        except AnalysisException as lacking:
            if lacking.getCondition() not in (
                "UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION",
                "FIELD_NOT_FOUND",
            ):
                raise
    return written(df.select(whole), "documents").select(place, "_all")


def stored_order(df: DataFrame, into: str = "_place") -> DataFrame:
    """Add the place of each row in a written table: files by their part number, rows as they lie.

    A table that is not read from files as it is counts as written in the order of its partitions.
    """
    part = F.regexp_extract("_id.file_path", r"part-([0-9]+)[^/]*$", 1).try_cast("long")
    place = F.shiftleft(F.coalesce(part, F.lit(0).cast("long")), 32) + F.col("_id.row_index")
    return addressed(df).select("_all.*", place.alias(into))
