"""CSV readers: schema declared by position, nothing inferred, files split across tasks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lunario.sources.schemas import AGGREGATE_REPORT, RATE_REPORT


# Separators, quotes and encoding of the three kinds of file.
COMMA = {"sep": ","}
#: ISO-8859-1 stands for Windows code page 1252, which Spark's reader does not accept. They agree but for
#: the bytes 0x80 to 0x9F, which ``from_code_page`` puts right.
SEMICOLON = {"sep": ";", "encoding": "iso-8859-1"}
QUOTED = {"sep": ",", "quote": '"', "enforceSchema": "true"}

#: Bytes to which code page 1252 gives a sign that ISO-8859-1 does not have, and these signs.
_OWN = [n for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore")]
PLAIN_BYTES = "".join(map(chr, _OWN))
OWN_SIGNS = bytes(_OWN).decode("cp1252")
#: Separator of a read that takes whole lines; a line that holds it is still one line.
_UNUSED = "\x1f"
#: Spark's CSV writer would cut white space at both ends of a value.
_AS_IT_IS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def from_code_page(text: Column) -> Column:
    """Text of a code-page-1252 file that was read as ISO-8859-1: euro, dashes, curly quotes, ..."""
    return F.translate(text, PLAIN_BYTES, OWN_SIGNS)


def to_code_page(text: Column) -> Column:
    """Text that, written as ISO-8859-1, is code page 1252."""
    return F.translate(text, OWN_SIGNS, PLAIN_BYTES)


def _each_text(df: DataFrame, repair) -> DataFrame:
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: repair(F.col(f"`{name}`")) for name in texts})


def read_comma_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma-separated table with one header line."""
    return spark.read.schema(schema).options(header=True, **COMMA).csv(path)


def read_semicolon_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Semicolon-separated file in code page 1252 without a header line."""
    return _each_text(spark.read.schema(schema).options(**SEMICOLON).csv(path), from_code_page)


def write_semicolon_table(df: DataFrame, path: str) -> None:
    """Semicolon-separated files in code page 1252 without a header line, to a new path."""
    writer = _each_text(df, to_code_page).write.mode("errorifexists")
    writer.options(emptyValue="", **_AS_IT_IS, **SEMICOLON).csv(path)


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """The one text column of ``lines`` as files, each with the same header line, to a new path."""
    (name,) = lines.columns
    options = {"sep": _UNUSED, "quote": "", "emptyValue": "", "escapeQuotes": "false", **_AS_IT_IS}
    named = lines if header is None else lines.withColumnRenamed(name, header)
    named.write.mode("errorifexists").options(header=header is not None, **options).csv(path)


def read_lines(spark: SparkSession, path: str, header: bool = True, **options: str) -> DataFrame:
    """``linea_texto``, every line as it is, without headers; splittable like any CSV read."""
    raw = spark.read.schema("_line string, _whole string").options(
        header=header, sep=_UNUSED, quote="", mode="PERMISSIVE", enforceSchema="true",
        columnNameOfCorruptRecord="_whole", emptyValue="", nullValue="\x00", **options
    ).csv(path)
    return raw.select(
        F.coalesce("_whole", "_line").alias("linea_texto"), "_metadata"
    )


class CheckedRead(NamedTuple):
    """Rows that fit the schema, and the lines that do not."""

    good: DataFrame
    rejected: DataFrame


def read_checked_table(
    spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
    sep: str = ",", quote: str = '"', **options: str,
) -> CheckedRead:
    """A separated table whose bad lines are set apart instead of read as NULLs.

    ``rejected`` has the file, split and line (``archivo``, ``bloque``, ``linea``), the line
    (``texto``) and the reason (``motivo``): ``comillas sin cerrar`` (an odd number of quotes),
    ``faltan campos``, ``sobran campos`` or ``valor ilegible`` (a field that does not have its type).
    An empty field is NULL and no fault. Lines end at line breaks, also inside quotes.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    wide = T.StructType([*fields, T.StructField("_bad", T.StringType())])
    lines = with_line_order(read_lines(spark, path, header, **options).select("linea_texto", "_metadata"))
    line = F.col("linea_texto")
    # quoted parts hold no separators that count
    bare = F.regexp_replace(line, f"{quote}[^{quote}]*{quote}", "")
    parsed = lines.select(
        "archivo", "bloque", "linea", "linea_texto",
        F.from_csv(
            line, wide.toDDL(),
            {"sep": sep, "quote": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        ).alias("_row"),
        (F.char_length(line) - F.char_length(F.replace(line, F.lit(quote), F.lit("")))).alias("_quotes"),
        (F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit(""))) + 1).alias("_n"),
    )
    reason = (
        F.when(F.col("_quotes") % 2 == 1, "comillas sin cerrar")
        .when(F.col("_n") < len(fields), "faltan campos")
        .when(F.col("_n") > len(fields), "sobran campos")
        .when(F.col("_row._bad").isNotNull(), "valor ilegible")
    )
    told = parsed.withColumn("motivo", reason)
    good = told.filter(F.col("motivo").isNull()).select(
        *[F.col(f"_row.`{f.name}`").alias(f.name) for f in fields]
    )
    rejected = told.filter(F.col("motivo").isNotNull()).select(
        "archivo", "bloque", "linea", F.col("linea_texto").alias("texto"), "motivo"
    )
    return CheckedRead(good, rejected)


def read_aggregate_report(spark: SparkSession, path: str) -> DataFrame:
    """Monetary-aggregate report (quoted UTF-8, one header line) with its line order."""
    raw = spark.read.schema(AGGREGATE_REPORT).options(header=True, **QUOTED).csv(path)
    return with_line_order(raw)


def read_rate_report(spark: SparkSession, path: str) -> DataFrame:
    """Interest-rate report (semicolons, no header line) with its line order."""
    lines = with_line_order(spark.read.schema(RATE_REPORT).options(**SEMICOLON).csv(path))
    own = [f.name for f in RATE_REPORT]
    return lines.withColumns({name: from_code_page(F.col(name)) for name in own})


def with_line_order(raw: DataFrame) -> DataFrame:
    """Add ``archivo``, ``bloque`` and ``linea``: file, input split and line order inside it.

    Line order is the triple: line ids grow inside a split, splits by their offset in the file.
    """
    return raw.select(
        F.col("_metadata.file_path").alias("archivo"),
        F.col("_metadata.file_block_start").alias("bloque"),
        F.monotonically_increasing_id().alias("linea"),
        *[c for c in raw.columns if c != "_metadata"],
    )
