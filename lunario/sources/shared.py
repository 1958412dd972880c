"""The folder that driver and executors share, and the few file operations that jobs need there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir`` as a URI.

    Only in local mode, as in tests, may that be unset: a new local folder is then made and remembered
    in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lunario.tables.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lunario-tables-")
        spark.conf.set("lunario.tables.dir", folder)
    return folder if ":" in folder else f"file://{folder}"


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right inside a folder; none if it does not exist."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(place))


def bytes_of(spark: SparkSession, path: str) -> int:
    """Size of a file, or of all files in a folder."""
    place, files = _place(spark, path)
    return files.getContentSummary(place).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all it holds; nothing happens if it is gone."""
    place, files = _place(spark, path)
    files.delete(place, True)


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file; an error if it exists."""
    place, files = _place(spark, path)
    files.create(place, False).close()
