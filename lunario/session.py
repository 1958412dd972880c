"""Session set-up shared by the bench and the tests.

A cluster session keeps whatever its own configuration says; only the settings that change results
(time zone, ANSI mode) and adaptive execution are fixed here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lunario", cpus: int | None = None, **conf: str) -> SparkSession:
    """Create a session; with ``cpus`` it is a local one sized to that many threads."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
