"""Views brought up to date after an upsert, by computing again only what the change reaches.

A changed, new or removed month reaches the rows that look back at it: the same month a year later where
the view compares by calendar, the next rows that are present where it counts rows. The rows it reaches
are computed from their own months and those they look back at; all others are taken over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lunario.plans import views
from lunario.plans.views import Keys, Tables


def changed_rows(before: DataFrame, after: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, fecha) of the rows that differ between two states of a table."""
    on = [*keys, "fecha"]
    rest = [c for c in after.columns if c not in on]

    def named(df: DataFrame) -> DataFrame:
        return df.select(*on, F.struct(*rest).alias("_row"))

    a, b = named(before), named(after).withColumnRenamed("_row", "_new")
    both = a.join(b, on, "full_outer")
    return both.filter(~F.col("_row").eqNullSafe(F.col("_new"))).select(*on).distinct()


def reached_by_calendar(touched: DataFrame, months: Sequence[int], keys: Keys = ()) -> DataFrame:
    """Rows a change reaches, ``months`` later each (0: the row itself), and those they look back at.

    Columns: keys, ``fecha``, ``reached`` (false for rows that are only looked back at).
    """
    later = [touched.select(*keys, F.add_months("fecha", m).alias("fecha")) for m in months]
    reached = reduce(DataFrame.unionByName, later).distinct()
    earlier = [reached.select(*keys, F.add_months("fecha", -m).alias("fecha")) for m in months if m]
    needed = reduce(DataFrame.unionByName, earlier) if earlier else reached.limit(0)
    return _either(reached, needed, keys)


def _either(reached: DataFrame, needed: DataFrame, keys: Keys) -> DataFrame:
    marked = reached.withColumn("reached", F.lit(True)).unionByName(
        needed.withColumn("reached", F.lit(False))
    )
    return marked.groupBy(*keys, "fecha").agg(F.bool_or("reached").alias("reached"))


def reached_by_rows(
    present: DataFrame, touched: DataFrame, rows: int, keys: Keys = ()
) -> DataFrame:
    """As ``reached_by_calendar`` where a row looks ``rows`` present rows back.

    ``present`` has the rows of the series as it is now; a touched date may be missing from it, and
    then it reaches the ``rows`` rows after it all the same. A series is bounded by the calendar.
    """
    on = [*keys, "fecha"]
    points = (
        present.select(*on).distinct().withColumns({"_here": F.lit(1), "_hit": F.lit(0)})
        .unionByName(touched.select(*on).distinct().withColumns({"_here": F.lit(0), "_hit": F.lit(1)}))
        .groupBy(*on)
        .agg(F.max("_here").alias("_here"), F.max("_hit").alias("_hit"))
    )
    series = Window.partitionBy(*keys).orderBy("fecha")
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    ahead = series.rowsBetween(0, Window.unboundedFollowing)
    placed = points.withColumn("_n", F.sum("_here").over(so_far))
    # rows before the last touched date, so that the distance of a row itself is one
    last = F.max(F.when(F.col("_hit") == 1, F.col("_n") - F.col("_here"))).over(so_far)
    reached = placed.withColumn("reached", F.coalesce(F.col("_n") - last <= rows + 1, F.lit(False)))
    following = F.min(F.when(F.col("reached"), F.col("_n"))).over(ahead)
    return (
        reached.withColumn("_needed", F.coalesce(following - F.col("_n") <= rows, F.lit(False)))
        .filter("reached OR _needed")
        .select(*on, "reached")
    )


def renewed(
    view: Callable[[Tables], DataFrame], tables: Tables, stored: DataFrame, reach: DataFrame,
    touched: DataFrame, keys: Keys = (),
) -> DataFrame:
    """The stored result of a view with the reached rows computed from ``tables`` as they are now."""
    on = [*keys, "fecha"]
    part = {name: df.join(reach.select(*on), on, "left_semi") for name, df in tables.items()}
    anew = view(part).join(reach.filter("reached").select(*on), on, "left_semi")
    gone = reach.filter("reached").select(*on).unionByName(touched.select(*on)).distinct()
    return stored.join(gone, on, "left_anti").unionByName(anew.select(*stored.columns))


def refresh_us_inflation(
    tables: Tables, stored: DataFrame, touched: DataFrame, keys: Keys = ()
) -> DataFrame:
    """K4: a month is compared with the same month a year before."""
    reach = reached_by_calendar(touched, (0, 12), keys)
    return renewed(lambda t: views.us_inflation(t, keys), tables, stored, reach, touched, keys)


def refresh_reserve_coverage(
    tables: Tables, stored: DataFrame, touched: DataFrame, keys: Keys = ()
) -> DataFrame:
    """K10: a month that has all three tables is compared with the twelfth such row before it."""
    on = [*keys, "fecha"]
    present = tables["rin"].select(*on).join(tables["tc"].select(*on), on).join(
        tables["bm"].select(*on), on
    )
    reach = reached_by_rows(present, touched, 12, keys)
    return renewed(lambda t: views.reserve_coverage(t, keys), tables, stored, reach, touched, keys)


def refresh_crawl(
    tables: Tables, stored: DataFrame, touched: DataFrame, keys: Keys = ()
) -> DataFrame:
    """The yearly crawl of every month that has both tables (``views.yearly_crawl``)."""
    on = [*keys, "fecha"]
    present = tables["ipc"].select(*on).join(tables["tc"].select(*on), on)
    reach = reached_by_rows(present, touched, 12, keys)
    return renewed(lambda t: views.yearly_crawl(t, keys), tables, stored, reach, touched, keys)


def refresh_crawl_gap(
    crawl_before: DataFrame, crawl: DataFrame, stored: DataFrame, keys: Keys = ()
) -> DataFrame:
    """K6 from the crawl before and after: a row looks at the one before that has a crawl.

    The look-back is in two steps, as months without a crawl are left out between them: a change
    reaches twelve present rows of the first step, and from there one row of the second.
    """
    on = [*keys, "fecha"]
    touched = changed_rows(crawl_before, crawl, keys)
    present = crawl.filter(F.col("deslizamiento_anual").isNotNull()).select(*on)
    reach = reached_by_rows(present, touched, 1, keys)
    return renewed(
        lambda t: views.gap_of_crawl(t["crawl"], keys), {"crawl": crawl}, stored, reach, touched, keys
    )
