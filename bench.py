"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR is the table directory, BENCH_CPUS the number of local threads. Each query runs once
to warm up and then three times into the no-op sink; the median is reported. The ``load_`` entries
time report loads alone: the report text is rendered beforehand to a new folder under BENCH_SCRATCH,
or under the session's warehouse where that is unset.
"""

from __future__ import annotations

import json
import os
import statistics
import time
import uuid

from lunario.plans.reports import tidy_aggregates, tidy_rates
from lunario.session import build_session
from lunario.workload.derive import base_tables
from lunario.workload.queries import KEY, QUERIES
from lunario.workload.render import aggregate_report, rate_report

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINE = (
    "k1_macro_panel",
    "k2_bank_spread",
    "k4_us_inflation",
    "k6_crawl_gap",
    "k10_reserve_coverage",
    "k11_rate_parity",
    "k12_real_exchange_rate",
    "d1_spine_join",
    "e4_pivot_currency",
    "f3_yoy_calendar",
    "j6_report_tidy",
    "j8_report_upsert",
    "l1_last_non_blank",
    "l2_named_kpis",
)


def timed(df) -> float:
    start = time.perf_counter()
    df().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def report_loads(spark, folder: str):
    """Loads of stored report text, one report per customer and per supplier."""
    t = base_tables(spark, SF_DIR, "bm", "tasas_interes", keyed=True)
    aggregate_report(t["bm"], KEY).write.parquet(f"{folder}/aggregates")
    rate_report(t["tasas_interes"], KEY).write.parquet(f"{folder}/rates")

    def load(tidy, name):
        return lambda: tidy(
            spark.read.parquet(f"{folder}/{name}"), "source_row_id", KEY, block=None, keys=KEY
        )

    return {
        "load_aggregate_reports": load(tidy_aggregates, "aggregates"),
        "load_rate_reports": load(tidy_rates, "rates"),
    }


def main() -> None:
    spark = build_session("bench", cpus=CPUS)
    chosen = os.environ.get("BENCH_QUERIES", "").split()
    runs = {name: (lambda n=name: QUERIES[n](spark, SF_DIR)) for name in chosen or HEADLINE}
    seconds, spread = {}, {}
    if not chosen:
        scratch = os.environ.get("BENCH_SCRATCH") or spark.conf.get("spark.sql.warehouse.dir")
        runs |= report_loads(spark, f"{scratch.rstrip('/')}/bench-{uuid.uuid4().hex}")
    for name, df in runs.items():
        timed(df)
        runs_of_it = [timed(df) for _ in range(REPEATS)]
        seconds[name] = round(statistics.median(runs_of_it), 3)
        spread[name] = round(max(runs_of_it) - min(runs_of_it), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "spread": spread,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
