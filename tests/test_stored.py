"""Files with faults, stored tables changed in place, published versions, views that outlive a session."""

from __future__ import annotations

import random
from datetime import date
from pathlib import Path

import pytest
from compare import same
from pyspark.sql import functions as F

from lunario.plans import kept, refresh, stored, view_sql, views
from lunario.plans.catalog import VIEWS
from lunario.operators import last_non_blank
from lunario.operators.upkeep import unique_rows
from lunario.sources.files import (
    read_checked_table,
    read_semicolon_table,
    read_rate_report,
    write_lines,
    write_semicolon_table,
)
from lunario.sources.schemas import TABLES
from lunario.sources.tables import append, read_generations, snapshot
from lunario.workload import derive
from lunario.workload import stored as workload
from lunario.workload.derive import base_tables
from lunario.workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def partitions(path):
    return {p.name: {f.name: f.stat().st_mtime_ns for f in p.glob("*.parquet")} for p in Path(path).iterdir() if p.is_dir()}


# --- files ------------------------------------------------------------------------------------


def test_every_sign_of_the_code_page(spark, tmp_path):
    """A file made elsewhere in code page 1252 reads as Python reads it; what is written is that page."""
    own = bytes(n for n in range(0x20, 0x100) if bytes([n]).decode("cp1252", "ignore") and n not in b';"\\')
    (tmp_path / "in.csv").write_bytes(b"1;" + own + b"\n2;plain\n")
    read = read_semicolon_table(spark, str(tmp_path / "in.csv"), "n int, t string")
    expected = [(1, own.decode("cp1252").strip(" ")), (2, "plain")]
    assert [(n, t.strip(" ")) for n, t in rows_of(read)] == expected
    write_semicolon_table(read, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert own.strip() in data
    assert rows_of(read_semicolon_table(spark, str(tmp_path / "out"), "n int, t string")) == rows_of(read)


def test_rate_report_in_the_code_page(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("2024;\nEnero “1”;4,5 €\n".encode("cp1252"))
    assert [r.fecha for r in read_rate_report(spark, str(tmp_path / "r.csv")).orderBy("linea").collect()] == [
        "2024", "Enero “1”"
    ]


CHECKED = [
    ('1,a,2.5', None), ('2,"b, c",3', None), ('3,"d ""e""",', None), (',,', None), ('4,é € ñ,1e3', None),
    ('5,f', "faltan campos"), ('6', "faltan campos"), ('7,g,1,h', "sobran campos"),
    ('8,"i,9', "comillas sin cerrar"), ('9,j","k,1', None), ('x,l,1', "valor ilegible"),
    ('10,m,uno', "valor ilegible"), ('11,"n, o, p"', "faltan campos"), ('12,q,1,,', "sobran campos"),
    ('13,r,"1', "comillas sin cerrar"), ('14,s\x1ft,1', None),
]


def test_bad_lines_are_set_apart(spark, tmp_path):
    lines = [line for line, _ in CHECKED if not line.startswith("9,")]
    (tmp_path / "a.csv").write_text("n,t,v\n" + "\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("n,t,v\n\n20,z,1\n", encoding="utf-8")
    read = read_checked_table(spark, str(tmp_path), "n int, t string, v double")
    reasons = {line: why for line, why in CHECKED if why}
    assert {r.texto: r.motivo for r in read.rejected.collect()} == reasons
    assert {(r.n, r.v) for r in read.good.collect()} == {
        (1, 2.5), (2, 3.0), (3, None), (None, None), (4, 1000.0), (14, 1.0), (20, 1.0)
    }
    texts = {r.n: r.t for r in read.good.collect()}
    assert texts[2] == "b, c" and texts[4] == "é € ñ" and texts[14] == "s\x1ft"
    assert {r.archivo.rsplit("/", 1)[1] for r in read.rejected.collect()} == {"a.csv"}
    only = read.good.select("n")  # a fault in a column that is not asked for still counts
    assert only.count() == 7


def test_checked_read_of_no_lines_and_of_many_splits(spark, tmp_path):
    (tmp_path / "none.csv").write_text("n,t\n")
    empty = read_checked_table(spark, str(tmp_path / "none.csv"), "n int, t string")
    assert empty.good.count() == 0 and empty.rejected.count() == 0
    lines = spark.range(20_000).select(
        F.when(F.col("id") % 7 == 0, F.concat("id", F.lit(",x,y"))).otherwise(F.concat("id", F.lit(",x"))).alias("l")
    )
    write_lines(lines.coalesce(1), str(tmp_path / "many"), "n,t")
    with workload.small_splits(spark):
        read = read_checked_table(spark, str(tmp_path / "many"), "n int, t string")
        assert read.rejected.select("bloque").distinct().count() > 1
        assert (read.good.count(), read.rejected.count()) == (17_142, 2_858)


def test_the_load_job_reads_many_splits(spark, monkeypatch):
    seen = []
    plain = workload.load_aggregate_csv

    def spied(spark, path, held, new):
        from lunario.sources.files import read_aggregate_report

        seen.append(read_aggregate_report(spark, path).select("archivo", "bloque").distinct().count())
        return plain(spark, path, held, new)

    monkeypatch.setattr(workload, "load_aggregate_csv", spied)
    monkeypatch.setattr(workload, "SPLIT_BYTES", 1 << 13)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    QUERIES["j_load_csv"](spark, SF_DIR).collect()
    assert seen[0] > 20 and spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_the_rate_files_grow_in_number(spark, monkeypatch):
    seen = []
    plain = workload.load_rate_csv

    def spied(spark, path, new):
        seen.append(len(spark.read.text(path).inputFiles()))
        return plain(spark, path, new)

    monkeypatch.setattr(workload, "load_rate_csv", spied)
    size = derive.bytes_of(spark, f"{SF_DIR}/lineitem.parquet")
    whole = rows_of(QUERIES["j7_load_rates"](spark, SF_DIR))
    # ten suppliers, so no more than ten ranges have lines
    monkeypatch.setattr(derive, "SPREAD_BYTES", size / 40)
    assert rows_of(QUERIES["j7_load_rates"](spark, SF_DIR)) == whole
    assert seen[1] == 10


# --- stored tables ----------------------------------------------------------------------------


def months(spark, rows):
    return spark.createDataFrame(
        [(k, date(2020, m, 1) if m else None, v) for k, m, v in rows], "k long, fecha date, v double"
    )


ROWS = [(1, 1, 1.0), (2, 1, None), (1, 2, 3.0), (2, 2, 4.0), (1, 3, 5.0), (2, 4, 6.0), (3, None, 7.0)]


def test_delete_rewrites_only_the_months_concerned(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.store(months(spark, ROWS), path)
    before = partitions(path)
    condition = (F.col("v") == 4) | (F.col("v") == 5)
    touched = stored.delete_stored(spark, path, condition, str(tmp_path / "s"))
    assert sorted(touched) == [date(2020, 2, 1), date(2020, 3, 1)]
    after = partitions(path)
    assert "fecha=2020-03-01" not in after  # emptied
    for name in set(before) - {"fecha=2020-02-01", "fecha=2020-03-01"}:
        assert before[name] == after[name]
    kept_rows = [r for r in ROWS if r[2] not in (4.0, 5.0)]
    assert rows_of(spark.read.parquet(path).select("k", "fecha", "v")) == rows_of(months(spark, kept_rows))
    assert stored.delete_stored(spark, path, F.col("v") > 100, str(tmp_path / "s2")) == []
    stored.delete_stored(spark, path, F.col("fecha").isNull() | (F.col("v") == 1), str(tmp_path / "s3"))
    assert spark.read.parquet(path).count() == 3


def test_a_delete_that_failed_is_mended_by_another(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    stored.store(months(spark, ROWS), path)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(stored, "remove_periods", fail)
        with pytest.raises(OSError):
            stored.delete_stored(spark, path, F.month("fecha") == 3, str(tmp_path / "s"))
    stored.delete_stored(spark, path, F.month("fecha") == 3, str(tmp_path / "s2"))
    assert rows_of(spark.read.parquet(path).select("k", "fecha", "v")) == rows_of(
        months(spark, [r for r in ROWS if r[1] != 3])
    )


def test_update_rewrites_only_the_months_of_the_source(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.store(months(spark, ROWS), path)
    before = partitions(path)
    source = months(spark, [(1, 1, 10.0), (9, 1, 1.0), (2, 4, None)])
    touched = stored.update_stored(
        spark, path, source, ["k", "fecha"], {"v": F.col("new_v")}, ["v"], str(tmp_path / "s")
    )
    assert sorted(touched) == [date(2020, 1, 1), date(2020, 4, 1)]
    expected = [(1, 1, 10.0), (2, 1, None), (1, 2, 3.0), (2, 2, 4.0), (1, 3, 5.0), (2, 4, None), (3, None, 7.0)]
    assert rows_of(spark.read.parquet(path).select("k", "fecha", "v")) == rows_of(months(spark, expected))
    after = partitions(path)
    assert all(before[n] == after[n] for n in ("fecha=2020-02-01", "fecha=2020-03-01"))
    twice = months(spark, [(1, 1, 1.0), (1, 1, 2.0)])
    with pytest.raises(Exception, match="twice"):
        stored.update_stored(spark, path, twice, ["k", "fecha"], {"v": F.col("new_v")}, ["v"], str(tmp_path / "x"))
    assert rows_of(spark.read.parquet(path).select("k", "fecha", "v")) == rows_of(months(spark, expected))
    with pytest.raises(ValueError):
        stored.update_stored(spark, path, twice, ["k"], {}, ["v"], str(tmp_path / "y"))


def test_a_rejected_version_never_becomes_current(spark, tmp_path):
    folder = str(tmp_path / "v")
    with pytest.raises(ValueError, match="nothing"):
        stored.current(spark, folder)
    good = months(spark, [r for r in ROWS if r[1]])
    assert stored.publish(good, folder, ["k", "fecha"]) == 1
    with pytest.raises(stored.Rejected, match="1 in fecha") as found:
        stored.publish(months(spark, ROWS), folder, ["k", "fecha"])
    assert (found.value.rows, found.value.nulls) == (7, {"k": 0, "fecha": 1})
    with pytest.raises(Exception, match="twice"):
        stored.publish(good.unionByName(good), folder, ["k", "fecha"])
    assert rows_of(stored.current(spark, folder)) == rows_of(good)
    assert stored.publish(good.limit(0), folder, ["k", "fecha"]) == 4
    assert stored.current(spark, folder).count() == 0


def test_rows_with_nulls_are_counted_also_where_they_share_a_key(spark, tmp_path):
    folder = str(tmp_path / "v")
    stored.publish(months(spark, [(1, 1, 1.0)]), folder, ["k", "fecha"])
    twice = [(1, None, 5.0), (1, None, 5.0), (2, None, None), (2, None, None), (1, 1, None)]
    with pytest.raises(stored.Rejected) as found:
        stored.publish(months(spark, twice), folder, ["k", "fecha", "v"], ["fecha"])
    assert (found.value.rows, found.value.nulls) == (5, {"fecha": 4})
    assert spark.read.parquet(f"{folder}/v2").count() == 5  # none is left out of what is kept beside
    with pytest.raises(stored.Rejected) as found:  # a required column that is no key
        stored.publish(months(spark, [(1, 1, None), (1, 1, 2.0)]), folder, ["k", "fecha"], ["v"])
    assert (found.value.rows, found.value.nulls) == (2, {"v": 1})
    for rows in (twice + [(3, 3, 1.0)] * 2, [(1, 1, None)] * 2):  # complete rows still may not
        with pytest.raises(Exception, match="twice"):
            stored.publish(months(spark, rows), folder, ["k", "fecha", "v"], ["fecha"])
    assert rows_of(stored.current(spark, folder)) == rows_of(months(spark, [(1, 1, 1.0)]))


def test_rows_without_any_key_are_not_one_group(spark, tmp_path):
    lost = spark.range(4000, numPartitions=4).select(F.lit(None).cast("long").alias("k"), "id")
    groups = unique_rows(lost, ["k"], ["k"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = groups.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) > 1 and sum(r["count"] for r in counts) == 4000
    assert groups.columns == ["k", "id"]


def test_the_counts_come_from_the_job_that_writes(spark, tmp_path):
    """One job over the data: the source is evaluated once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = months(spark, [r for r in ROWS if r[1]])
    stored.publish(df.mapInPandas(count, df.schema), str(tmp_path / "v"), ["k", "fecha"])
    assert seen.value == 6


def test_generations(spark, tmp_path):
    path = str(tmp_path / "g")
    append(spark.createDataFrame([(1,)], "a int"), path)
    append(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    assert rows_of(read_generations(spark, path, "a int, b string, c double")) == [(1, None, None), (2, "x", None)]
    with pytest.raises(ValueError, match="b is string"):
        read_generations(spark, path, "a int, b double")
    with pytest.raises(ValueError, match="not declared"):
        read_generations(spark, path, "a int")
    append(spark.createDataFrame([("3",)], "a string"), path)
    with pytest.raises(ValueError, match="disagree"):
        read_generations(spark, path, "a int, b string")


@pytest.fixture(scope="module")
def national(spark, tmp_path_factory):
    names = [n for n in TABLES if n not in ("dim_monedas",)]
    folder = tmp_path_factory.mktemp("national")
    paths = {}
    for name, df in base_tables(spark, SF_DIR, *names).items():
        paths[name] = str(folder / name)
        snapshot(df, paths[name])
    return paths


def test_all_views_outlive_the_session(spark, national):
    made = view_sql.create(spark, "indicadores", national, "1995-01-01")
    assert sorted(made) == sorted(VIEWS) and len(made) == 12
    other = spark.newSession()
    other.sql("CREATE OR REPLACE TEMP VIEW ipc AS SELECT 1 AS fecha")  # does not get in the way
    tables = {name: spark.read.parquet(path) for name, path in national.items()}
    for name, (view, _) in VIEWS.items():
        df = view(tables, "1995-01-01") if view is views.real_exchange_rate else view(tables)
        theirs = other.sql(f"SELECT * FROM indicadores.{name}")
        assert theirs.columns == df.columns, name
        mine, found = rows_of(df.select(*df.columns)), rows_of(theirs)
        assert len(mine) == len(found) > 0, name
        order = sorted(range(len(df.columns)), key=lambda n: df.dtypes[n][1] not in ("date", "string"))
        mine, found = (sorted(x, key=lambda r: [str(r[n]) for n in order if df.dtypes[n][1] in ("date", "string")]) for x in (mine, found))
        for a, b in zip(mine, found):
            assert all(same(x, y) for x, y in zip(a, b)), (name, a, b)
    spark.sql("DROP DATABASE indicadores CASCADE")


def test_views_can_be_replaced_and_left_out(spark, national):
    some = {n: national[n] for n in ("bm", "credito")}
    for _ in range(2):
        assert view_sql.create(spark, "parte", some) == ["vw_exposicion_externa", "vw_crowding_out_spnf"]
    assert spark.catalog.currentDatabase() == "default"
    spark.sql("DROP DATABASE parte CASCADE")


def test_stored_inflation_is_used(spark, national, tmp_path):
    ipc = spark.read.parquet(national["ipc"]).withColumn("inflacion_calculada", F.lit(1).cast("decimal(18,6)"))
    path = str(tmp_path / "ipc")
    snapshot(ipc, path)
    view_sql.create(spark, "fijada", national | {"ipc": path})
    r = spark.sql("SELECT min(mn - tasa_real_mn) a, max(mn - tasa_real_mn) b FROM fijada.vw_paridad_real_de_tasas JOIN "
                  "(SELECT fecha, tipo_tasa, plazo, max(tasa_porcentaje) mn FROM fijada.tasas_interes_bcn "
                  "WHERE moneda = 'MN' GROUP BY ALL) USING (fecha, tipo_tasa, plazo)").first()
    assert r.a == pytest.approx(1) and r.b == pytest.approx(1)
    spark.sql("DROP DATABASE fijada CASCADE")


def read_partitions(df):
    """Partitions that the scans of an executed query read."""
    df.collect()
    todo, seen = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet") and node.metrics().contains("numPartitions"):
            seen.append(node.metrics().apply("numPartitions").value())
        children = node.children()
        todo += [children.apply(n) for n in range(children.size())]
    return seen


def test_the_calendar_prunes_the_scan(spark):
    df = workload.pruned_months(spark, SF_DIR)
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
    assert read_partitions(df) == [3]


# --- kept figures and refreshed views ---------------------------------------------------------


def test_kept_figures_after_random_merges(spark, tmp_path):
    rng = random.Random(1)
    table, state = str(tmp_path / "t"), str(tmp_path / "st")
    held = {(k, m): rng.choice([None, float(m)]) for k in range(4) for m in range(1, 9)}

    def frame(rows):
        return months(spark, [(k, m, v) for (k, m), v in rows.items()])

    stored.store(frame(held), table)
    kept.keep_state(spark, table, state, "v", ["k"])
    for n in range(3):
        change = {(k, m): rng.choice([None, float(n)]) for k in range(4) for m in rng.sample(range(1, 13), 3)}
        if n == 2:
            change |= {(k, m): None for k in range(4) for m in (11, 12)}
        held |= change
        path = str(tmp_path / f"s{n}")
        workload.merge_periods(spark, frame(change), table, path, ["k"])
        touched = {date(2020, m, 1) for _, m in change}
        before = partitions(state)
        kept.renew_state(spark, table, state, touched, str(tmp_path / f"x{n}"), "v", ["k"])
        after = partitions(state)
        for name in set(before) | set(after):
            if date.fromisoformat(name.removeprefix("fecha=")) not in touched:
                assert before.get(name) == after.get(name)
        assert rows_of(kept.last_known(spark, state, ["k"])) == rows_of(last_non_blank(frame(held), "v", keys=["k"]))


def series_of(rng, months_left):
    return {
        (k, m): (round(rng.uniform(0, 9), 2) if rng.random() > 0.1 else rng.choice([None, 0.0]))
        for k in (1, 2) for m in months_left
    }


def as_table(spark, rows, column):
    made = [(k, date(2000 + m // 12, m % 12 + 1, 1), v) for (k, m), v in rows.items()]
    return spark.createDataFrame(made, f"k long, fecha date, {column} double")


@pytest.mark.parametrize("seed", range(4))
def test_refreshed_views_are_the_full_ones(spark, seed):
    """Changed, removed and inserted months, NULL and zero values, series with gaps."""
    rng = random.Random(seed)
    base = [m for m in range(60) if rng.random() > 0.15]
    was = {n: series_of(rng, base) for n in ("cpi_usa", "tc", "inflacion_interanual", "rin", "m1")}
    now = {n: dict(rows) for n, rows in was.items()}
    for rows in now.values():
        for k in (1, 2):
            for m in rng.sample(range(60), 2):
                action = rng.random()
                if action < 0.3:
                    rows.pop((k, m), None)
                else:
                    rows[k, m] = rng.choice([None, 0.0, round(rng.uniform(0, 9), 2)])

    def tables(rows):
        made = {n: as_table(spark, rows[n], n) for n in ("cpi_usa", "tc", "rin")}
        made["ipc"] = as_table(spark, rows["inflacion_interanual"], "inflacion_interanual")
        money = as_table(spark, rows["m1"], "m1")
        made["bm"] = money.select("k", "fecha", *[
            F.col("m1").cast("decimal(18,4)").alias(a) for a in views.AGGREGATES
        ])
        return made

    a, b = tables(was), tables(now)

    def touched(*names):
        found = [refresh.changed_rows(a[n], b[n], ["k"]) for n in names]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df).distinct()
        return out

    k4 = refresh.refresh_us_inflation(b, views.us_inflation(a, ["k"]), touched("cpi_usa"), ["k"])
    assert rows_of(k4) == rows_of(views.us_inflation(b, ["k"]))
    k10 = refresh.refresh_reserve_coverage(
        b, views.reserve_coverage(a, ["k"]), touched("rin", "tc", "bm"), ["k"]
    )
    assert rows_of(k10) == rows_of(views.reserve_coverage(b, ["k"]))
    crawl_a = views.yearly_crawl(a, ["k"])
    crawl = refresh.refresh_crawl(b, crawl_a, touched("ipc", "tc"), ["k"])
    assert rows_of(crawl) == rows_of(views.yearly_crawl(b, ["k"]))
    k6 = refresh.refresh_crawl_gap(crawl_a, crawl, views.gap_of_crawl(crawl_a, ["k"]), ["k"])
    assert rows_of(k6) == rows_of(views.crawl_gap(b, ["k"]))


def test_a_refresh_reaches_few_rows(spark):
    """One changed month among 300 reaches thirteen rows and reads twelve before them."""
    present = as_table(spark, {(1, m): 1.0 for m in range(300)}, "v").select("k", "fecha")
    touched = present.filter(F.col("fecha") == F.lit("2010-01-01").cast("date"))
    reach = refresh.reached_by_rows(present, touched, 12, ["k"])
    assert (reach.filter("reached").count(), reach.count()) == (13, 25)
