from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lunario.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def water(sizes, weights, share=1.5, passes=2.0):
    """Targets by repeated resharing."""
    total, full = share * sum(sizes), set()
    while True:
        rest = total - sum(passes * sizes[n] for n in full)
        level = rest / max(1e-300, sum(w for n, w in enumerate(weights) if n not in full))
        more = {n for n in range(len(sizes)) if n not in full and weights[n] * level > passes * sizes[n]}
        if not more:
            return [passes * s if n in full else weights[n] * level for n, s in enumerate(sizes)]
        full |= more


def test_targets_are_those_of_repeated_resharing(spark):
    rng = random.Random(1)
    for count in (1, 2, 7, 20):
        sizes = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(count)]
        df = spark.createDataFrame([(f"s{n:02d}", s) for n, s in enumerate(sizes)],
                                   "_source string, source_size long")
        found = [r.target for r in mixing.targets(df).orderBy("_source").collect()]
        expected = water(sizes, [(5, 2, 1)[n % 3] for n in range(count)])
        assert found == pytest.approx(expected, abs=1e-6)


def test_taken_words_come_near_their_target(spark):
    rng = random.Random(2)
    rows = [
        (n, None if n % 50 == 0 else " ".join("w" * rng.randrange(1, 40)), rng.choice("aaaabc") or None)
        for n in range(900)
    ] + [(1000 + n, "x y z", None) for n in range(30)]
    found = mixing.mixed(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    taken, target, largest = {}, {}, {}
    for r in found:
        s = r["_doc"]["source"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s], largest[s] = r.target, max(largest.get(s, 0), r["size"])
        assert r.taken == r.copies * r["size"] and r.taken <= 2 * r["size"]
        assert len(r.times) == r.copies and all(0 <= t <= 1 for t in r.times)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in found))
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-9


@pytest.mark.parametrize("knots", [*mixing.SCHEDULES, ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 2.0))])
def test_training_time_inverts_the_demand(spark, knots):
    def demand(t, steps=20_000):
        def weight(x):
            for (a, u), (b, v) in zip(knots, knots[1:]):
                if x <= b:
                    return u + (v - u) * (x - a) / (b - a)
            return knots[-1][1]
        return sum(weight((n + 0.5) / steps) for n in range(int(t * steps))) / sum(
            weight((n + 0.5) / steps) for n in range(steps))

    shares = [0.0, 0.1, 0.3, 0.5, 0.77, 1.0]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    times = [r.t for r in df.select("s", mixing.training_time(F.col("s"), knots).alias("t"))
             .orderBy("s").collect()]
    assert [demand(t) for t in times] == pytest.approx(shares, abs=2e-3)


def test_mixture_is_in_training_order(spark):
    rows = [(n, "w " * (n % 7 + 1), "ab"[n % 2]) for n in range(120)]
    df = frame(spark, rows).withColumns({"_time": F.lit(3), "copies": F.lit("c"), "_id": F.lit(0)})
    mix = mixing.mixture(df)
    assert mix.columns == df.columns
    times = {r["_doc"]["doc_id"]: r.times for r in mixing.mixed(df).collect()}
    order = [r.doc_id for r in mix.collect()]
    assert sorted(order) == sorted(d for d, t in times.items() for _ in t)
    flat = sorted((t, d) for d, ts in times.items() for t in ts)
    assert [t for t, _ in flat] == sorted(t for ts in times.values() for t in ts)
    assert order[0] in {d for t, d in flat if t == flat[0][0]}


def test_query_makes_the_training_order(spark, monkeypatch):
    tables, write = {}, mixing.written

    def keep(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(mixing, "written", keep)
    result = mixing.query(spark, "/root/testdata/sf0.001").collect()
    times = {r["_row"]: r.times for r in tables["mix"].collect()}
    expected = sorted((t, row, n) for row, ts in times.items() for n, t in enumerate(ts))
    found = tables["training-order"].orderBy("position").collect()
    assert [(r["_time"], r["_row"], r["_copy"]) for r in found] == expected
    assert [r.position for r in found] == list(range(len(found)))
    assert sum(r.copies for r in result) == len(found) and len(result) == len(times)


def test_odd_tables(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.mixture(frame(spark, [])).count() == 0
    blank = mixing.mixed(frame(spark, [(None, None, None), (1, " \n", "a"), (2, "", "a")])).collect()
    assert [r.taken for r in blank] == [0, 0, 0]
    repeated = mixing.mixed(frame(spark, [(1, "a b", "s")] * 40)).collect()
    assert sum(r.taken for r in repeated) == 120
    with pytest.raises(ValueError):
        mixing.training_time(F.lit(0.5), ((0.0, 1.0),))


def test_repeated_rows_of_a_stored_table(spark, tmp_path):
    """A joined table's repeated rows are mixed one by one, not multiplied by each other."""
    rows = [(n, "w " * 4, "ab"[n % 2]) for n in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    twice = stored.join(spark.createDataFrame([(n,) for n in range(20)] * 2, "doc_id long"), "doc_id")
    words = 4 * mixing.mixture(twice).count()
    assert abs(words - 1.5 * 4 * 40) <= 2 * 4
