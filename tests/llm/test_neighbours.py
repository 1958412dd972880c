from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lunario.llm import neighbours


def frame(spark, rows, extra=None):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns(extra or {})


def brute(rows, k, every):
    usable = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = {}
    for q, v in usable.items():
        if q % every == 0:
            scored = [(-(v * w).sum(), i) for i, w in usable.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(df, k=5, every=5, **settings):
    out = {}
    for r in neighbours.nearest(df, F.col("vec_id") % every == 0, k, **settings).orderBy(
        "query_id", "rank"
    ).collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def close(a, b):
    assert {q: [i for i, _ in x] for q, x in a.items()} == {q: [i for i, _ in x] for q, x in b.items()}
    for q in a:
        assert [s for _, s in a[q]] == pytest.approx([s for _, s in b[q]], abs=1e-12)


def random_rows(n, seed=0, dim=8):
    v = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(i, x.tolist()) for i, x in enumerate(v)]


def test_small_tables_are_searched_exactly(spark):
    rows = random_rows(300)
    close(found(frame(spark, rows)), brute(rows, 5, 5))


def test_odd_vectors_ties_and_fewer_candidates(spark):
    rows = [
        (0, [1.0, 0.0]), (5, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None),
        (4, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]),
        (None, [1.0, 1.0]), (10, [-1.0, 0.0]), (10, [-1.0, 0.0]), (12, [1.0, 0.0]),
    ]
    df = frame(spark, rows, {"code": F.lit(1), "rank": F.lit("r"), "vector": F.lit(0)})
    close(found(df), brute(rows, 5, 5))
    assert found(df.limit(0)) == {}
    assert found(df.filter("vec_id = 0")) == {}


def test_a_third_of_all_vectors_is_equal(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else v) for i, v in random_rows(600, 1, 4)]
    close(found(frame(spark, rows)), brute(rows, 5, 5))


@pytest.mark.parametrize("functions", [1, 3])
def test_recall_of_hashed_search(spark, functions):
    rows = random_rows(3000, 2, 16)
    result = found(frame(spark, rows), 10, 50, functions=functions)
    truth = brute(rows, 10, 50)
    assert set(result) == set(truth) and all(len(x) == 10 for x in result.values())
    recall = np.mean([len({i for i, _ in truth[q]} & {i for i, _ in result[q]}) / 10 for q in truth])
    assert recall >= 0.9
    for q, x in result.items():
        scores = dict(brute(rows, 3000, 50)[q]) if q == 0 else {}
        assert all(scores.get(i, s) == pytest.approx(s, abs=1e-12) for i, s in x)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_tables_are_hashed(spark, monkeypatch, size):
    """The first round hashes at every size and finds the true neighbours."""
    made, hashing = [], neighbours.Hashing

    def make(dim, length, functions):
        made.append(functions)
        return hashing(dim, length, functions)

    monkeypatch.setattr(neighbours, "Hashing", make)
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding")
    result = found(df, neighbours.K, neighbours.QUERY_EVERY)
    assert made[0] >= 1
    truth = brute([tuple(r) for r in df.collect()], neighbours.K, neighbours.QUERY_EVERY)
    assert set(result) == set(truth)
    recall = np.mean([len({i for i, _ in truth[q]} & {i for i, _ in result[q]}) / len(truth[q]) for q in truth])
    print(f"\nrecall at {size}: {recall:.4f}, functions by round {made}")
    assert recall >= 0.9


def test_short_queries_are_searched_again(spark):
    """Buckets of many functions hold too few; the blocks give all that there are, exactly."""
    rows = random_rows(200, 3, 16)
    close(found(frame(spark, rows), 199, 50, functions=8), brute(rows, 199, 50))


def test_visits_begin_with_the_own_bucket():
    h = neighbours.Hashing(4, 1.0, 3)
    x = np.random.default_rng(1).normal(size=(20, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    visits = h.visits(x)
    assert visits.shape == (20, neighbours.TABLES, h.probes)
    assert (visits[:, :, 0] == h.codes(x)).all()
    assert all(len(set(row.tolist())) == h.probes for row in visits.reshape(-1, h.probes))


def share_and_recall(vectors, queries, k=20):
    """Share of the vectors that the queries meet in some bucket, and of their k best."""
    h = neighbours.Hashing(vectors.shape[1], float(np.linalg.norm(vectors, axis=1).max()), neighbours.FUNCTIONS)
    codes, visits = h.codes(vectors), h.visits(vectors[queries])
    met = np.zeros((len(queries), len(vectors)), dtype=bool)
    for t in range(h.tables):
        for n in range(len(queries)):
            met[n] |= np.isin(codes[:, t], visits[n, t])
    score = vectors[queries] @ vectors.T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-score, axis=1)[:, :k]
    return met.mean(), np.take_along_axis(met, best, axis=1).mean()


def test_probes_are_a_part_of_the_table_and_more_find_more(spark, monkeypatch):
    """On the given vectors, which have next to no structure, and on clustered ones."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    given = np.array([r.embedding for r in given], dtype=np.float64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    grouped = np.repeat(centres, 50, axis=0) + 0.4 * rng.normal(size=(2000, 64))
    grouped /= np.linalg.norm(grouped, axis=1, keepdims=True)
    found = {}
    for probes in (10, neighbours.PROBES):
        monkeypatch.setattr(neighbours, "PROBES", probes)
        found[probes] = [share_and_recall(x, np.arange(0, 2000, 20)) for x in (given, grouped)]
    print("\nshare of the table met, recall:", found)
    few, many = found[10], found[max(found)]
    assert neighbours.PROBES < 3**neighbours.FUNCTIONS / 2
    assert all(a[0] < b[0] < 0.9 and a[1] < b[1] for a, b in zip(few, many))
    assert many[0][1] >= 0.9 and many[1][1] >= 0.97
    assert few[1][1] / few[1][0] > 2  # where there is structure, the first probes are worth most


def test_one_bucket_with_many_queries(spark, monkeypatch):
    """Nearly equal vectors that all ask: one bucket, its queries passing a few at a time."""
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, (np.array([1.0, 2.0, 3.0]) + 1e-3 * rng.normal(size=3)).astype(np.float32).tolist()) for i in range(700)]
    close(found(frame(spark, rows), 5, 1), brute(rows, 5, 1))
