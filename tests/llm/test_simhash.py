from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lunario.llm import simhash


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[n : n + 3]) for n in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints, budget=2):
    """Root of each value by comparing all pairs."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for n, a in enumerate(values):
        for b in values[n + 1 :]:
            if (a ^ b).bit_count() <= budget:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {v: top(v) for v in values}


TEXTS = [None, "", " \t", "One", "one two", "One TWO three", "É é Ñ", "a b c d e f g h", "x " * 500]


def test_fingerprints():
    rng = random.Random(0)
    texts = TEXTS + [" ".join(rng.choices("alpha beta Gamma δέλτα é".split(), k=rng.randrange(1, 80)))
                     for _ in range(60)]
    found = simhash.fingerprints_of([None if t is None else t.encode() for t in texts])
    assert found.tolist() == [brute_print(t) for t in texts]


def clustered(rng, centres, around, bits=64):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(bits)
        out.add(c)
        for _ in range(around):
            v = c
            for b in rng.sample(range(bits), rng.randrange(4)):
                v ^= 1 << b
            out.add(v)
            c = v if rng.random() < 0.2 else c
    return sorted(out)


@pytest.mark.parametrize("outright", [0, 32])
def test_walk_finds_the_components_of_all_pairs(monkeypatch, outright):
    monkeypatch.setattr(simhash, "OUTRIGHT", outright)
    monkeypatch.setattr(simhash, "WALK_AT_ONCE", 64)
    values = clustered(random.Random(5), 12, 25)
    u, v = simhash.walk(np.array(values, dtype=np.uint64), None, 0, 0)
    joined = {x: {x} for x in values}
    for a, b in zip(u.tolist(), v.tolist()):
        merged = joined[a] | joined[b]
        for x in merged:
            joined[x] = merged
    roots = brute_components(values)
    assert all(min(joined[x]) == min(y for y in values if roots[y] == roots[x]) for x in values)


@pytest.mark.parametrize("rows", [2, 16, 1 << 15])
def test_join_of_split_tries(spark, rows):
    """Node pairs of every size, down to single fingerprints, connect the same values."""
    values = clustered(random.Random(9), 6, 14)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "_print long")
    roots = simhash.components(simhash.links(prints, rows))
    found = {r.node: r.root for r in roots.collect()}
    expected = brute_components(values)
    groups, seen = {}, {}
    for v, s in zip(values, signed):
        groups.setdefault(expected[v], set()).add(s)
        seen.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, seen.values()))


def test_components_of_long_chains(spark):
    edges = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1100)] + [(5, 5)]
    roots = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.root for r in roots} == {0, 1000} and len(roots) == 301
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def near_rows():
    rng = random.Random(4)
    words = [f"w{n}" for n in range(3000)]
    base = [rng.choices(words, k=400) for _ in range(8)]
    rows = []
    for n in range(160):
        copy = list(base[n % 8])
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(400)] = rng.choice(words)
        rows.append((500 - n, " ".join(copy)))
    return rows + [(900 + n, t) for n, t in enumerate(TEXTS)] + [(2000 + n, "hot text here") for n in range(90)]


def test_brute_force(spark):
    rows = near_rows()
    found = {r["_doc"]["doc_id"]: (r.fingerprint, r.component_id)
             for r in simhash.near_duplicates(frame(spark, rows), rows=32).collect()}
    prints = {d: brute_print(t) for d, t in rows}
    roots = brute_components(list(prints.values()))
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], d), d)
    assert found == {d: (f"{p:016x}", least[roots[p]]) for d, p in prints.items()}
    assert len(set(least.values())) < len(set(prints.values()))
    stays = simhash.one_of_each(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in stays) == sorted(set(least.values()))


def test_odd_tables(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.one_of_each(frame(spark, [])).count() == 0
    df = frame(spark, [(None, "a"), (None, "a"), (2, "a b c d"), (2, "a b c d")]).withColumns(
        {"root": F.lit(1), "_print": F.lit("p"), "node": F.lit(2.0)}
    )
    assert {(r["_doc"]["doc_id"], r.component_id) for r in simhash.near_duplicates(df).collect()} == {
        (None, None), (2, 2)
    }
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == 2
    long = frame(spark, [(1, "word " * 200_000), (2, "WORD\n" * 200_000)])
    assert {r.component_id for r in simhash.near_duplicates(long).collect()} == {1}
