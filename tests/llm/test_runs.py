"""Periodic runs against a search over all periods, and the registered query against its contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lunario.llm import runs

SF_DIR = "/root/testdata/sf0.001"


def brute(words):
    """(start, length, period) of all runs, by trying every period at every word."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # smaller periods come first
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(rng):
    """Words of few letters, powers, powers of powers, runs side by side and almost-runs."""
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, ["a", "b"] * 150, list("abaab" * 40)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    out.append(list(fib[-1]))
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 40]))]
            if rng.random() < 0.3:
                unit = unit * rng.randrange(1, 6) + [rng.choice("abcx")]
            words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
            words += [rng.choice("abcxyz") for _ in range(rng.randrange(4))]
        if rng.random() < 0.3 and words:
            words[rng.randrange(len(words))] = "!"
        out.append(words)
    out += [[rng.choice("ab") for _ in range(rng.randrange(300))] for _ in range(20)]
    return out


def as_bytes(words):
    return [w.encode() for w in words]


def test_against_every_period():
    own = texts(random.Random(2))
    found = runs.word_runs([as_bytes(w) for w in own])
    for words, mine in zip(own, found, strict=True):
        assert mine == brute(words), words


def test_copies_of_a_text_do_not_make_a_run():
    """Texts lie one after another in one array; what crosses them does not count."""
    own = [list("abcabcab")] * 50 + [["a"] * 7] * 20
    assert runs.word_runs([as_bytes(w) for w in own]) == [brute(w) for w in own]


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_convolution_finds_all_recurrences(size, monkeypatch):
    rng = np.random.default_rng(size)
    monkeypatch.setattr(runs, "ELEMENTS", 1 << 9)
    for top in (2, 1 << 15, 1 << 24):  # the larger need two and three primes
        x = rng.integers(top - 1, top + 1, 40 * size)
        x[: 10 * size] = x[10 * size : 20 * size]
        padded = np.concatenate([x, np.zeros(3 * size, dtype=x.dtype)])
        blocks = np.arange(40)
        block, distance = runs.recurrences(padded, blocks, size)
        expected = {
            (b, d) for b in range(40) for d in range(size, 2 * size)
            if (padded[b * size : b * size + size] == padded[b * size + d : b * size + d + size]).all()
        }
        assert set(zip(block.tolist(), distance.tolist())) == expected
        assert len(block) == len(expected)


def test_long_texts_of_few_words():
    rng = random.Random(8)
    unit = [f"w{rng.randrange(9)}" for _ in range(700)]
    words = ["x"] * 3000 + unit * 9 + ["y"] + ["x", "z"] * 2500
    assert runs.word_runs([as_bytes(words)]) == [brute(words)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 9), (4, "a " * 9), (None, "a\tb a b\x0ba b a b c"),
            (5, "é " * 4 + "ü x " * 8), (6, "q " * 200_000 + "end")]
    df = frame(spark, rows)
    for name in ("words", "runs", "collapsed", "_text"):
        df = df.withColumn(name, F.lit("mine"))
    got = sorted(
        (str(r["_doc"]["doc_id"]), r["_doc"]["runs"], r.words, [tuple(x) for x in r.runs], r.collapsed)
        for r in runs.periodic_runs(df).collect()
    )
    expected = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        own = brute(words) if len(words) < 1000 else [(0, 200_000, 1)]
        kept = [w for n, w in enumerate(words) if not any(a + q <= n < a + m for a, m, q in own)]
        expected.append((str(doc_id), "mine", len(words), own, " ".join(kept)))
    assert got == sorted(expected)
    assert runs.periodic_runs(frame(spark, [])).count() == 0


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    own = brute(words)
    best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + m for a, m, q in own)]
    shas = [hashlib.sha256(x.encode()).hexdigest() for x in
            ("".join(f"{a},{m},{q}\n" for a, m, q in own), " ".join(kept))]
    return (doc_id, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *shas)


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    small = [r for r in docs if len((r.text or "").split()) < 4000]
    got = {r.doc_id: tuple(r) for r in runs.query(spark, SF_DIR).collect()}
    assert len(got) == len(docs) and len(small) > 150
    for r in small:
        assert got[r.doc_id] == contract(r.doc_id, r.text)
    assert sum(r[1] > 0 for r in got.values()) > 10
