from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lunario.llm import langid

SF_DIR = "/root/testdata/sf0.01"


def test_subwords_are_counted_word_by_word():
    """Grams of the whole text, none across words or texts."""
    found, starts, letters = langid.subwords(["Ab cd", None, "é1x", "", "---"])
    sizes = [np.diff(np.append(s, len(f))).tolist() for f, s in zip(found, starts)]
    assert sizes == [[6, 0, 4, 0, 0], [4, 0, 2, 0, 0], [2, 0, 0, 0, 0]]
    assert letters.tolist() == [4, 0, 2, 0, 0]
    alone = langid.subwords(["ab"])[0]
    both = langid.subwords(["zz ab", "q"])[0]
    assert all(set(a.tolist()) <= set(b.tolist()) for a, b in zip(alone, both))
    upper = langid.subwords(["AB"])[0]
    assert all((a == b).all() for a, b in zip(alone, upper))


def samples(rng, texts):
    out = []
    for text, lang in texts:
        at, n = np.unique(np.concatenate(langid.subwords([text])[0]), return_counts=True)
        out.append((at, n / n.sum(), lang))
    rng.shuffle(out)
    return out


def test_fit_tells_languages_apart_and_calibrates():
    rng = random.Random(1)
    words = {"aa": ["tan", "tin", "ton", "tun"], "bb": ["mel", "mol", "mal", "mil"]}
    texts = [(" ".join(rng.choices(words[k], k=rng.randrange(1, 30))), k) for k in words for _ in range(80)]
    model = langid.fit(samples(rng, texts))
    names, score, rejected = model.predict([t for t, _ in texts] + ["123", None])
    assert np.mean([a == k for a, (_, k) in zip(names, texts)]) > 0.98
    assert names[-2:] == ["und", "und"] and rejected[-2:].all() and (score[-2:] == 0).all()
    assert ((score >= 0) & (score <= 1)).all() and 0 <= model.threshold <= langid.HIGHEST
    assert rejected[:-2].mean() < 0.02


def test_prediction_is_the_mean_of_embeddings():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(langid.BUCKETS, 3))
    texts = ["one two three", "x", "", "né " * 2000]
    total, count, _ = langid.sums(texts, table)
    for n, text in enumerate(texts):
        at = np.concatenate(langid.subwords([text])[0])
        assert count[n] == len(at)
        assert total[n] == pytest.approx(table[at].sum(axis=0), abs=1e-6)


def test_held_out_accuracy(spark):
    result = langid.query(spark, SF_DIR)
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = result.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    one, two = (langid.train(d.filter(~langid.held_out())) for d in (docs, wrong))
    assert one.languages == two.languages and (one.table == two.table).all()


def test_odd_tables(spark):
    df = spark.createDataFrame(
        [(1, "le chat", None, 5), (None, None, "fr", 5), (3, "42 !", "fr", 5)],
        "doc_id long, text string, lang string, score int",
    )
    model = langid.train(df.filter("doc_id = 1"))
    assert model.languages == []
    found = langid.identified(df, model).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in found} == {("und", 0.0, True)}
    empty = langid.train(df.limit(0))
    assert langid.identified(df.limit(0), empty).count() == 0
    known = langid.fit(samples(random.Random(0), [("le chat", "fr"), ("the cat", "en")] * 20))
    stays = langid.accepted(df.unionByName(df), known)
    assert stays.columns == df.columns
    assert [r.doc_id for r in stays.collect()] == [1, 1]


def plain_buckets(text):
    """Buckets of a text's subwords, letter by letter."""
    letters = []
    for c in "\n" + (text or "") + "\n":
        low = c.lower()
        letters.append((ord(low) if len(low) == 1 else ord(c)) if c.isalpha() else 0)
    found = []
    for size in langid.SIZES:
        for at in range(len(letters) - size + 1):
            gram = letters[at : at + size]
            inner = gram[1:-1] if size > 2 else [any(gram)]
            if not all(inner):
                continue
            value = size * 0x85EBCA6B & 0xFFFFFFFF
            for c in gram:
                value = (value ^ c) * (0x01000193 + 2 * size) & 0xFFFFFFFF
            value ^= value >> 15
            found.append((value * 0x2C1B3C6D & 0xFFFFFFFF) >> 16)
    return found


def test_query_rows_by_plain_sums(spark):
    """Every row of the query: mean of its subwords' rows, softmax, best language."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = langid.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        at = plain_buckets(text)
        logits = (sum(model.table[b] for b in at) / len(at) + model.bias) / model.temperature
        chance = np.exp(logits - logits.max())
        chance /= chance.sum()
        assert r.lang_pred == model.languages[int(chance.argmax())]
        assert r.score == pytest.approx(chance.max(), abs=1e-6)


def test_the_sample_is_bounded(spark, monkeypatch):
    """Rows of one key, equal rows and long texts neither flood the sample nor empty it."""
    taken = []
    monkeypatch.setattr(langid, "fit", lambda samples: taken.append(samples))
    monkeypatch.setattr(langid, "SAMPLE", 10)
    rows = [(None, f"le chat {n}", "fr") for n in range(400)] + [(7, "the cat", "en")] * 300
    rows += [(n, f"ein Hund {'x' * n}", "de") for n in range(60)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    langs = [s[2] for s in taken[-1]]
    assert langs.count("fr") <= 10 and langs.count("en") == 1 and 5 <= langs.count("de") <= 10
    monkeypatch.setattr(langid, "SAMPLE_BUCKETS", 3 * 30)
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum(len(s[0]) for s in taken[-1]) <= 90


def test_a_table_without_labels_keeps_all(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "doc_id long, text string, lang string")
    assert langid.accepted(df, langid.train(df)).count() == 2
    model = langid.fit([])
    model.table = np.zeros(langid.MODEL_BYTES // 8 + 1)
    with pytest.raises(ValueError):
        langid.identified(df, model)
