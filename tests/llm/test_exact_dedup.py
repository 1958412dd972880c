from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lunario.llm import exact_dedup


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each row, rows with unique ids."""
    groups = {}
    for doc_id, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text or "")
        groups.setdefault(body, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: m[:3])[3]
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[3], best, len(members), m[3] == best, sha) for m in members]
    return sorted(out, key=str)


def found(df):
    cols = ("keep_id", "group_size", "kept", "text_sha256")
    return sorted(((r["_doc"]["doc_id"], *[r[c] for c in cols]) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


ROWS = [
    (1, "a b c"),
    (2, "abc"),
    (3, " a\tb\x0bc\n"),
    (4, None),
    (5, ""),
    (6, " \n"),
    (7, "ab c é"),
    (8, "abcé "),
    (9, "x" * 50),
    (10, "x" * 25 + " " + "x" * 25),
    (11, "x" * 51),
    (12, "x" * 64),
    (13, "x" * 63 + "y"),
    (None, "abc "),
]


@pytest.mark.parametrize("chars", [1, 3, 8, 4096])
def test_brute_force(spark, chars):
    assert found(exact_dedup.exact_duplicates(frame(spark, ROWS), chars=chars)) == brute(ROWS)


def test_random_texts_of_few_letters(spark):
    rng = random.Random(3)
    rows = [(n, "".join(rng.choices("ab ", k=rng.randrange(7)))) for n in range(300)]
    assert found(exact_dedup.exact_duplicates(frame(spark, rows), chars=2)) == brute(rows)


def test_blocks_that_share_a_hash_stay_apart(spark, monkeypatch):
    """The block itself decides, even if every hash collides."""
    monkeypatch.setattr(exact_dedup, "block_hash", lambda b: F.pmod(F.xxhash64(b), F.lit(3)))
    assert found(exact_dedup.exact_duplicates(frame(spark, ROWS), chars=4)) == brute(ROWS)


def test_a_third_of_all_rows_is_one_group(spark):
    rows = [(n, "same text" if n % 3 == 0 else f"text {n}") for n in range(600)]
    assert found(exact_dedup.exact_duplicates(frame(spark, rows))) == brute(rows)


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", "p", 7), (1, "a", "p", 7), (2, "b", "q", 8)],
        "doc_id long, text string, name string, level int",
    ).withColumns({"_row": F.lit(5), "kept": F.lit("no"), "_doc": F.lit(None).cast("string")})
    result = exact_dedup.exact_duplicates(df).collect()
    assert sorted((r["_doc"]["doc_id"], r.group_size, r.kept) for r in result) == [
        (1, 2, False), (1, 2, True), (2, 1, True)
    ]
    stays = exact_dedup.drop_duplicates(df)
    assert stays.columns == df.columns
    assert sorted(r.doc_id for r in stays.collect()) == [1, 2]


def test_empty_table_and_very_long_text(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "ab " * 300_000), (2, "ab" * 300_000), (3, "ab" * 299_999 + "ac")]
    assert found(exact_dedup.exact_duplicates(frame(spark, rows))) == brute(rows)


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_one_very_long_text(spark):
    """Cutting a text into blocks takes time in proportion to it: sixteen million characters pass."""
    row = spark.range(1).select(
        F.lit(1).cast("long").alias("doc_id"),
        F.concat(F.repeat(F.lit("abcdefgh"), 2_000_000), F.lit("é😀")).alias("text"),
    )
    same = row.select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit(" "), "text").alias("text"))
    got = exact_dedup.exact_duplicates(row.unionByName(same)).collect()
    assert {(r["_doc"]["doc_id"], r.keep_id, r.group_size) for r in got} == {(1, 2, 2), (2, 2, 2)}


def test_blocks_are_code_points(spark):
    texts = ["", "a", "é😀" * 5, "x\n\r\u2028y", "z" * 8]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for chars in (1, 3, 4, 100):
        cut = rows.select("t", exact_dedup.blocks(F.col("t"), chars).alias("b")).collect()
        for r in cut:
            assert r.b == ([r.t[i : i + chars] for i in range(0, len(r.t), chars)] or [""])


@pytest.mark.parametrize("make", ["joined", "exploded", "unioned"])
def test_repeated_rows_of_a_stored_table(spark, tmp_path, make):
    """Rows that a join, explode or union repeats have the file's row in common; one of them stays."""
    frame(spark, [(1, "a b"), (2, "c d")]).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    twice = {
        "joined": lambda: stored.join(spark.createDataFrame([(1,), (2,), (1,), (2,)], "doc_id long"), "doc_id"),
        "exploded": lambda: stored.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))),
        "unioned": lambda: stored.unionByName(stored),
    }[make]()
    assert twice.count() == 4
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(twice).collect()) == [1, 2]
