"""The pipeline against the operators' own definitions, and the registered queries against SQL."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from lunario.llm import langid, mixing
from lunario.llm.common import stored_order, written
from lunario.llm.queries import ORACLES, QUERIES
from lunario.llm.tokens import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_queries_are_registered():
    names = driver.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLES) <= set(driver.oracle_sql())


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF_DIR), name.replace(" ", "-")))
    return tables


def test_each_stage_takes_effect_on_what_the_one_before_kept(stages):
    docs, told, unique, unlike, mix, packed = stages
    assert all(t.columns == docs.columns for t in stages[:-1])
    rows = [t.collect() for t in stages]
    model = langid.train(docs)
    rejected = model.predict([r.text for r in rows[0]])[2]
    assert sorted(r.doc_id for r in rows[1]) == sorted(
        r.doc_id for r, no in zip(rows[0], rejected) if not no
    )
    groups = defaultdict(list)
    for r in rows[1]:
        groups["".join(r.text.split())].append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in rows[2]) == sorted(min(g)[1] for g in groups.values())
    prints = {r.doc_id: brute_print(r.text) for r in rows[2]}
    roots, least = brute_components(list(prints.values())), {}
    for d, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], d), d)
    assert sorted(r.doc_id for r in rows[3]) == sorted(least.values())
    copies = {r["_doc"]["doc_id"]: r.copies for r in mixing.mixed(unlike).collect() if r.copies}
    assert Counter(r.doc_id for r in rows[4]) == Counter(copies)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [2] for r in rows[4]}
    tokens = Counter()
    for p in rows[5]:
        piece = ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(np.array(piece, dtype="<u4").tobytes()) == p.ids_crc32
        tokens[p.doc_id] += p.length
    assert tokens == Counter({d: n * len(ids[d]) for d, n in copies.items()})
    assert packed.count() == len(rows[5]) and unique.count() == len(rows[2]) and told.count()


def test_run_gives_the_last_stage(spark, stages):
    """Where a window lies may change with the number of files; what it is made of may not."""
    run = corpus_pipeline.run(spark, SF_DIR)
    assert run.columns == stages[-1].columns
    assert run.groupBy().sum("length").first() == stages[-1].groupBy().sum("length").first()


def test_sequences_follow_the_order_of_the_mix(stages):
    """Sorted by place, sequences begin with the documents that the mix puts first."""
    mix, packed = stages[4], stages[5]
    places = {(r.doc_id, r["_place"]) for r in stored_order(mix).select("doc_id", "_place").collect()}
    at = defaultdict(list)
    for doc_id, place in places:
        at[doc_id].append(place)
    windows = defaultdict(list)
    for r in packed.collect():
        windows[r.sequence_id, r.place].append(r.doc_id)
    for (_, place), docs in windows.items():
        assert place in {p for d in docs for p in at[d]}
        assert all(max(at[d]) >= place for d in docs)
    time = {r.doc_id: r.times[0] for r in mixing.mixed(stages[3]).select("_doc.doc_id", "times").collect() if r.times}
    order = [r.doc_id for r in stored_order(mix).orderBy("_place").collect()]
    first = [time[d] for n, d in enumerate(order) if d not in order[:n]]
    assert first == sorted(first)


def tables(tmp_path, spark, rows, schema, **more):
    df = spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in more.items()})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(tmp_path, spark, [], SCHEMA)).count() == 0


def test_odd_tables(spark, tmp_path):
    """No labels, NULL keys and texts, repeated rows, further columns with the operators' names."""
    rows = [(n, " ".join(f"é{n}w{i}" for i in range(20 + n)), None, "s", 1) for n in range(12)]
    rows += [(None, None, None, None, None)] * 2 + [(3, rows[3][1], None, "s", 1)] * 3 + [(50, "", None, "t", 0)]
    dir_ = tables(tmp_path, spark, rows, SCHEMA, _id="x", _row="y", times="z", root="r", place="p", kept="k")
    docs = spark.read.parquet(f"{dir_}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, dir_), name.replace(" ", "-"))
        assert after.columns == docs.columns
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, dir_).collect()
    assert sorted({r.doc_id for r in packed if r.doc_id is not None}) == sorted({r.doc_id for r in docs.collect() if r.doc_id is not None})
    assert len({r.doc_id for r in packed}) >= 10
