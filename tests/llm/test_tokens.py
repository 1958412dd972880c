from __future__ import annotations

import sys
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lunario.llm import packing, token_files
from lunario.llm.tokens import WordEncoder, tokenizer_path

PATH = tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH)
TEXTS = [
    None, "", " \n", "a", "The CAT's hat, isn't it?!", "naïve café — Ünïcode…", "don't 's 've 12345 3.14",
    "a\x1cb c d e f", "é ́x İstanbul İ ΑΣ ΟΔΟΣ.", "汉字 漢字, かな。", "😀 ok 👍🏽.",
    "a''s b's' c### d$$$. e'' f'. g<|endoftext|>. <| h|> i'' 's' 're_ j__ k-l- m&amp;",
    "<|endoftext|> x <|startoftext|>", "word.word, ...!!! a.b.c ;;|", "ab " * 5000, "x" * 3000,
]


def plain(text, end=None):
    ids = PLAIN.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, *([] if end is None else [end])], dtype="<u4").tobytes()


def test_words_give_the_ids_of_whole_texts():
    data = [None if t is None else t.encode() for t in TEXTS]
    assert ENCODER.encode(data, 1) == [plain(t, 1) for t in TEXTS]
    assert ENCODER.encode(data) == [plain(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    small = WordEncoder.__new__(WordEncoder)
    small.__dict__ = {**ENCODER.__dict__, "memory": 3, "known": {}, "cores": {}}
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert small.encode([t.encode() for t in texts]) == [plain(t) for t in texts]


def test_every_letter_before_every_sign():
    """Letters whose normal form ends in a mark (İ, some of Devanagari, Bengali, Hebrew) included."""
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L"]
    words = [x for c in letters for x in (c, f"a{c}", *(f"{c}{sign}" for sign in ".,;:!?|#&'_<"))]
    found = WordEncoder(PATH).encode([w.encode() for w in words])
    expected = PLAIN.encode_batch(words, add_special_tokens=False)
    wrong = [
        w for w, mine, theirs in zip(words, found, expected, strict=True)
        if mine != np.array(theirs.ids, dtype="<u4").tobytes()
    ]
    assert not wrong


REAL = ["DENİZİ, TARİHİ. İL; KADIKÖY'ÜN,", "আমি বাড়ি হয়, যায়. নিয়ে;", "क़लम, ख़ास. ज़मीन! पढ़ाई,", "שָׁלוֹם, שּׁ. ﬞײַ,"]


def test_texts_of_real_languages():
    texts = [*REAL, *[unicodedata.normalize(f, t) for t in REAL for f in ("NFC", "NFD")]]
    assert ENCODER.encode([t.encode() for t in texts], 1) == [plain(t, 1) for t in texts]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- files ----------------------------------------------------------------------------------------


def test_files_hold_all_ids_in_key_order(spark):
    rows = [(7 * n % 211, TEXTS[n % len(TEXTS)]) for n in range(211)]
    files = token_files.TokenFiles.write(frame(spark, rows).repartition(6))
    found = {r["_key"]: r for r in files.read(files.entries).collect()}
    start = 0
    for doc_id, text in sorted(rows):
        ids = plain(text, 1)
        r = found[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert len(found) == len(rows)


def test_read_gives_the_ids_of_the_keys(spark):
    rows = [(n, TEXTS[n % len(TEXTS)]) for n in range(40)]
    files = token_files.TokenFiles.write(frame(spark, rows).repartition(3))
    keys = spark.createDataFrame([(k, 0) for k in (3, 9, 20, 500)], "_key long, _nth int")
    found = {r["_key"]: bytes(r.ids) for r in files.read(keys).collect()}
    assert found == {k: plain(rows[k][1], 1) for k in (3, 9, 20)}
    assert "ids" not in files.read(keys, with_ids=False).columns


def test_repeated_and_missing_keys(spark):
    rows = [(None, "a"), (None, "b c"), *[(3, "same")] * 40, (4, None)]
    df = frame(spark, rows).withColumn("shard", F.lit("mine"))
    files = token_files.TokenFiles.write(df)
    found = files.read(files.entries).orderBy("start").collect()
    assert [r["_key"] for r in found] == [None] * 2 + [3] * 40 + [4]
    assert [r["_nth"] for r in found] == [0, 1, *range(40), 0]
    assert found[-1].n_tokens == 1
    unknown = spark.createDataFrame([(k, 0) for k in range(1000, 3000)], "_key long, _nth int")
    assert files.locate(unknown).count() == 0


def test_empty_table_of_files(spark):
    files = token_files.TokenFiles.write(frame(spark, []))
    assert files.read(files.entries).count() == 0


def test_shards_roll(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 50)
    monkeypatch.setattr(token_files, "DOCS_AT_ONCE", 3)
    rows = [(n, "alpha beta gamma " * 6) for n in range(20)]
    files = token_files.TokenFiles.write(frame(spark, rows).coalesce(1))
    found = files.read(files.entries).orderBy("_key").collect()
    assert [r.ids_crc32 for r in found] == [zlib.crc32(plain(t, 1)) for _, t in rows]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
    levels = token_files.build_hash(h1, h2)
    assert sorted(token_files.find(levels, h1, h2).tolist()) == list(range(n))


# --- packing --------------------------------------------------------------------------------------


def check_pieces(rows, pieces, by="doc_id"):
    """Every id of every text once; windows gapless, full and powers of two."""
    own = defaultdict(list)
    for p in pieces:
        own[p[by]].append(p)
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for members in windows.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == members[0].window and at & (at - 1) == 0 and at <= 4096
    for key, text in rows:
        ids = plain(text, 2)
        parts = sorted(own.pop(key), key=lambda p: p.start)
        at = 0
        for p in parts:
            assert p.start == at and p.doc_tokens == len(ids) // 4
            assert p.ids_crc32 == zlib.crc32(ids[at * 4 : (at + p.length) * 4])
            at += p.length
        assert at == len(ids) // 4
    assert not own


def test_pieces_cover_all_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 20_000)
    rows = [(n, TEXTS[n % len(TEXTS)]) for n in range(150)] + [(900, "word " * 30_000)]
    result = packing.packed(frame(spark, rows).withColumn("window", F.lit(1)).repartition(3), with_ids=True)
    pieces = result.collect()
    check_pieces(rows, pieces)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in pieces)
    steps = defaultdict(dict)
    for p in pieces:
        steps[p.step_group][p.sequence_id] = p.window
    assert max(sum(s.values()) for s in steps.values()) <= packing.STEP_TOKENS


def test_odd_tables_of_packing(spark):
    assert packing.packed(frame(spark, [])).count() == 0
    pieces = packing.packed(frame(spark, [(None, None), (1, "a"), (1, "a")])).collect()
    assert sum(p.length for p in pieces if p.doc_id is None) == 1
    assert sum(p.length for p in pieces if p.doc_id == 1) == 2 + 2
    with pytest.raises(ValueError):
        packing.packed(frame(spark, []), tiers=(500,))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=40), st.booleans())
def test_plan_uses_every_id_once(lengths, last):
    windows, left = packing.plan(lengths, last=last)
    seen = defaultdict(list)
    for w in windows:
        size = sum(n for _, _, n in w)
        assert size & (size - 1) == 0 and size <= 4096
        for doc, start, n in w:
            seen[doc].append((start, n))
    for n, doc, start in left:
        seen[doc].append((start, n))
    assert not (last and left) and sum(x[0] for x in left) < 4096
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == n


def test_sequences_know_the_first_place_of_their_documents(spark):
    rng = np.random.default_rng(5)
    rows = [(n, "word " * int(rng.integers(1, 4000)), 1000 - n) for n in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p long").coalesce(1)
    plain_rows = {tuple(r) for r in packing.packed(df).drop("sequence_id", "step_group").collect()}
    placed = packing.packed(df, place="p").collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset, r.window) for r in placed} == plain_rows
    first = {}
    for r in placed:
        first[r.sequence_id] = min(first.get(r.sequence_id, 10**9), 1000 - r.doc_id)
    assert all(first[r.sequence_id] == r.place for r in placed)
