from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lunario.llm import licences

KNOWN = licences.Templates(licences.TEMPLATES)


def brute(text, templates=licences.TEMPLATES):
    """Best containment of each template in any window of its class, by direct comparison."""
    def grams(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return [tuple(w[n : n + 5]) for n in range(len(w) - 4)]

    own, out = grams(text), {}
    for name, template in templates.items():
        listed = grams(template)
        wanted = set(listed)
        length = 1 << (len(listed) - 1).bit_length()
        size = 1 if length == 1 else 2 * length
        best = max((len(wanted & set(own[n : n + size])) / len(wanted)
                    for n in range(0, len(own), length)), default=0)
        if best >= licences.CONTAINED:
            out[name] = best
    return out


def edited(rng, text, changes):
    parts = text.split()
    for _ in range(changes):
        parts[rng.randrange(len(parts))] = "changed"
    return " ".join(parts)


def texts():
    rng = random.Random(8)
    vocabulary = [f"v{n}" for n in range(500)] + ["licensed", "under", "the", "license", "software"]

    def filler(n):
        return " ".join(rng.choices(vocabulary, k=n))

    out = [None, "", "the", filler(4), filler(3000)]
    for template in licences.TEMPLATES.values():
        for n in range(12):
            changed = edited(rng, template, n % 4)
            out.append(f"{filler(rng.randrange(60))}\n{changed}. {filler(rng.randrange(60))}")
        out.append(template.upper().replace(" ", "\n--  "))
    out.append(" ".join(licences.TEMPLATES.values()))
    return out


def test_brute_force():
    data = texts()
    found = KNOWN.matches([None if t is None else t.encode() for t in data])
    assert [{k: v[0] for k, v in f.items()} for f in found] == [brute(t) for t in data]
    assert sum(map(len, found)) > 80


def test_passages_are_where_they_are_said_to_be():
    text = "alpha beta " + licences.TEMPLATES["GPL-3.0"] + " gamma delta epsilon"
    share, first, count = KNOWN.matches([text.encode()])[0]["GPL-3.0"]
    assert (share, first, count) == (1.0, 2, 12)


def test_bands_miss_less_than_promised():
    for size in (1, 2, 3, 5, 8, 20, 100):
        length = 1 << (size - 1).bit_length()
        need = int(np.ceil(licences.CONTAINED * size - 1e-9))
        window = 1 if length == 1 else 2 * length
        similar = need / (window + size - need)
        assert (1 - similar) ** licences.bands(size, length) <= licences.MISSED


def test_hashes_agree_wherever_a_text_stands():
    parts = [b"one two three four five six", b"", b"x y", "déjà vu a b c d".encode(), b"w" * 300 + b" a b c d e"]
    together, counts = licences.shingle_hashes(parts)
    alone = [licences.shingle_hashes([p])[0] for p in parts]
    assert counts.tolist() == [2, 0, 0, 2, 2]
    assert together.tolist() == np.concatenate(alone).tolist()


def test_scan_of_tables(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."),
            (None, "x " * 50_000 + licences.TEMPLATES["Apache-2.0"]), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"licence": F.lit(1), "words": F.lit("w")}
    )
    found = sorted(((r["_doc"]["doc_id"] or 0, r.licence) for r in licences.scan(df).collect()))
    assert found == [(0, "Apache-2.0"), (1, "MIT"), (1, "MIT")]
    assert licences.scan(df.limit(0)).count() == 0
    own = licences.scan(df, {"tiny": "released under the mit license"})
    assert own.count() == 2
    with pytest.raises(ValueError):
        licences.Templates({"short": "too few words"})


def test_registered_query_finds_what_brute_force_finds(spark):
    sf = "/root/testdata/sf0.001"
    found = {(r.doc_id, r.licence, r.containment) for r in licences.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert found == {(d.doc_id, n, c) for d in docs for n, c in brute(d.text).items()}


def test_whole_licences_at_any_place_of_long_texts():
    """Edited licence texts of hundreds of words, at places that lie differently in their windows."""
    rng = random.Random(3)
    filler = [f"v{n}" for n in range(400)]
    data = []
    for name in ("MIT-text", "BSD-2-Clause-text", "ISC-text", "LGPL-2.1-notice", "Unlicense-dedication"):
        for offset in (0, 1, 63, 64, 65, 127, 200, 255, 256, 300, 511, 513):
            changed = edited(rng, licences.TEMPLATES[name], rng.randrange(4))
            data.append(" ".join(rng.choices(filler, k=offset)) + f" {changed} " + " ".join(rng.choices(filler, k=rng.randrange(500))))
    found = KNOWN.matches([t.encode() for t in data])
    assert [{k: v[0] for k, v in f.items()} for f in found] == [brute(t) for t in data]
    assert all(f for f in found)


def test_families_are_told_apart():
    notices = {
        "SPDX-License-Identifier: LGPL-3.0-or-later": {"SPDX-LGPL-3.0-or-later"},
        "// SPDX-License-Identifier: GPL-2.0-only": {"SPDX-GPL-2.0-only"},
        licences.TEMPLATES["AGPL-3.0-notice"]: {"AGPL-3.0-notice"},
        licences.TEMPLATES["ISC-text"]: {"ISC-text"},
    }
    for text, expected in notices.items():
        found = set(KNOWN.matches([text.encode()])[0])
        assert expected <= found and not any("Apache" in n or "MIT" in n for n in found), (text, found)
