from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lunario.llm import warc

BIG, OTHER = "<p>é</p>" * 200, "x" * 1000


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [
    (1, "http://a/1", BIG),
    (5, "http://a/5", BIG),
    (3, None, BIG),
    (2, "http://a/\r\nX: y", OTHER),
    (4, "", "small"),
    (6, "u", "small"),
    (7, "u", None),
    (8, "u", ""),
    (9, "u", OTHER),
    (10, "u", "x" * 999),
    (11, "u", "x" * 999),
    (12, "u", "\r\n\r\nWARC/1.1\r\n" * 100_000),
]


def expected(rows):
    groups = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            groups[body] = max(groups.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        top = groups.get(body, page)
        out.append((page, len(body), hashlib.sha1(body).hexdigest(),
                    *(("revisit", top) if top != page else ("response", None))))
    return sorted(out)


def back(folder, manifest):
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(tuple(r[c] for c in cols) for r in warc.resolved(warc.read(folder, manifest)).collect())


@pytest.mark.parametrize("file_bytes", [1, 2000, 1 << 30])
def test_round_trip(spark, file_bytes):
    df = frame(spark, ROWS).withColumns({"_key": F.lit(0), "record_type": F.lit("z")})
    folder, manifest = warc.write(df.repartition(4), file_bytes=file_bytes)
    assert back(folder, manifest) == expected(ROWS)
    files = {r.file: r for r in manifest.collect()}
    path = Path(folder.removeprefix("file://"))
    assert {p.name for p in path.iterdir()} == set(files)
    for name, row in files.items():
        data = (path / name).read_bytes()
        assert (len(data), hashlib.sha1(data).hexdigest()) == (row.bytes, row.sha1)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert sum(r.records for r in files.values()) == len(ROWS)


def test_equal_input_gives_equal_bytes(spark):
    def sums(df):
        return sorted(r.sha1 for r in warc.write(df)[1].collect())

    assert sums(frame(spark, ROWS).coalesce(1)) == sums(frame(spark, ROWS[::-1]).coalesce(1))


def test_repeated_rows_and_missing_keys(spark):
    rows = [(1, "u", BIG)] * 3 + [(None, "u", OTHER)] * 2 + [(1, "u", "small")] * 2
    found = [
        (r.page_id, r.record_type, r.refers_to)
        for r in warc.resolved(warc.read(*warc.write(frame(spark, rows)))).collect()
    ]
    assert sorted(found, key=str) == sorted(
        [(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (None, "response", None),
         (None, "revisit", None), (1, "response", None), (1, "response", None)], key=str)


def test_hot_payload_and_empty_table(spark):
    rows = [(n, "u", BIG if n % 3 == 0 else f"{n} " * 400) for n in range(300)]
    assert back(*warc.write(frame(spark, rows))) == expected(rows)
    folder, manifest = warc.write(frame(spark, []))
    assert manifest.count() == 0 and warc.read(folder, manifest).count() == 0


def test_damage_is_an_error():
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 0, None)
    data = gzip.decompress(good)
    assert warc.parsed(data)[0] == 1
    with pytest.raises(OSError):
        warc.parsed(data.replace(b"payload", b"pay1oad"))
    with pytest.raises(OSError):
        warc.parsed(data[:-6])
