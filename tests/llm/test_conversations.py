"""Conversation repair against an exhaustive search over the rows that are left."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from lunario.llm import conversations

BLANK = r"[\x20\x09-\x0D]"
SF_DIR = "/root/testdata/sf0.001"


def faults_of(rows):
    """Fault of each (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(f"{BLANK}+$", "", text)
        out.append(
            "b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t"
        )
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit) by recursion on what is left; sentences are s?(ua)+ or nothing."""
    steps = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("t", "u"): "u", ("u", "a"): "t"}

    @cache
    def rest(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in "0t" else []
        if inserts < 3:
            for x in "ua":
                if (state, x) in steps:
                    cost, audit = rest(i, steps[state, x], inserts + 1)
                    found.append((cost + 5, "I" + audit))
        if i < len(rows):
            cost, audit = rest(i + 1, state, 0)
            found.append((cost + 2, "D" + audit))
            own = rows[i][0][:1]
            for x in "sua" if faults[i] not in ("b", "d") else "":
                if (state, x) in steps and (x == own or x != "s"):
                    cost, audit = rest(i + 1, steps[state, x], 0)
                    more = (x != own) + 5 * (faults[i] == "t")
                    found.append((cost + more, ("K" if x == own else "R") + audit))
        return min(found, default=(10**9, ""))

    return rest(0, "0", 0)


def repaired(rows, audit):
    out, state, left = [], "0", iter(rows)
    for action in audit:
        role, text = ("", "") if action == "I" else next(left)
        if action != "D":
            if action != "K":
                role = "assistant" if state == "u" else "user"
            state = "u" if role[0] == "u" else "t"
            out.append(f"{role}:{text}")
    return "\n".join(out)


def brute(rows):
    """Result of one conversation from its (turn, role, text), ordered."""
    pairs = [(" " if r is None else r, " " if t is None else t) for _, r, t in rows]
    faults, turns = faults_of(pairs), [n for n, _, _ in rows if n is not None]
    cost, audit = cheapest(tuple(pairs), tuple(faults))
    near = [a[0][:1] + b[0][:1] for a, b in zip(pairs, pairs[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(x) for x in "bdt"],
        sum(x not in ("su", "ua", "au") for x in near),
        cost,
        audit,
        hashlib.sha256(repaired(pairs, audit).encode()).hexdigest(),
    )


def in_order(rows):
    def key(row):
        turn, role, text = row
        role, text = " " if role is None else role, " " if text is None else text
        return turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest()

    return sorted(rows, key=key)


def found(df):
    result = conversations.repair(df)
    sums = {r.conv: r.sha256 for r in conversations.digests(result.rows).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {
        r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                 sums.get(r.conv, empty))
        for r in result.summary.collect()
    }


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def expected(rows):
    talks = defaultdict(list)
    for conv, *row in rows:
        talks[conv].append(tuple(row))
    return {conv: brute(in_order(own)) for conv, own in talks.items()}


def some_rows(rng, conv, n):
    roles = ["system", "user", "assistant", "tool", "", "User", None]
    texts = ["Yes.", "no", "", " \n", "What?", "And so on", "é!", None]
    weights = [2, 9, 9, 1, 0.3, 0.3, 0.3]
    return [
        (conv, rng.choice([k, k, k, k + 1, None]), rng.choices(roles, weights)[0],
         rng.choice(texts) if rng.random() < 0.4 else f"Line {k}" + rng.choice([".", "", "!"]))
        for k in range(n)
    ]


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = [r for conv in range(250) for r in some_rows(rng, conv, rng.randrange(1, 13))]
    rows += [(None, *r[1:]) for r in some_rows(rng, 0, 9)]
    assert found(frame(spark, rows)) == expected(rows)


def test_cheapest_of_equal_cost_is_the_least_audit():
    for rows in ["u", "a", "s", "su", "uu", "aa", "au", "uua", "uaa", "ssua", "usua", "suua"]:
        row = [conversations.Row(0, 0, n, x, "", n) for n, x in enumerate(rows)]
        piece = conversations.whole_piece(row)
        names = {"u": "user", "a": "assistant", "s": "system"}
        pairs = tuple((names[x], f"{n}.") for n, x in enumerate(rows))
        assert (piece["cost"], piece["audit"]) == cheapest(pairs, ("",) * len(rows)), rows


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_a_conversation_over_many_tasks_is_parsed_the_same(cuts):
    """Pieces chained give what one parse gives, at every cut, long audits put aside or not."""
    rng = random.Random(cuts)
    for n in (3, 40, 1500):
        rows = [
            conversations.Row(1, 0, k // 2, rng.choice("suuaaax"), rng.choice(["", "", "t", "d"]), k)
            for k in range(n)
        ]
        whole = conversations.whole_piece(rows)
        at = sorted(rng.sample(range(1, n), cuts)) if n > cuts else []
        parts = [rows[a:b] for a, b in zip([0, *at], [*at, n])]
        pieces = [conversations.edge_piece([r._replace(part=p) for r in own]) for p, own in enumerate(parts)]
        chained = conversations.chained(pieces)
        assert {k: chained[0][k] for k in whole if k not in ("edits", "part", "done")} == {
            k: whole[k] for k in whole if k not in ("edits", "part", "done")
        }
        assert [e for piece in chained for e in piece["edits"]] == whole["edits"]


def test_one_conversation_with_most_rows_is_spread(spark):
    rng = random.Random(9)
    rows = some_rows(rng, 7, 900)[:900]
    rows = [(c, None if t is None else t * 3, r, x) for c, t, r, x in rows]
    rows += [r for conv in range(8, 30) for r in some_rows(rng, conv, 4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = conversations.repair(frame(spark, rows))
        parts = result.rows.filter("conv = 7").select("part").distinct().count()
        assert parts > 3
        counts = result.rows.filter("_row IS NOT NULL").count()
        assert counts == len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, 1, "user", "Same.")] * 50 + [(1, 2, "assistant", "y " * 300_000 + ".")]
    rows += [(2, None, None, None)] * 3
    assert found(frame(spark, rows)) == expected(rows)
    assert found(frame(spark, rows))[1][6] == "K" + "D" * 49 + "K"


def test_empty_table_and_further_columns(spark):
    assert found(frame(spark, [])) == {}
    df = frame(spark, [(1, 1, "user", "Hi."), (1, 2, "assistant", "Ho.")])
    for name in ("part", "at", "conv", "_row", "digest", "audit"):
        df = df.withColumn(name, F.lit("mine"))
    assert found(df)[1][5:7] == (0, "KK")


def test_query(spark):
    """The registered query against the contract, row after row."""
    talks = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    left = {r.conv_id: [] for r in talks}
    for r in sorted(talks, key=lambda r: (r.conv_id, r.turn)):
        code = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role = "user" if code == 4 else r.role
        text = "" if code == 1 else re.sub("[.!?]", "", r.text) if code == 2 else r.text
        left[r.conv_id] += [(r.turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    rows = conversations.query(spark, SF_DIR).collect()
    assert {tuple(r) for r in rows} == {(conv, *brute(own)) for conv, own in left.items()}
    assert len(rows) == len(left)
