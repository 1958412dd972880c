"""Secrets found by regular expressions over an inverted index of trigrams.

From the syntax of each rule a Boolean query over trigrams is derived: every match must hold, for one of
the alternatives, all of its trigrams. The index has a posting list for each trigram that some query
names (no other list would be read): per block of documents, the sorted places of those that hold it,
letters folded to lower case. Intersecting and joining posting lists gives the candidates of each rule,
whose texts are then matched; a rule whose query demands nothing is matched against every text.

Everything is built from Spark's own functions. A block has BLOCK_ROWS documents, so a posting list is
bounded however common its trigram. A posting is made in the task that reads the text; texts move once,
when candidates meet them.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as C
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lunario.llm.common import addressed, written

#: Documents of a block, the unit of the posting lists.
BLOCK_ROWS = 4096
#: Alternatives a query may have, and characters of a class that are still told apart.
ALTERNATIVES, CLASS = 64, 4


class Rule(NamedTuple):
    """A kind of secret: a match counts if its ``group`` has ``least`` characters or more.

    Patterns are understood alike by Java and Python. Matches are leftmost and do not overlap, and none
    may be empty.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three kinds of the contract, then well-known forms of keys and tokens.
BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

SPANS = "array<struct<start: bigint, rule: int, kind: string, end: bigint>>"

# --- trigram queries ------------------------------------------------------------------------------

#: A query is a set of alternatives, each a set of trigrams that must all occur.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset({frozenset()})


def _least(query: Query) -> Query:
    """Without alternatives that demand more than another one."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    made = _least(frozenset(x | y for x in a for y in b))
    return made if len(made) <= ALTERNATIVES else min(a, b, key=len)


def _either(a: Query, b: Query) -> Query:
    made = _least(a | b)
    return made if len(made) <= ALTERNATIVES else ALWAYS


def _holding(texts: frozenset[str]) -> Query:
    """Query of a match that holds one of these texts."""
    return _least(frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts))


class Part(NamedTuple):
    """What is known of the matches of a part of a pattern: all of them if they are few (``exact``),
    what they begin and end with, and a query that they satisfy."""

    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: Query


_EMPTY = frozenset({""})
UNKNOWN = Part(None, _EMPTY, _EMPTY, ALWAYS)


def _known(texts: frozenset[str]) -> Part:
    return Part(texts, texts, texts, ALWAYS)


def _opened(part: Part) -> Part:
    """A part whose matches are no longer all kept, with what they hold in its query."""
    if part.exact is None:
        return part
    return Part(None, part.exact, part.exact, _holding(part.exact))


def _joined(a: Part, b: Part) -> Part:
    def cross(x: frozenset[str], y: frozenset[str]) -> frozenset[str]:
        return frozenset(u + v for u in x for v in y)

    if a.exact is not None and b.exact is not None:
        both = cross(a.exact, b.exact)
        if len(both) <= ALTERNATIVES:
            return _known(both)
    met = cross(a.suffix, b.prefix)
    x, y = _opened(a), _opened(b)
    query = _both(x.query, y.query)
    if len(met) <= ALTERNATIVES:
        query = _both(query, _holding(met))
    prefix = met if a.exact is not None and len(met) <= ALTERNATIVES else a.prefix
    suffix = met if b.exact is not None and len(met) <= ALTERNATIVES else b.suffix
    return Part(None, prefix, suffix, query)


def _alternative(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= ALTERNATIVES:
        return _known(a.exact | b.exact)
    x, y = _opened(a), _opened(b)
    if len(x.prefix | y.prefix) > ALTERNATIVES or len(x.suffix | y.suffix) > ALTERNATIVES:
        return Part(None, _EMPTY, _EMPTY, _either(x.query, y.query))
    return Part(None, x.prefix | y.prefix, x.suffix | y.suffix, _either(x.query, y.query))


def _class(items: list) -> Part:
    chars: set[str] = set()
    for kind, value in items:
        if kind == C.LITERAL:
            chars.add(chr(value).lower())
        elif kind == C.RANGE and value[1] - value[0] < 64:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return UNKNOWN
    return _known(frozenset(chars)) if 0 < len(chars) <= CLASS else UNKNOWN


def _part(node: tuple) -> Part:
    kind, value = node
    if kind == C.LITERAL:
        return _known(frozenset({chr(value).lower()}))
    if kind == C.IN:
        return _class(value)
    if kind == C.SUBPATTERN:
        return _sequence(value[-1])
    if kind == C.BRANCH:
        return reduce(_alternative, [_sequence(x) for x in value[1]])
    if kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return _known(_EMPTY)
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, item = value
        inner = _sequence(item)
        if low == 0:
            return _alternative(inner, _known(_EMPTY)) if high == 1 else UNKNOWN
        if low == high and low <= 8:
            return reduce(_joined, [inner] * low)
        return _opened(inner) if low == 1 else _joined(_opened(inner), _opened(inner))
    return UNKNOWN


def _sequence(nodes) -> Part:
    return reduce(_joined, map(_part, nodes), _known(_EMPTY))


def trigram_query(pattern: str) -> Query:
    """Trigrams (lower case) that every match of a pattern holds, as alternatives of sets."""
    return _opened(_sequence(_parser.parse(pattern))).query


# --- index ----------------------------------------------------------------------------------------


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Posting lists of texts named by ``_id``: ``file``, ``block``, ``postings`` (trigram to places).

    ``rows`` has ``_id`` (file_path and row_index) and ``text``.
    """
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), t) for t in trigrams]))
    entries = rows.select("_id", F.lower("text").alias("folded")).select(
        F.col("_id.file_path").alias("file"),
        F.floor(F.col("_id.row_index") / BLOCK_ROWS).alias("block"),
        (F.col("_id.row_index") % BLOCK_ROWS).cast("int").alias("place"),
        F.explode(held).alias("trigram"),
    )
    lists = entries.groupBy("file", "block", "trigram").agg(
        F.array_sort(F.collect_list("place")).alias("places")
    )
    return lists.groupBy("file", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("trigram", "places"))).alias("postings")
    )


def _places(query: Query) -> Column:
    """Places that satisfy a query, from the posting lists of a block."""
    none = F.array().cast("array<int>")

    def posting(trigram: str) -> Column:
        return F.coalesce(F.col("postings")[trigram], none)

    each = [reduce(F.array_intersect, map(posting, sorted(a))) for a in sorted(query, key=sorted)]
    return reduce(F.array_union, each)


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """``_id`` and ``bits``: bit n is set if the text may match the rule n."""
    by_rule = F.array(
        *[F.struct(F.lit(1 << n).cast("long").alias("bit"), _places(q).alias("places"))
          for n, q in queries.items()]
    )
    found = index.select("file", "block", F.explode(by_rule).alias("rule")).select(
        "file", "block", "rule.bit", F.explode("rule.places").alias("place")
    )
    return found.groupBy("file", "block", "place").agg(F.sum("bit").alias("bits")).select(
        F.struct(
            F.col("file").alias("file_path"),
            (F.col("block") * BLOCK_ROWS + F.col("place")).cast("long").alias("row_index"),
        ).alias("_id"),
        "bits",
    )


# --- matches --------------------------------------------------------------------------------------


def _matches(rows: DataFrame, number: int, rule: Rule) -> DataFrame:
    """``_id``, ``rule``, ``at`` and, per match, the sizes of the gap before it, of it and its group.

    A text is split at the matches, so their places follow from the sizes of what lies between.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)

    def sizes(parts: Column) -> Column:
        return F.transform(parts, lambda x: F.char_length(x))

    found = F.arrays_zip(
        sizes(F.split(text, rule.pattern, -1)).alias("gap"),
        sizes(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        sizes(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("counted"),
    )
    return (
        rows.select("_id", F.lit(number).alias("rule"), F.posexplode(found).alias("at", "m"))
        .select("_id", "rule", "at", "m.gap", "m.size", "m.counted")
        .filter("size IS NOT NULL")  # the rest of the text after the last match
    )


def _counting(rule: Rule) -> Rule:
    """A rule that is one class repeated, such that only runs long enough match: they are the same."""
    if rule.group == 0 and re.fullmatch(r"\[[^\\\]]+\]\+", rule.pattern):
        return rule._replace(pattern=f"{rule.pattern[:-1]}{{{rule.least},}}")
    return rule


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``_doc`` (the columns of ``docs`` but the text) and ``spans``, one row per row of ``docs``.

    ``spans`` holds (start, rule, kind, end) by start, then rule in the order given; places are code
    points, ends are exclusive. NULL counts as empty. Repeated rows each have their spans; an empty
    table gives an empty result.
    """
    if len({r.kind for r in rules}) < len(rules) or len(rules) > 62:
        raise ValueError("rules need different kinds, 62 at most")
    named = addressed(docs)
    rest = F.struct(*[F.col("_all")[c].alias(c) for c in docs.columns if c != text])
    rows = named.select("_id", F.coalesce(F.col("_all")[text], F.lit("")).alias("text"))
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    indexed = {n: q for n, q in queries.items() if frozenset() not in q}
    parts = []
    if indexed:
        trigrams = sorted({t for q in indexed.values() for a in q for t in a})
        index = written(build_index(rows, trigrams), "trigrams")
        # candidates grow with the texts, so the join is the same at every size and never a broadcast
        bits = candidates(index, indexed).hint("merge")
        met = written(rows.join(bits, "_id").select("_id", "text", "bits"), "candidates")
        for n in indexed:
            parts.append(_matches(met.filter(F.col("bits").bitwiseAND(1 << n) != 0), n, rules[n]))
    for n in queries:
        if n not in indexed:
            rule = _counting(rules[n])
            parts.append(_matches(rows.filter(F.rlike("text", F.lit(rule.pattern))), n, rule))
    found = reduce(DataFrame.unionByName, parts)
    # what lies before a match: all gaps up to it and all matches before it
    before = Window.partitionBy("_id", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    spans = (
        found.withColumn("end", end)
        .filter(F.col("counted") >= least)
        .groupBy("_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct((F.col("end") - F.col("size")).alias("start"), "rule", kind.alias("kind"), "end")
                )
            ).alias("spans")
        )
    )
    every = named.select("_id", rest.alias("_doc"))
    return every.join(spans, "_id", "left").select(
        "_doc", F.coalesce(F.col("spans").cast(SPANS), F.array().cast(SPANS)).alias("spans")
    )


# --- query ----------------------------------------------------------------------------------------


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("spans")

    def listed(own: Column) -> Column:
        return F.array_join(
            F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter(spans, lambda s: s["rule"] < len(BASE))

    def counted(n: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rule"] == n)).cast("long")

    return scan(docs).select(
        F.col("_doc")["doc_id"].alias("doc_id"),
        *[counted(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def _either_case(pattern: str) -> str:
    """A pattern with every ASCII letter of its words as a class of both cases."""
    words = re.compile(r"password|passwd|secret|token|api|key")
    return words.sub(lambda m: "".join(f"[{c.upper()}{c}]" for c in m.group()), pattern)


def _sql() -> str:
    """Spans by splitting the texts in SQL."""
    parts = []
    for n, rule in enumerate(RULES):
        pattern = _either_case(rule.pattern.removeprefix("(?i)")) if "(?i)" in rule.pattern else rule.pattern
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {n} AS rule, '{rule.kind}' AS kind, {rule.least} AS least, "
            f"regexp_split_to_array(body, {quoted}) AS gaps, "
            f"regexp_extract_all(body, {quoted}, 0) AS whole, "
            f"regexp_extract_all(body, {quoted}, {rule.group}) AS counted FROM docs"
        )
    counts = ", ".join(
        f"count(*) FILTER (rule = {n}) AS n_{r.kind}" for n, r in enumerate(BASE)
    )
    item = "kind || ':' || start || ':' || stop"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
cut AS ({" UNION ALL ".join(parts)}),
places AS (
  SELECT doc_id, rule, kind, least, nth, length(whole[nth]) AS size, length(counted[nth]) AS counted,
    sum(length(gaps[nth]) + length(whole[nth])) OVER (PARTITION BY doc_id, rule ORDER BY nth) AS stop
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS nth FROM cut)
),
hits AS (
  SELECT doc_id, rule, kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
  FROM places WHERE counted >= least
),
found AS (
  SELECT doc_id, {counts},
    sha256(coalesce(string_agg({item}, ',' ORDER BY start, rule) FILTER (rule < {len(BASE)}), ''))
      AS base_sha256,
    string_agg({item}, ',' ORDER BY start, rule) AS spans
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""


SQL = _sql()
