"""Repair of conversation structure by generalised LR parsing with weighted edits.

The roles of a conversation must form a sentence of RULES. A parser with a graph-structured stack reads
them: a node is an LR state upon the node below it, equal stacks are one node, and what lies below is
shared. Each row may be kept, given another role or deleted, and rows may be inserted anywhere; of all
ways to reach the same stack only the least (cost, audit) stays, where the audit is the sequence of edit
initials. That is exact: after the same rows no audit of equal cost is the beginning of another one
(it would differ by inserts alone), so what follows cannot turn the order of two of them round.

Rows are range-sorted by conversation and turn, so one conversation may spread over many tasks. A task
parses the conversations that lie inside it at once. The two at its edges may go on elsewhere: for
those it returns the least (cost, audit) from every stack at its first row to every stack after its
last, and these few pieces are chained per conversation. Texts are not needed for any of this and stay
where they are; identity of texts is that of their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lunario.llm.common import numbered, written

# The grammar of roles (s system, u user, a assistant) and the costs of edits.
RULES = (
    ("talk", ()),
    ("talk", ("turns",)),
    ("talk", ("s", "turns")),
    ("turns", ("turns", "turn")),
    ("turns", ("turn",)),
    ("turn", ("u", "a")),
)
ROLES = {"u": "user", "a": "assistant"}
INITIALS = ("s", *ROLES)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Pairs of neighbouring initials that occur in a sentence.
LEGAL = ("su", "ua", "au")
#: White space of the contract, as characters.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows after which what the audits begin with is put aside, so that no step copies a long audit.
PUT_ASIDE = 256
ROWS_AT_ONCE = 1 << 14


# --- parser ---------------------------------------------------------------------------------------


@cache
def _closure(kernel: frozenset[tuple[int, int]]) -> frozenset[tuple[int, int]]:
    """All (rule, dot) items of the state with these kernel items."""
    items, todo = set(kernel), list(kernel)
    while todo:
        rule, dot = todo.pop()
        for symbol in RULES[rule][1][dot : dot + 1]:
            for n, (left, _) in enumerate(RULES):
                if left == symbol and (n, 0) not in items:
                    items.add((n, 0))
                    todo.append((n, 0))
    return frozenset(items)


@cache
def _goto(state: frozenset, symbol: str) -> frozenset | None:
    moved = {(r, d + 1) for r, d in state if RULES[r][1][d : d + 1] == (symbol,)}
    return _closure(frozenset(moved)) if moved else None


class Node:
    """A stack: an LR state upon a node. Equal stacks are the same object; ``number`` names it."""

    known: dict[tuple[int | None, frozenset], Node] = {}
    numbered: list[Node] = []

    def __init__(self, state: frozenset, below: Node | None):
        self.state, self.below, self.number = state, below, len(Node.numbered)
        self.accepts = any(RULES[r] == ("talk", RULES[r][1][:d]) for r, d in state)
        self.after: dict[str, tuple[Node, ...]] = {}

    @staticmethod
    def of(state: frozenset, below: Node | None) -> Node:
        key = (None if below is None else below.number, state)
        if key not in Node.known:
            Node.known[key] = Node(state, below)
            Node.numbered.append(Node.known[key])
        return Node.known[key]

    def shift(self, symbol: str) -> tuple[Node, ...]:
        """Stacks after reading a role here, with all reductions but those that end the sentence."""
        if symbol not in self.after:
            state = _goto(self.state, symbol)
            self.after[symbol] = () if state is None else tuple(Node.of(state, self)._reduced())
        return self.after[symbol]

    def _reduced(self) -> list[Node]:
        found = []
        if self.accepts or any(RULES[r][1][d : d + 1] for r, d in self.state):
            found.append(self)
        for rule, dot in sorted(self.state):
            left, right = RULES[rule]
            if dot == len(right) > 0 and left != "talk":
                top = self
                for _ in right:
                    top = top.below
                found += Node.of(_goto(top.state, left), top)._reduced()
        return found


START = Node.of(_closure(frozenset((n, 0) for n, (left, _) in enumerate(RULES) if left == "talk")), None)


def _stacks() -> tuple[Node, ...]:
    found, todo = [START], [START]
    while todo:
        node = todo.pop()
        for symbol in INITIALS:
            for after in node.shift(symbol):
                if after not in found:
                    found.append(after)
                    todo.append(after)
    return tuple(found)


#: All stacks between two rows; the grammar is left-recursive, so they are few. They are made here, so
#: that a stack has the same number in every process.
STACKS = _stacks()


class Frontier:
    """The stacks reached so far, each with its least (cost, rank, tail).

    An audit is what was put aside under its rank, and its tail. Ranks follow the order of what was
    put aside; those parts differ before either ends, since trailing inserts stay in the tail.
    """

    def __init__(self, start: Node):
        self.best = {start: (0, 0, "")}
        self.aside: list[tuple | None] = [None]
        self.since = 0

    @staticmethod
    def _offer(best: dict, node: Node, found: tuple[int, int, str]) -> bool:
        if node in best and best[node] <= found:
            return False
        best[node] = found
        return True

    def inserted(self) -> None:
        """Take every useful sequence of inserts here."""
        todo = list(self.best)
        while todo:
            node = todo.pop()
            cost, rank, tail = self.best[node]
            for symbol in ROLES:
                for after in node.shift(symbol):
                    if self._offer(self.best, after, (cost + INSERT, rank, tail + "I")):
                        todo.append(after)

    def read(self, initial: str, fault: str) -> None:
        """Take one row: its role's initial and its fault (blank, duplicate, truncated or none)."""
        best: dict[Node, tuple[int, int, str]] = {}
        extra = TRUNCATED if fault == "t" else 0
        for node, (cost, rank, tail) in self.best.items():
            self._offer(best, node, (cost + DELETE, rank, tail + "D"))
            if fault in ("b", "d"):
                continue
            for after in node.shift(initial) if initial in INITIALS else ():
                self._offer(best, after, (cost + extra, rank, tail + "K"))
            for symbol in ROLES:
                if symbol != initial:
                    for after in node.shift(symbol):
                        self._offer(best, after, (cost + extra + REROLE, rank, tail + "R"))
        self.best = best
        self.inserted()
        self.since += 1
        if self.since >= PUT_ASIDE:
            self.put_aside()

    def put_aside(self) -> None:
        heads = sorted({(rank, tail.rstrip("I")) for _, rank, tail in self.best.values()})
        place = {head: n for n, head in enumerate(heads)}
        self.best = {
            node: (cost, place[rank, body], tail[len(body) :])
            for node, (cost, rank, tail) in self.best.items()
            for body in [tail.rstrip("I")]
        }
        self.aside = [(self.aside[rank], body) for rank, body in heads]
        self.since = 0

    def audit(self, node: Node) -> str:
        _, rank, tail = self.best[node]
        parts, link = [tail], self.aside[rank]
        while link is not None:
            link, body = link
            parts.append(body)
        return "".join(reversed(parts))

    def end(self) -> Node:
        """The accepting stack with the least (cost, audit)."""
        return min((n for n in self.best if n.accepts), key=self.best.get)


def edits(audit: str, rows: Iterable[tuple[int, str]]) -> Iterator[tuple[int | None, str, str | None]]:
    """(row, action, new role) for the letters of an audit; rows are (row, initial) in order."""
    node, rows = START, iter(rows)
    for action in audit:
        row, symbol = (None, "") if action == "I" else next(rows)
        if action == "D":
            yield row, action, None
            continue
        if action != "K":
            symbol = next(s for s in ROLES if node.shift(s))  # a stack takes one of them, never both
        node = node.shift(symbol)[0]
        yield row, action, None if action == "K" else ROLES[symbol]


# --- conversations on Spark -----------------------------------------------------------------------


class Row(NamedTuple):
    conv: object
    part: int
    turn: int | None
    initial: str
    fault: str
    row: int


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PIECE = (
    "part int, head boolean, done boolean, first_turn long, last_turn long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "edits array<struct<row: long, action: string, role: string>>, "
    "ways array<struct<entry: int, exit: int, cost: long, audit: string>>, "
    "members array<struct<row: long, initial: string>>"
)


def _piece_type(conv: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(_PIECE)])


def _counted(rows: list[Row]) -> dict:
    turns = [r.turn for r in rows if r.turn is not None]
    pairs = zip(rows, rows[1:], strict=False)
    return {
        "conv": rows[0].conv,
        "part": rows[0].part,
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "turns": len(set(turns)),
        "blank": sum(r.fault == "b" for r in rows),
        "duplicate": sum(r.fault == "d" for r in rows),
        "truncated": sum(r.fault == "t" for r in rows),
        "illegal": sum(a.initial + b.initial not in LEGAL for a, b in pairs),
    }


def _parsed(rows: list[Row], start: Node) -> Frontier:
    frontier = Frontier(start)
    frontier.inserted()
    for r in rows:
        frontier.read(r.initial, r.fault)
    return frontier


def _edit_rows(audit: str, rows: Iterable[tuple[int, str]]) -> list[dict]:
    return [{"row": r, "action": a, "role": role} for r, a, role in edits(audit, rows)]


def whole_piece(rows: list[Row]) -> dict:
    """A conversation that lies in one task."""
    frontier = _parsed(rows, START)
    end = frontier.end()
    audit = frontier.audit(end)
    return _counted(rows) | {
        "head": True,
        "done": True,
        "cost": frontier.best[end][0],
        "audit": audit,
        "edits": _edit_rows(audit, [(r.row, r.initial) for r in rows]),
    }


def edge_piece(rows: list[Row]) -> dict:
    """The part of a conversation at the edge of a task: ways from every stack to every stack."""
    ways = []
    for node in STACKS:
        frontier = _parsed(rows, node)
        ways += [
            {"entry": node.number, "exit": n.number, "cost": best[0], "audit": frontier.audit(n)}
            for n, best in frontier.best.items()
        ]
    members = [{"row": r.row, "initial": r.initial} for r in rows]
    return _counted(rows) | {"head": False, "done": False, "ways": ways, "members": members}


def chained(pieces: list[dict]) -> list[dict]:
    """The pieces of one conversation in order, resolved; the first carries the whole conversation."""
    frontier = Frontier(START)
    for piece in pieces:
        best: dict[Node, tuple[int, int, str]] = {}
        for way in piece["ways"]:
            entry = Node.numbered[way["entry"]]
            if entry in frontier.best:
                cost, rank, tail = frontier.best[entry]
                found = (cost + int(way["cost"]), rank, tail + way["audit"])
                Frontier._offer(best, Node.numbered[way["exit"]], found)
        frontier.best = best
        frontier.put_aside()
    end = frontier.end()
    audit = frontier.audit(end)
    members = [m for piece in pieces for m in piece["members"]]
    made = _edit_rows(audit, [(m["row"], m["initial"]) for m in members])
    totals = {name: sum(int(p[name]) for p in pieces) for name in (*_COUNTS, "turns")}
    ends = zip(pieces, pieces[1:], strict=False)
    for left, right in ends:
        pair = left["members"][-1]["initial"] + right["members"][0]["initial"]
        totals["illegal"] += pair not in LEGAL
    known = [p for p in pieces if not pd.isna(p["first_turn"])]
    for left, right in zip(known, known[1:], strict=False):
        totals["turns"] -= left["last_turn"] == right["first_turn"]
    out, at = [], 0
    for piece in pieces:
        # a piece has its own rows and the inserts after them, the first also those before
        stop, left = at, len(piece["members"])
        while stop < len(made) and (left or made[stop]["row"] is None):
            left -= made[stop]["row"] is not None
            stop += 1
        out.append({"conv": piece["conv"], "part": piece["part"], "head": False, "done": True,
                    "edits": made[at:stop]})
        at = stop
    out[0] |= totals | {
        "head": True,
        "first_turn": known[0]["first_turn"] if known else None,
        "last_turn": known[-1]["last_turn"] if known else None,
        "cost": frontier.best[end][0],
        "audit": audit,
    }
    return out


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[Row]:
    for batch in batches:
        yield from map(Row._make, zip(*[c.to_pylist() for c in batch.columns], strict=True))


def _conversations(rows: Iterable[Row]) -> Iterator[list[Row]]:
    own: list[Row] = []
    for row in rows:
        if own and row.conv != own[0].conv:
            yield own
            own = []
        own.append(row)
    if own:
        yield own


def _pieces(rows: Iterable[Row]) -> Iterator[dict]:
    """Pieces of a task's rows; only its first and its last conversation may go on elsewhere."""
    last, first = None, True
    for own in _conversations(rows):
        if last is not None:
            yield edge_piece(last) if first else whole_piece(last)
            first = False
        last = own
    if last is not None:
        yield edge_piece(last)


class Repair(NamedTuple):
    """``summary``: a row per conversation; ``rows``: its rows after the repair, and deleted ones.

    ``summary`` has ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``
    and ``audit``. ``rows`` has ``conv``, the order ``part`` and ``at``, ``action`` (K, R, D, I),
    ``role``, ``text`` and ``_row``, which is NULL for inserted rows.
    """

    summary: DataFrame
    rows: DataFrame


def repair(
    talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """Find the cheapest repair of every conversation.

    NULL roles and texts count as one space. Rows are taken by turn, NULL first; rows of one turn by
    role, then by the digest of their text, so equal rows are neighbours. A role is known by its first
    letter (s, u, a, case matters); any other or empty role cannot be kept. Rows without a
    conversation (NULL) are one conversation. Further columns of ``talks`` are ignored. An empty table
    gives empty results.
    """
    lines = written(
        numbered(
            talks.select(
                F.col(conv).alias("conv"),
                F.col(turn).cast("long").alias("turn"),
                F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                F.coalesce(F.col(text), F.lit(" ")).alias("text"),
            )
        ),
        "lines",
    )
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = lines.select(
        "_row", "conv", "turn", "role",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (body == "").alias("blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    # the earliest row of each role and text; equal rows of one turn are told apart by number
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "_row")
    firsts = slim.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"))
    marked = slim.join(firsts.select(F.col("first._row").alias("_row"), F.lit(True).alias("new")), "_row", "left")
    fault = (
        F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(F.col("cut"), "t").otherwise("")
    )
    ready = written(
        marked.select(
            "conv", "turn", "role", "digest", "_row",
            F.substring("role", 1, 1).alias("initial"), fault.alias("fault"),
        ),
        "marked",
    )
    order = ["conv", "turn", "role", "digest", "_row"]
    ranged = ready.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.spark_partition_id().alias("part"), "turn", "initial", "fault", "_row"
    )
    kind = _piece_type(ready.schema["conv"].dataType)
    names = kind.names

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(kind)
        held, size = [], 0
        for piece in _pieces(_rows(batches)):
            held.append({name: piece.get(name) for name in names})
            size += len(piece.get("edits") or piece["members"])
            if size >= ROWS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    def chain(table: pa.Table) -> pa.Table:
        found = chained(sorted(table.to_pylist(), key=lambda piece: piece["part"]))
        return pa.Table.from_pylist(
            [{name: piece.get(name) for name in names} for piece in found], schema=to_arrow(kind)
        )

    pieces = written(ranged.mapInArrow(parse, kind), "pieces")
    joined = pieces.filter("NOT done").groupBy("conv").applyInArrow(chain, kind)
    solved = written(pieces.filter("done").unionByName(joined), "repaired")
    summary = solved.filter("head").select(
        "conv",
        F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        *_COUNTS, "cost", "audit",
    )
    each = solved.select("conv", "part", F.posexplode("edits").alias("at", "edit")).select(
        "conv", "part", "at", "edit.action", F.col("edit.role").alias("new_role"),
        F.col("edit.row").alias("_row"),
    )
    own = lines.select("_row", "role", "text")
    rows = each.join(own, "_row", "left").select(
        "conv", "part", "at", "action",
        F.coalesce("new_role", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        "_row",
    )
    return Repair(summary, rows)


def to_arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's lines ``role:text`` joined by line feeds.

    A digest is made byte after byte, so the lines of one conversation pass through one task; they
    stream, in order, and only the running digest is held.
    """
    kind = T.StructType([rows.schema["conv"], T.StructField("sha256", T.StringType())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, open_, done = to_arrow(kind), None, []
        for batch in batches:
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if open_ is not None and open_[0] == conv:
                    open_[1].update(b"\n" + line)
                    continue
                if open_ is not None:
                    done.append({"conv": open_[0], "sha256": open_[1].hexdigest()})
                open_ = (conv, hashlib.sha256(line))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if open_ is not None:
            last = {"conv": open_[0], "sha256": open_[1].hexdigest()}
            yield pa.RecordBatch.from_pylist([last], schema=schema)

    line = F.concat_ws(":", "role", "text").cast("binary")
    ordered = rows.filter("action <> 'D'").select("conv", "part", "at", line.alias("line"))
    return (
        ordered.repartition("conv").sortWithinPartitions("conv", "part", "at")
        .select("conv", "line").mapInArrow(take, kind)
    )


# --- query ----------------------------------------------------------------------------------------


def damaged(talks: DataFrame) -> DataFrame:
    """Rows with faults set by the CRC-32 of conversation and turn: dropped, emptied, without sentence
    ends, repeated, or given the role user."""

    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    code = F.crc32(F.concat_ws(":", named("conv_id"), named("turn"))) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        talks.select("conv_id", "turn", "role", text.alias("text"), code.alias("_code"))
        .filter("_code <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_code") == 1, "")
            .when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
            .alias("_copy"),
        )
        .drop("_copy")
    )


def query(spark, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damaged(talks))
    ids = talks.select("conv_id").distinct()
    whole = ids.join(found.summary, ids.conv_id.eqNullSafe(found.summary.conv), "left").drop("conv")
    digest = digests(found.rows)
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", *_COUNTS, "cost")]
    return whole.join(digest, whole.conv_id.eqNullSafe(digest.conv), "left").select(
        "conv_id", *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
