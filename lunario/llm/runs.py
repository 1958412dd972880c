"""Runs of words that repeat periodically, located by block convolution.

A run is a longest stretch whose words are equal at distance q, its smallest period, and which is at
least EXPONENT periods and LEAST words long. At each dyadic scale B the words are cut into blocks of B,
and each block is laid on the window of 2B words after it: the sum of squared differences of the word
numbers is zero exactly where the block occurs again. All these sums are cross-correlations, computed by
number-theoretic transforms of length 2B modulo primes whose product exceeds any possible sum, so zero
means equal, without rounding. A run with a period from B to 2B - 1 holds two neighbouring blocks at
least that recur at the distance of its period; each maximal chain of such blocks seeds one extension to
both sides, by less than a block.

Before the first scale, words that occur fewer than EXPONENT times in their stretch are taken for
barriers, which split it, over and over: no run holds such a word. What is left of a batch of texts is
worked on as one array, so a scale costs a few array operations however short the texts are. A text is
one row and is worked on in one task, in memory proportional to its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lunario.llm.common import BLANK

#: A run has EXPONENT periods and LEAST words at least; two blocks of a chain need EXPONENT >= 4.
EXPONENT, LEAST = 4, 6
# Primes c * 2**k + 1 below 2**31 with k >= 26, each with a generator of its residues.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Bytes of text worked on as one array, and elements of one block of transforms.
BYTES_AT_ONCE, ELEMENTS = 1 << 22, 1 << 18
#: Rounds of splitting at rare words; more would only save work.
ROUNDS = 8


# --- convolution ----------------------------------------------------------------------------------


@cache
def _powers(prime: int, generator: int, size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity of each level, for halves size/2, size/4, ..., 1."""
    levels, half = [], size // 2
    while half:
        root = pow(generator, (prime - 1) // (2 * half), prime)
        if inverse:
            root = pow(root, -1, prime)
        powers = np.ones(half, dtype=np.uint64)
        done = 1
        while done < half:  # doubling: w^(i + done) = w^i * w^done
            step = np.uint64(pow(root, done, prime))
            powers[done : 2 * done] = powers[:done] * step % np.uint64(prime)
            done *= 2
        levels.append(powers[:, None])
        half //= 2
    return levels


def _reduce(a: np.ndarray, prime: np.uint64) -> np.ndarray:
    """a modulo prime, in place."""
    whole = a // prime
    whole *= prime
    a -= whole
    return a


def _forward(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transform along axis 0, results in bit-reversed order."""
    p, size = np.uint64(prime), a.shape[0]
    for powers in _powers(prime, generator, size, False):
        half = len(powers)
        pairs = a.reshape(-1, 2, half, a.shape[1])
        u, v = pairs[:, 0], pairs[:, 1]
        low = u + v
        high = u + p
        high -= v
        high *= powers
        pairs[:, 0] = np.minimum(low, low - p)
        pairs[:, 1] = _reduce(high, p)
    return a


def _backward(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Inverse of ``_forward`` times the length."""
    p, size = np.uint64(prime), a.shape[0]
    for powers in reversed(_powers(prime, generator, size, True)):
        half = len(powers)
        pairs = a.reshape(-1, 2, half, a.shape[1])
        u, v = pairs[:, 0], pairs[:, 1] * powers
        _reduce(v, p)
        low = u + v
        high = u + p
        high -= v
        pairs[:, 0] = np.minimum(low, low - p)
        pairs[:, 1] = np.minimum(high, high - p)
    return a


def recurrences(x: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of every place, ``size`` to ``2 * size - 1`` on, where a block occurs again.

    ``x`` are word numbers, followed by 3 * ``size`` zeros; ``blocks`` are block numbers.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    top = int(x.max(initial=0))
    primes, reach = [], 1
    for prime in PRIMES:
        primes.append(prime)
        reach *= prime[0]
        if size * top * top < reach:
            break
    else:
        raise ValueError("too many different words in one text")
    rows = max(1, ELEMENTS // (2 * size))
    for at in range(0, len(blocks), rows):
        part = blocks[at : at + rows]
        zero = None
        begin = part * size
        block = x[begin[None, :] + np.arange(size)[:, None]]
        window = x[begin[None, :] + np.arange(size, 3 * size)[:, None]]
        for prime, generator in primes:
            p = np.uint64(prime)
            own = block.astype(np.uint64) % p
            other = window.astype(np.uint64) % p
            # sum of squares of the block, and of each place of the window
            sums = np.zeros((2 * size + 1, len(part)), dtype=np.uint64)
            np.cumsum(other * other % p, axis=0, out=sums[1:])
            squares = (sums[size : 2 * size] - sums[:size]) % p + (own * own % p).sum(axis=0) % p
            # 2 * sum of products must equal that; the block runs backwards for a correlation
            turned = np.zeros((2 * size, len(part)), dtype=np.uint64)
            turned[0] = own[0]
            turned[size + 1 :] = own[:0:-1]
            turned = _forward(turned, prime, generator)
            turned *= _forward(other, prime, generator)
            products = _backward(_reduce(turned, p), prime, generator)[:size]
            # _backward leaves the factor 2 * size; the 2 is wanted
            same = products == squares % p * np.uint64(size) % p
            zero = same if zero is None else zero & same
        shift, column = np.nonzero(zero)
        found.append((part[column], shift + size))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([b for b, _ in found]), np.concatenate([d for _, d in found])


# --- runs -----------------------------------------------------------------------------------------


def _stretches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches without zeros."""
    edge = np.diff(np.concatenate([[0], x != 0, [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def without_rare(x: np.ndarray) -> np.ndarray:
    """Zero what no run can hold: words too rare in their stretch, and stretches too short."""
    x = x.copy()
    for _ in range(ROUNDS):
        starts, ends = _stretches(x)
        sizes = ends - starts
        own = np.repeat(np.arange(len(starts)), sizes)
        at = np.flatnonzero(x)
        _, back, count = np.unique(
            own * (int(x.max(initial=0)) + 1) + x[at], return_inverse=True, return_counts=True
        )
        rare = (count[back] < EXPONENT) | (sizes[own] < LEAST)
        if not rare.any():
            break
        x[at[rare]] = 0
    return x


def _dense(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The stretches end to end, a zero before each, with numbers from 1 in each of them."""
    sizes = ends - starts
    own = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    keys, back = np.unique(own * (int(x.max(initial=0)) + 1) + x[at], return_inverse=True)
    first = np.searchsorted(keys // (int(x.max(initial=0)) + 1), np.arange(len(starts)))
    made = np.zeros(len(own) + len(starts), dtype=np.int64)
    made[np.arange(len(own)) + own + 1] = back - first[own] + 1
    return made


def _extended(x: np.ndarray, start: int, stop: int, distance: int, size: int) -> tuple[int, int]:
    """Longest stretch of places equal to the one ``distance`` on, around [start, stop)."""
    least = max(0, start - size)
    left = x[least:start]
    wrong = np.flatnonzero((left != x[least + distance : start + distance]) | (left == 0))
    start = least + int(wrong[-1]) + 1 if len(wrong) else least
    most = min(len(x) - distance, stop + size)
    right = x[stop:most]
    wrong = np.flatnonzero((right != x[stop + distance : most + distance]) | (right == 0))
    return start, stop + int(wrong[0]) if len(wrong) else most


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of word numbers; zeros are barriers."""
    x = without_rare(x)
    starts, ends = _stretches(x)
    if not len(starts):
        return []
    sizes = ends - starts
    y = _dense(x, starts, ends)
    length, longest = len(y), int(sizes.max())
    # place of a word of y in x, and the size of its stretch
    shift = np.repeat(starts - (np.cumsum(sizes + 1) - sizes), sizes + 1)
    room = np.repeat(sizes, sizes + 1)
    found: dict[tuple[int, int], int] = {}
    covered, period = np.zeros(length, dtype=np.int64), np.ones(length, dtype=np.int64)
    size = 1
    while EXPONENT * size <= longest:
        padded = np.concatenate([y, np.zeros(3 * size + (-length) % size, dtype=np.int64)])
        count = (length + size - 1) // size
        grid = padded[: count * size].reshape(count, size)
        fits = (grid != 0).all(axis=1) & (room[np.arange(count) * size] >= EXPONENT * size)
        near = np.concatenate([[False], fits, [False]])
        blocks = np.flatnonzero(fits & (near[2:] | near[:-2]))
        block, distance = recurrences(padded, blocks, size)
        order = np.lexsort((block, distance))
        block, distance = block[order], distance[order]
        opens = np.ones(len(block), dtype=bool)
        opens[1:] = (np.diff(block) != 1) | (np.diff(distance) != 0)
        first = np.flatnonzero(opens)
        chain = np.diff(np.append(first, len(block)))
        block, distance = block[first], distance[first]
        needed = np.maximum(LEAST, EXPONENT * distance) - distance
        begin = block * size
        # a chain and its copy inside a run found before lie in that run alone
        inside = (begin + distance + size <= covered[begin]) & (distance % period[begin] == 0)
        keep = (chain >= 2) & (chain * size + 2 * (size - 1) >= needed) & ~inside
        new = []
        for b, d, v in zip(begin[keep].tolist(), distance[keep].tolist(), chain[keep].tolist(), strict=True):
            start, stop = _extended(padded, b, b + v * size, d, size)
            if stop - start >= max(LEAST, EXPONENT * d) - d and (start, stop + d) not in found:
                found[start, stop + d] = d
                new.append((stop + d, start, d))
        for stop, start, d in sorted(new):
            own = slice(start, stop)
            later = covered[own] < stop
            covered[own][later], period[own][later] = stop, d
        size *= 2
    return sorted((a + int(shift[a]), b - a, d) for (a, b), d in found.items())


def word_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as its words, by start and period."""
    parts, offsets, at, base = [], [], 0, 0
    for words in texts:
        often = [word for word, n in Counter(words).items() if n >= EXPONENT]
        offsets.append(at)
        if often:
            number = dict(zip(often, range(base + 1, base + len(often) + 1), strict=True))
            base += len(often)
            own = np.fromiter(map(lambda w, get=number.get: get(w, 0), words), np.int64, len(words))
            parts += [own, np.zeros(1, dtype=np.int64)]
            at += len(words) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if parts:
        # texts without such words have the offset of the next one and no runs
        places = np.array(offsets)
        for start, length, period in runs_of(np.concatenate(parts)):
            n = int(np.searchsorted(places, start, side="right")) - 1
            out[n].append((start - offsets[n], length, period))
    return [sorted(found, key=lambda run: (run[0], run[2])) for found in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, less those after the first period of any run."""
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[n] for n in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


# --- texts on Spark -------------------------------------------------------------------------------

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_doc`` (the columns of ``docs`` but the text), ``words``, ``runs`` and ``collapsed``.

    ``words`` is their number, ``runs`` (start, length, period) of every run by start, then period, and
    ``collapsed`` the text without what a run repeats. NULL counts as empty; an empty text has no words
    and no runs; repeated rows each have their result; an empty table gives an empty result.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_doc")
    slim = docs.select(rest, F.col(text).cast("binary").alias("_text"))
    kind = T.StructType([slim.schema["_doc"], *T.StructType.fromDDL(f"words bigint, runs {RUN}")])
    kind = kind.add("collapsed", T.BinaryType())
    pairs = pa.list_(
        pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                words, stop, size = [], at, 0
                while stop < batch.num_rows and size < BYTES_AT_ONCE:
                    body = batch.column(1)[stop].as_py() or b""
                    words.append(body.split())
                    size += len(body) + 1
                    stop += 1
                runs = word_runs(words)
                made = [
                    batch.column(0).slice(at, stop - at),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array(
                        [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs], pairs
                    ),
                    pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(made, ["_doc", "words", "runs", "collapsed"])
                at = stop

    found = slim.mapInArrow(take, kind)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


# --- query ----------------------------------------------------------------------------------------


def made_periodic(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of them (by the CRC-32 of their id) periodic from some word on.

    Documents without an id stay as they are.
    """
    words = F.filter(F.split("text", f"[{BLANK}]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("_h")).withColumn(
        "_words", F.when(F.col("_h") % 10 == 0, words)
    )
    n = "size(_words)"
    at = f"(floor(_h / 10) % {n})"
    period = f"(1 + floor(({n} - {at}) / (3 + floor(_h / 10) % 8)))"
    moved = f"transform(_words, (w, i) -> IF(i < {at}, w, _words[int({at} + (i - {at}) % {period})]))"
    return chosen.select(
        "doc_id",
        F.expr(f"CASE WHEN size(_words) > 0 THEN array_join({moved}, ' ') ELSE text END").alias("text"),
    )


def greatest(runs: Column) -> Column:
    """The run of the greatest exponent, the first of equal ones; NULL without runs."""
    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, r: F.when(
            r["length"] * best["period"] > best["length"] * r["period"], r
        ).otherwise(best),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(made_periodic(docs)).withColumn("best", greatest(F.col("runs")))
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    best = F.col("best")
    return found.select(
        F.col("_doc")["doc_id"].alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
