"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the character 2-, 3- and 4-grams of lower-cased words with a boundary mark on each
side, hashed to BUCKETS rows of an embedding table. A text is the mean of its subwords' embeddings;
a linear layer and a softmax turn it into probabilities. Both are trained together by stochastic
gradient descent in numpy, on a sample of labelled rows whose expected size is a parameter.

A part of the sample is kept from training to calibrate: one temperature is fitted to it, so that a
score is a probability, and the rejection threshold is set so that at most REJECTED of its correctly
told texts fall below, and never above HIGHEST: a text half in one language and half in another has
a score near one half and stays.

As everything up to the softmax is linear, prediction adds one row of logits for each subword of
the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZES = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSIONS, EPOCHS, RATE, SEED = 16, 8, 0.2, 5
#: Labelled texts for each language at most, and languages, most frequent first.
SAMPLE, LANGUAGES = 400, 256
#: Different buckets of all sample texts together at most (8 bytes each on the driver), an equal share
#: for each language; bytes of a model that is sent to all tasks.
SAMPLE_BUCKETS, MODEL_BYTES = 16 << 20, 128 << 20
#: Every nth text of the sample calibrates.
CALIBRATE = 4
REJECTED, HIGHEST = 0.001, 0.4
UNKNOWN = "und"
DOCS_AT_ONCE = 128
_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: the lower-case letter, or 0 if it is no letter."""
    if not _TABLES:
        table = np.zeros(0x110000, dtype=np.uint32)
        for n in range(0x110000):
            c = chr(n)
            if c.isalpha():
                low = c.lower()
                table[n] = ord(low) if len(low) == 1 else n
        _TABLES.append(table)
    return _TABLES[0]


def subwords(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of all subwords of a list of texts, by size; where each text's begin, by size and
    text; letters of each text."""
    # two marks stand before, between and after texts, so no subword of letters spans two
    joined = "\n\n" + "\n\n".join(x or "" for x in texts) + "\n\n"
    code = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    lengths = np.array([len(x or "") for x in texts])
    begin = 1 + np.cumsum(lengths + 2) - lengths - 2
    letter = code != 0
    total = np.concatenate([[0], np.cumsum(letter)])
    letters = total[begin + 1 + lengths] - total[begin + 1]
    found, starts = [], []
    for size in SIZES:
        n = len(code) - size + 1
        value = np.full(n, size * 0x85EBCA6B & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(size):
            value = (value ^ code[k : k + n]) * np.uint32(0x01000193 + 2 * size)
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        inner = letter[1 : 1 + n].copy() if size > 2 else letter[:n] | letter[1 : 1 + n]
        for k in range(2, size - 1):
            inner &= letter[k : k + n]
        where = np.concatenate([[0], np.cumsum(inner)])
        found.append((value[inner] >> np.uint32(16)).astype(np.int64))
        starts.append(where[np.minimum(begin, n)])
    return found, np.array(starts), letters


def sums(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: sum of its subwords' rows of ``table``, their number, its letters."""
    found, starts, letters = subwords(texts)
    total = np.zeros((len(texts), table.shape[1]))
    count = np.zeros(len(texts), dtype=np.int64)
    for at, begin in zip(found, starts, strict=True):
        ends = np.append(begin[1:], len(at))
        count += ends - begin
        full = ends > begin
        if full.any():
            for k in range(table.shape[1]):
                total[full, k] += np.add.reduceat(table[:, k][at], begin[full])
    return total, count, letters


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text; without a letter UNKNOWN, 0 and rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        total, count, letters = sums(texts, self.table)
        chance = softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
        best = chance.argmax(axis=1)
        told = letters > 0
        score = np.where(told, chance[np.arange(len(texts)), best], 0.0)
        names = [self.languages[b] if t else UNKNOWN for b, t in zip(best, told, strict=True)]
        return names, score, ~told | (score < self.threshold)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """Train and calibrate on (buckets, their shares, language) of each text."""
    languages = sorted({x[2] for x in samples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    number = {x: n for n, x in enumerate(languages)}
    rng = np.random.default_rng(SEED)
    rows = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    fitted = [x for n, x in enumerate(samples) if n % CALIBRATE or len(samples) < 2 * CALIBRATE]
    steps, step = max(1, EPOCHS * len(fitted)), 0
    for _ in range(EPOCHS):
        for n in rng.permutation(len(fitted)):
            at, share, language = fitted[n]
            mean = share @ rows[at]
            error = softmax(mean @ layer + bias)
            error[number[language]] -= 1
            rate = RATE * (1 - step / steps)
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            # shares are small: scaled by their number, so that a step moves a long text as a short
            rows[at] -= rate * np.outer(np.minimum(share * len(share), 4.0), back)
            step += 1
    held = samples[::CALIBRATE] if len(samples) >= 2 * CALIBRATE else samples
    logits = np.array([x[1] @ rows[x[0]] @ layer + bias for x in held]).reshape(-1, len(languages))
    truth = np.array([number[x[2]] for x in held], dtype=np.int64)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 50, 200):
        p = softmax(logits / t)[np.arange(len(held)), truth]
        best = min(best, (-np.log(np.maximum(p, 1e-12)).mean(), t))
    scores = softmax(logits / best[1])
    right = scores.max(axis=1)[scores.argmax(axis=1) == truth]
    threshold = min(HIGHEST, float(np.quantile(right, REJECTED))) if len(right) else 0.0
    return Model(languages, rows @ layer, bias, best[1], threshold)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Model of the labelled rows of ``docs``: rows whose language is not NULL and text has a letter.

    Of every language (the LANGUAGES most frequent) the rows with the smallest hashes of key and text
    are taken, SAMPLE at most and no more than the language's share of SAMPLE_BUCKETS; rows of equal
    key and text count once. Without any, the model knows no language.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")
    )
    order = F.xxhash64("key", "text", F.lit(SEED))
    counts = labelled.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(order).alias("distinct")
    ).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # twice the different rows wanted pass this draw, so that enough are left for the exact cut below
    rates = {r["lang"]: min(1.0, 2 * SAMPLE / r["distinct"]) for r in counts.collect()}
    if not rates:
        return fit([])
    lookup = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    draw = F.pmod(order, F.lit(1 << 24)) / F.lit(float(1 << 24))
    drawn = labelled.withColumns({"order": order, "draw": draw}).filter(
        F.col("draw") < F.coalesce(F.try_element_at(lookup, "lang"), F.lit(0.0))
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = []
            for x in texts:
                found = np.concatenate(subwords([x])[0])
                at, n = np.unique(found, return_counts=True)
                rows.append((at.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    batch.column(3),
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                ],
                ["lang", "order", "draw", "buckets", "shares"],
            )

    slim = drawn.dropDuplicates(["lang", "order"]).select("text", "lang", "draw", "order")
    first = Window.partitionBy("lang").orderBy("draw", "order")
    fewest = (
        slim.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= SAMPLE)
        .select("text", "lang", "order", "draw")
    )
    counted = fewest.mapInArrow(
        take, "lang string, order long, draw double, buckets array<int>, shares array<float>"
    ).withColumn("_sum", F.sum(F.size("buckets")).over(first))
    rows = counted.filter(F.col("_sum") <= SAMPLE_BUCKETS // len(rates)).toArrow()
    order = np.argsort(rows.column("order").to_numpy(), kind="stable")
    langs = rows.column("lang").to_pylist()
    at, share = rows.column("buckets"), rows.column("shares")
    samples = []
    for n in order.tolist():
        buckets = at[n].values.to_numpy(zero_copy_only=False)
        if len(buckets):
            samples.append((buckets, share[n].values.to_numpy().astype(np.float64), langs[n]))
    return fit(samples)


def _sent(docs: DataFrame, model: Model):
    """The model for all tasks; its size is bounded by LANGUAGES, and checked."""
    if model.table.nbytes > MODEL_BYTES:
        raise ValueError(f"the model has more than {MODEL_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(model)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``_doc`` (the columns of ``docs`` but the text, as a struct), ``lang_pred``, ``score`` and
    ``rejected`` of every row. NULL, empty and letterless texts are UNKNOWN with score 0, rejected."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_doc")
    shared = _sent(docs, model)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                names, score, rejected = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                    ["_doc", "lang_pred", "score", "rejected"],
                )

    slim = docs.select(rest, F.col(text).alias("_text"))
    schema = T.StructType(
        [
            slim.schema["_doc"],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return slim.mapInArrow(take, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their own columns.

    A model that knows no language, as a table without labels gives, cannot choose: all rows stay.
    """
    if not model.languages:
        return docs
    shared, at = _sent(docs, model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(begin, DOCS_AT_ONCE)
                rejected = shared.value.predict(part.column(at).to_pylist())[2]
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    return identified(docs.select("doc_id", "text"), model).select(
        F.col("_doc")["doc_id"].alias("doc_id"),
        held_out("_doc.doc_id").alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )
