"""Language of a text: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.llm.common import packed, slices, stored, text_arrays
from haulgrid.llm.hashing import mix

#: Subwords are taken from texts in runs of about this many bytes.
RUN_BYTES = 1 << 18
#: A letter keeps its byte, A-Z lowered; bytes beyond ASCII belong to letters; all else is one blank, the edge of a word.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
#: What a text without a letter is, and any text if nothing was learned.
UNKNOWN = "und"


@dataclass(frozen=True)
class Subwords:
    """Sizes and rates of the model.

    `sample` bounds the rows that are learned from, shared evenly among the languages; `sample_bytes` bounds
    their texts together; texts of more than `text_bytes` are not learned from. Which rows these are, a hash of their doc_id
    decides. One in `calibration` of them is held back to set the temperature and the rejection, which lets
    pass what is right with `precision`.
    """

    bits: int = 16
    lengths: tuple[int, ...] = (2, 3, 4)
    width: int = 16
    epochs: int = 4
    rate: float = 2.0
    sample: int = 8_000
    sample_bytes: int = 24_000_000
    text_bytes: int = 64_000
    calibration: int = 5
    precision: float = 0.99
    seed: int = 11


def subwords(data: np.ndarray, offsets: np.ndarray, p: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every subword: runs of `p.lengths` bytes of words that are set between two blanks; a blank is
    only the first or last byte of one. Both are sorted by length, then place."""
    n = len(offsets) - 1
    low = np.full(len(data) + 2 * n, 32, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    low[np.arange(len(data)) + 2 * owner + 1] = LETTERS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    blank, wide = low == 32, low.astype(np.uint64)
    texts, buckets = [], []
    for length in p.lengths:
        size = len(low) - length + 1
        if size <= 0:
            continue
        inner = np.zeros(size, bool)
        for k in range(1, length - 1):
            inner |= blank[k : k + size]
        both = blank[:size] & blank[length - 1 :]
        at = np.flatnonzero(~inner & ~both & (owner[:size] == owner[length - 1 :]))
        key = np.full(len(at), length, np.uint64)
        for k in range(length):
            key = key << np.uint64(8) | wide[at + k]
        texts.append(owner[at])
        buckets.append((mix(key) >> np.uint64(64 - p.bits)).astype(np.int64))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(buckets)


def parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of at most RUN_BYTES that end with a word; a word that is longer than a part is cut."""
    a = 0
    while a < len(data):
        b = a + RUN_BYTES
        if b < len(data):
            blanks = np.flatnonzero(LETTERS[data[a:b]] == 32)
            b = a + int(blanks[-1]) + 1 if len(blanks) else b
        yield data[a:b]
        a = b


def histogram(data: np.ndarray, p: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text and the share of its subwords in each."""
    counts = np.zeros(1 << p.bits)
    for run in parts(data):
        counts += np.bincount(subwords(run, np.array([0, len(run)]), p)[1], minlength=1 << p.bits)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1.0, counts.sum())


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """`names` of the languages in order, embeddings of the buckets, weights of the languages, temperature and least score of the
    predictions that pass."""

    names: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def table(self) -> np.ndarray:
        """What each bucket adds to each language: averaging and the linear layer commute."""
        return self.embeddings @ self.weights

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, names=np.array(self.names), embeddings=self.embeddings.astype(np.float32), weights=self.weights.astype(np.float32), fit=np.array([self.temperature, self.least]))
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Model:
        got = np.load(io.BytesIO(raw))
        return Model([str(x) for x in got["names"]], got["embeddings"], got["weights"], *(float(x) for x in got["fit"]))


def fit(texts: list[bytes], langs: list[str], p: Subwords) -> Model:
    """Stochastic gradient descent, one text a step, the rate falling to zero; then temperature and rejection on held-back texts."""
    names = sorted(set(langs))
    rng, number = np.random.default_rng(p.seed), {name: k for k, name in enumerate(names)}
    model = Model(names, rng.uniform(-1 / p.width, 1 / p.width, (1 << p.bits, p.width)), np.zeros((p.width, len(names))))
    rows = [(*histogram(np.frombuffer(t, np.uint8), p), number[x]) for t, x in zip(texts, langs)]
    back = [r for k, r in enumerate(rows) if k % p.calibration == p.calibration - 1]
    rows = [r for k, r in enumerate(rows) if k % p.calibration != p.calibration - 1]
    steps, step = p.epochs * len(rows), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            at, part, y = rows[k]
            hidden = part @ model.embeddings[at]
            error = _softmax(hidden @ model.weights)
            error[y] -= 1
            rate = p.rate * (1 - step / steps)
            back_to = model.weights @ error
            model.weights -= rate * np.outer(hidden, error)
            model.embeddings[at] -= rate * np.outer(part, back_to)
            step += 1
    if back:
        sums = np.stack([part @ model.embeddings[at] @ model.weights for at, part, _ in back])
        truth = np.array([y for *_, y in back])
        model.temperature, model.least = calibrated(sums, truth, p.precision)
    return model


def calibrated(sums: np.ndarray, truth: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature with the least log loss, and the least score from which on the predictions are right with `precision`; if no
    score will do, one above all."""
    grid = np.geomspace(0.05, 20, 121)
    losses = [-np.log(np.maximum(_softmax(sums / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(losses))])
    chances = _softmax(sums / t)
    score, right = chances.max(axis=1), chances.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    enough = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    if not enough.any():
        return t, float(np.nextafter(1, 2))
    last = int(np.flatnonzero(enough)[-1])
    return t, 0.0 if last == len(order) - 1 else float(score[order][last])


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learning_sample(docs: DataFrame, p: Subwords) -> DataFrame:
    """`text, lang` of the rows to learn from, in one partition ordered by hash. The bounds are met before any text moves: each
    language gives the share of its rows that its part of `sample` and of `sample_bytes` allows. Rows without doc_id, language or
    letters are not learned from."""
    size = F.octet_length("text")
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (size <= p.text_bytes) & has_letter(F.col("text")))
    sizes = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")), "languages")
    n = sizes.agg(F.count(F.lit(1)).alias("langs")).select(F.col("langs").cast("double"))
    share = F.least(F.lit(p.sample) / F.col("rows"), F.lit(p.sample_bytes) / F.col("bytes")) / F.greatest(F.lit(1.0), n.scalar())
    bars = sizes.select("lang", (F.least(F.lit(1.0), share) * (1 << 31)).cast("long").alias("bar"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).join(bars, "lang").filter(F.pmod("h", F.lit(1 << 31)) < F.col("bar"))
    return chosen.repartition(1).sortWithinPartitions("h", "doc_id", "text").select("text", "lang")


def train(docs: DataFrame, p: Subwords = Subwords()) -> Model:
    """Learn from `docs` (`doc_id, text, lang`). Without rows to learn from the model knows no language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for b in batches:
            data, offsets = text_arrays(b.column("text"))
            texts += [data[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
            langs += b.column("lang").to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([fit(texts, langs, p).dump()], pa.binary())], ["model"])

    rows = stored(learning_sample(docs, p).mapInArrow(run, "model binary"), "model").collect()
    return Model.load(rows[0]["model"]) if rows else Model([], np.zeros((1 << p.bits, p.width)), np.zeros((p.width, 0)))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def identifier(spark: SparkSession, model: Model, p: Subwords = Subwords()):
    """Column function of a text: `lang, score`, the likeliest language and its calibrated probability. The whole text counts. A null
    text, one without letters and every text if the model knows no language: `und` with score 0."""
    sent = spark.sparkContext.broadcast(model.dump())

    @F.arrow_udf("lang string, score double")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model.load(sent.value)
        adds, names = m.table().astype(np.float64), np.array(m.names, object)
        for texts in batches:
            data, offsets = text_arrays(texts)
            chosen, score = np.full(len(texts), None), np.zeros(len(texts))
            for a, b in slices(offsets, RUN_BYTES) if len(names) else ():
                whole = data[offsets[a] : offsets[b]]
                sums, counts = np.zeros((b - a, len(names))), np.zeros(b - a)
                for run in parts(whole) if b - a == 1 else (whole,):
                    owner, bucket = subwords(run, np.array([0, len(run)]) if b - a == 1 else offsets[a : b + 1] - offsets[a], p)
                    counts += np.bincount(owner, minlength=b - a)
                    for k in range(len(names)):
                        sums[:, k] += np.bincount(owner, adds[bucket, k], b - a)
                chances = _softmax(sums / np.maximum(counts, 1)[:, None] / m.temperature)
                chosen[a:b], score[a:b] = names[chances.argmax(axis=1)], chances.max(axis=1)
            yield pa.StructArray.from_arrays([pa.array(chosen, pa.string()), pa.array(score)], ["lang", "score"])

    def column(text: str) -> Column:
        found, known = best(text), has_letter(F.col(text))
        name = F.when(known, F.coalesce(found["lang"], F.lit(UNKNOWN))).otherwise(F.lit(UNKNOWN))
        return F.struct(name.alias("lang"), F.when(known, found["score"]).otherwise(F.lit(0.0)).alias("score"))

    return column


def identify(docs: DataFrame, model: Model, p: Subwords = Subwords()) -> DataFrame:
    """`docs` (`text` and any other columns, packed as `doc`) with `doc_id, lang_pred, score, accepted`; `accepted` is false where the score is below the
    calibrated bar or the language unknown. Empty tables stay empty, repeated rows are told each for itself."""
    told = packed(docs).withColumn("told", identifier(docs.sparkSession, model, p)("text"))
    lang, score = F.col("told.lang"), F.col("told.score")
    return told.select("doc", "doc_id", lang.alias("lang_pred"), score.alias("score"), ((lang != UNKNOWN) & (score >= model.least)).alias("accepted"))
