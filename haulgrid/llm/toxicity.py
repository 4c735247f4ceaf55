"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulgrid.llm.common import slices, stored, text_arrays
from haulgrid.llm.hashing import mix, word_table, words

#: Words are runs of letters and digits, A-Z lowered; bytes of other scripts belong to words.
WORD_BYTES = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Texts are hashed in runs of about this many bytes.
RUN_BYTES = 1 << 18


@dataclass(frozen=True)
class Ftrl:
    """Rates and bounds of the training. `sample` bounds the labelled rows that are used, `sample_bytes` the
    size of their texts together; which rows these are, a hash of their doc_id decides."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0
    epochs: int = 2
    sample: int = 24_000
    sample_bytes: int = 100_000_000
    threshold: float = 0.3


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text: single words, pairs of neighbours, pairs with one word between (skip-grams);
    arrays (text number, feature number), with repetitions."""
    _, _, ids, first = words(data, offsets, WORD_BYTES)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    shift = np.uint64(64 - bits)
    numbers, owners = [mix(ids ^ np.uint64(1)) >> shift], [owner]
    for gap, factor in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F)):
        if len(ids) > gap:
            same = owner[gap:] == owner[:-gap]
            numbers.append(mix(ids[:-gap] * np.uint64(factor) + ids[gap:])[same] >> shift)
            owners.append(owner[gap:][same])
    return np.concatenate(owners), np.concatenate(numbers).astype(np.int32)


def _distinct(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The distinct features of every text in turn."""
    for a, b in slices(offsets, RUN_BYTES):
        part = offsets[a : b + 1]
        owners, numbers = features(data[part[0] : part[-1]], part - part[0], bits)
        order = np.argsort(owners, kind="stable")
        at = np.searchsorted(owners[order], np.arange(b - a + 1))
        numbers = numbers[order]
        for k in range(b - a):
            yield np.unique(numbers[at[k] : at[k + 1]])


class Learner:
    """FTRL-proximal: per-coordinate rates, weights exactly zero below the L1 bound. A text has each of its distinct
    features once, with the value 1; the last coordinate is the bias."""

    def __init__(self, p: Ftrl):
        self.p, size = p, (1 << p.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        p, z = self.p, self.z[at]
        rate = (p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2
        return np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / rate)

    def learn(self, found: np.ndarray, label: int) -> None:
        at = np.append(found, len(self.z) - 1)
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += error - (np.sqrt(n + error * error) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + error * error


def train_batches(batches: Iterator[tuple[pa.Array, list[int]]], p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the weights that are not zero. A text that no longer fits `sample_bytes` is passed over. Later epochs reread the features of the first."""
    learner, seen, left = Learner(p), [], p.sample_bytes
    for texts, labels in batches:
        kept = []
        for k, size in enumerate(np.diff(text_arrays(texts)[1])):
            if size <= left:
                kept.append(k)
                left -= int(size)
        if len(kept) < len(texts):
            texts, labels = texts.take(pa.array(kept, pa.int64())), [labels[k] for k in kept]
        data, offsets = text_arrays(texts)
        for found, y in zip(_distinct(data, offsets, p.bits), labels):
            learner.learn(found, y)
            if p.epochs > 1:
                seen.append((found, y))
    for _ in range(p.epochs - 1):
        for found, y in seen:
            learner.learn(found, y)
    w = learner.weights(slice(None))
    at = np.flatnonzero(w)
    return at, w[at]


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fitting(most: int):
    """Of rows in order those whose `size` still fits `most` in all; larger ones are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = most
        for batch in batches:
            kept = []
            for k, size in enumerate(batch.column("size").to_pylist()):
                if size <= left:
                    kept.append(k)
                    left -= size
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Ftrl) -> DataFrame:
    """`text, label` of at most about `p.sample` labelled rows outside the held-out part, in one partition ordered by hash.

    The ids of the sample are bounded by `p.sample`, so they are broadcast. Their sizes alone decide which texts fit
    `p.sample_bytes`; only those texts move. Rows without a label or doc_id are left out; of several labels of a document the
    highest counts. Rows with one doc_id fit together or not at all.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = stored(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).withColumn("h", F.xxhash64("doc_id")), "labels")
    n = known.count()
    if n > p.sample:
        known = known.filter(F.pmod("h", F.lit(1 << 32)) < int(p.sample / n * (1 << 32)))
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("size")
    sized = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label", "h").agg(size)
    ordered = sized.repartition(1).sortWithinPartitions("h", "doc_id")
    fitting = stored(ordered.mapInArrow(_fitting(p.sample_bytes), ordered.schema).drop("size"), "sample")
    chosen = docs.select("doc_id", "text").join(F.broadcast(fitting), "doc_id")
    return chosen.repartition(1).sortWithinPartitions("h", "doc_id", "text").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> dict[int, float]:
    """Weights that are not zero, by coordinate: a few hundred, 2^bits + 1 at most. Without labelled rows, none."""

    def run(batches):
        at, w = train_batches(((b.column("text"), b.column("label").to_pylist()) for b in batches), p)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    model = stored(labelled_sample(docs, labels, p).mapInArrow(run, "at long, w double"), "weights")
    return {r["at"]: r["w"] for r in model.collect()}


def scorer(spark: SparkSession, weights: dict[int, float], p: Ftrl = Ftrl()):
    """Column function of a text: its toxicity from 0 to 1. Empty and null texts get the score of the bias alone.
    A model without weights knows nothing of any text and scores all 0, so that nothing is dropped on its account."""
    sent = spark.sparkContext.broadcast(weights)
    bits = p.bits

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = np.zeros((1 << bits) + 1)
        if sent.value:
            w[list(sent.value)] = list(sent.value.values())
        for texts in batches:
            data, offsets = text_arrays(texts)
            sums = np.full(len(texts), w[-1])
            for a, b in slices(offsets, RUN_BYTES):
                part = offsets[a : b + 1]
                owners, numbers = features(data[part[0] : part[-1]], part - part[0], bits)
                hits = np.flatnonzero(w[numbers])
                pairs = np.unique(owners[hits].astype(np.int64) << bits | numbers[hits])
                sums[a:b] += np.bincount(pairs >> bits, w[pairs & ((1 << bits) - 1)], b - a)
            yield pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30))) if sent.value else np.zeros(len(texts)))

    return score
