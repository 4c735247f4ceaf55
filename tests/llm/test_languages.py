"""Language identification: features against plain code, accuracy on held-out rows, calibration, odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from haulgrid.llm import languages
from haulgrid.llm.languages import Subwords

SMALL = Subwords(bits=12, sample=2_000, epochs=6)
SYLLABLES = {"aa": "ba da ga ka la", "ee": "be de ge ke le", "éé": "bé dé gé ké lé", "мм": "ба да га ка ла"}


def made(rng, lang, n):
    parts = SYLLABLES[lang].split() + ["ti", "no"]  # two that all share
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice([*SYLLABLES, "aa"])
        rows.append((k, made(rng, lang, rng.randrange(3, 30)), None if k % 10 == 0 else lang))
    return rows


def test_subwords_equal_plain_code():
    texts = ["Ab c", "", "x", "a-é12B\n", "  ", "abcde fg"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    owner, bucket = languages.subwords(data, offsets, SMALL)
    assert len(owner) == len(bucket) and bucket.max() < 1 << SMALL.bits
    for k, t in enumerate(raw):
        low = bytes(languages.LETTERS[b] for b in t)
        want = 0
        for length in SMALL.lengths:
            for a in range(len(low) + 2 - length + 1):
                gram = (b" " + low + b" ")[a : a + length]
                want += b" " not in gram[1:-1] and gram[:1] + gram[-1:] != b"  "
        assert (owner == k).sum() == want
        alone = languages.subwords(np.frombuffer(t, np.uint8), np.array([0, len(t)]), SMALL)[1]
        assert Counter(alone.tolist()) == Counter(bucket[owner == k].tolist())


def test_parts_join_to_the_whole(monkeypatch):
    text = np.frombuffer(made(random.Random(3), "éé", 200).encode(), np.uint8)
    whole = languages.histogram(text, SMALL)
    monkeypatch.setattr(languages, "RUN_BYTES", 50)
    for a, b in zip(whole, languages.histogram(text, SMALL)):
        assert np.allclose(a, b)


def test_held_out_rows_are_told(spark):
    rows = corpus(1, 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = languages.train(docs, SMALL)
    assert model.names == sorted(SYLLABLES)
    got = languages.identify(docs.select("doc_id", "text"), model, SMALL).withColumn("held_out", languages.held_out(F.col("doc_id"))).collect()
    truth = {k: lang for k, _, lang in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out and truth[r.doc_id]]
    assert len(out) > 300 and sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.98
    passed = [r for r in out if r.accepted]
    assert len(passed) > 0.9 * len(out) and sum(r.lang_pred == truth[r.doc_id] for r in passed) / len(passed) > 0.98


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = corpus(2, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    other = docs.withColumn("lang", F.when(languages.held_out(F.col("doc_id")), F.lit("never")).otherwise(F.col("lang")))
    assert languages.train(docs, SMALL).dump() == languages.train(other, SMALL).dump()


def test_the_sample_is_bounded_and_even(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.when(F.col("id") % 50 == 0, "rare").otherwise("often").alias("lang"))
    n = {r.lang: r["count"] for r in languages.learning_sample(docs, Subwords(sample=1000)).groupBy("lang").count().collect()}
    assert 400 < n["often"] < 600 and n["rare"] > 60
    fewer = languages.learning_sample(docs, Subwords(sample_bytes=4_500)).count()
    assert 80 < fewer < 320


def test_rejection_keeps_the_precision():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 3, 4000)
    sums = rng.normal(0, 1, (4000, 3))
    sums[np.arange(4000), truth] += 1.5
    t, least = languages.calibrated(sums * 7, truth, 0.9)
    chances = languages._softmax(sums * 7 / t)
    passed = chances.max(axis=1) >= least
    right = chances.argmax(axis=1) == truth
    assert right.mean() < 0.9 <= right[passed].mean() and passed.mean() > 0.2
    assert abs(chances.max(axis=1).mean() - right.mean()) < 0.05
    assert languages.calibrated(np.zeros((4, 2)), np.ones(4, int), 0.9)[1] > 1


def test_odd_and_empty_tables(spark, odd, empty):
    model = languages.train(spark.createDataFrame(corpus(5, 200), "doc_id long, text string, lang string"), SMALL)
    rows = languages.identify(odd, model, SMALL).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.doc.text or "")
        assert (r.lang_pred in model.names) == letters and (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and not r.accepted))
    nothing = languages.train(odd, SMALL)  # no row has a language
    assert nothing.names == [] and {r.lang_pred for r in languages.identify(odd, nothing, SMALL).collect()} == {"und"}
    assert languages.train(empty, SMALL).names == [] and languages.identify(empty, model, SMALL).count() == 0
