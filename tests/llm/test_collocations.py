"""Phrase mining against plain code on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haulgrid.llm import collocations
from haulgrid.llm.collocations import Mining


def plain(rows, p):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = set()
    for lang, f in counts.items():
        found = {ph: a for ph, a in f.items() if len(ph) > 1 and a >= p.least}
        rows = []
        for ph, a in found.items():
            score, k = min((p.scale * a // (f[ph[:k]] + f[ph[k:]]), k) for k in range(1, len(ph)))
            inside = [b for x, b in found.items() if len(x) > len(ph) and any(x[o : o + len(ph)] == ph for o in range(len(x)))]
            if not any(100 * b >= p.covered * a for b in inside):
                rows.append((-score, -a, " ".join(ph).encode(), f[ph[:k]], f[ph[k:]]))
        for rank, (score, a, ph, left, right) in enumerate(sorted(rows)[: p.top], 1):
            out.add((lang, rank, ph.decode(), -a, left, right, totals[lang], -score))
    return out


def sample(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "hall", "of", "the", "é", "\0", "文字", "a-b", "x y", "ß"]
    fixed = ["new york city hall", "of the city", "hall of the", "文字 ß é"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choices(words, [1 / (k + 1) for k in range(12)])[0] for _ in range(rng.randrange(0, 25))]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for w in parts) or rng.choice([None, "", " ,"]), rng.choice(["en", "en", "de", None, ""])))
    return [*rows, ("long " * 60_000, "en"), ("same " * 300, "rare"), ("one", "single")]


@pytest.mark.parametrize(("seed", "bits", "run"), [(1, 1 << 28, 8 << 20), (2, 1 << 16, 300)])
def test_collocations_equal_plain_code(spark, monkeypatch, seed, bits, run):
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "RUN_BYTES", run)
    rows, p = sample(seed, 500), Mining(least=4, top=40)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns({"prefix": F.lit(1), "next": F.lit("x"), "n": F.lit(0), "words": F.lit(2)})
    got = [tuple(r) for r in collocations.collocations(docs, p).collect()]
    want = plain(rows, p)
    assert len(got) == len(want) and set(got) == want


def test_a_full_filter_loses_nothing(spark):
    rows = sample(3, 300)
    docs = spark.createDataFrame(rows, "text string, lang string").na.fill({"lang": "und", "text": ""})
    full = collocations.PhraseFilter(np.full(1 << 13, 255, np.uint8))
    for orders in ((2,), (3, 4)):
        a, b = ({(r.lang, *r.prefix, r.next): r.n for r in collocations.stripe_cells(docs, orders, known).collect()} for known in (None, full))
        c, d = ({r.id: r.n for r in collocations.hashed_counts(docs, orders, known).collect()} for known in (None, full))
        assert a == b and c == d and sorted(a.values()) == sorted(c.values())
    assert not collocations.PhraseFilter(np.zeros(1 << 13, np.uint8)).has(np.arange(100, dtype=np.uint64)).any()


def test_odd_and_empty_tables(odd, empty):
    rows, p = [(r[1], r[2]) for r in odd.collect()], Mining(least=2)
    assert {tuple(r) for r in collocations.collocations(odd, p).collect()} == plain(rows, p)
    assert collocations.collocations(empty).count() == 0


def test_stripes_of_a_run():
    texts, langs = pa.array(["a b c. a b d", "", "a b"]), pa.array(["en", "en", "de"])
    (pairs,) = collocations.run_stripes(collocations.Run.of(texts, langs), (2,), None)
    def stripes(batch):
        return {(r["lang"], *r["prefix"]): {c["next"]: c["n"] for c in r["cells"]} for r in batch.to_pylist()}

    all_words, words, _ = collocations.run_stripes(collocations.Run.of(texts, langs), (1, 2), None)
    assert stripes(all_words) == {("en",): {None: 6}, ("de",): {None: 2}}
    assert stripes(words) == {("en",): {"a": 2, "b": 2, "c": 1, "d": 1}, ("de",): {"a": 1, "b": 1}}
    assert stripes(pairs) == {("en", "a"): {"b": 2}, ("en", "b"): {"c": 1, "d": 1}, ("de", "a"): {"b": 1}}


def test_scores_are_exact_beyond_64_bits(spark):
    a, parts = 8 * 10**17 + 13, 2 * 10**18 + 77
    got = spark.range(1).select(collocations.cohesion(F.lit(a), F.lit(parts).cast("decimal(20,0)"), Mining()).alias("s")).first().s
    assert got == 2_000_000 * a // parts
