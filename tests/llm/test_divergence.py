"""Source divergence against plain code on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulgrid.llm import divergence
from haulgrid.llm.divergence import Audit


def plain(rows, p):
    """All rows of the audit from (text, lang, source), with Python's whole numbers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in rows):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= p.least_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**p.digits * (count[t] + p.smooth) // (total + p.smooth * len(kept)) for t in kept}

        whole = sum((counts[lang, s] for s in sources), Counter())
        q, own = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources if o != s]
            marks = [(t, own[s][t] - q[t]) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", marks, p.top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def sample(seed, n, sources=7):
    rng = random.Random(seed)
    terms = [a + b for a in ("ab", "Cd", "é", "文", "zz") for b in ("x", "y", "Ö", "uv", "")]
    rows = []
    for _ in range(n):
        source = rng.choice([None, "hot", "hot", *[f"s{k}" for k in range(sources)]])
        words = rng.choices(terms, [1 / (k + 1) for k in range(len(terms))], k=rng.randrange(0, 25))
        rows.append((" ".join(w + rng.choice([" ", "1", "-", "\0"]) for w in words) or rng.choice([None, "", "12 !"]), rng.choice(["en", "de", None, ""]), source))
    return [*rows, ("no term is kept here", "rare", "a"), (None, "rare", "b"), ("long " * 50_000, "en", "s1")]


@pytest.mark.parametrize(("seed", "block", "tile"), [(1, 100_000, (128, 512)), (2, 20, (2, 3))])
def test_audit_equals_plain_code(spark, monkeypatch, seed, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile[0])
    monkeypatch.setattr(divergence, "TILE_TERMS", tile[1])
    rows, p = sample(seed, 400), Audit(least_docs=5, top=4)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).withColumns({"term": F.lit(1), "n": F.lit("x"), "cells": F.lit(0), "c": F.lit(2)})
    got = [tuple(r) for r in divergence.audit(docs, p).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, p)


def test_odd_and_empty_tables(odd, empty):
    rows = [(r[1], r[2], r[3]) for r in odd.collect()]
    assert {tuple(r) for r in divergence.audit(odd, Audit(least_docs=1)).collect()} == plain(rows, Audit(least_docs=1))
    assert divergence.audit(empty).count() == 0


def test_skyband_keeps_what_few_dominate():
    rng = np.random.default_rng(5)
    for k in (1, 3):
        n, c, place = rng.integers(0, 9, 700), rng.integers(0, 9, 700), rng.permutation(700)
        dominators = ((n[:, None] >= n) & (c[:, None] <= c) & (place[:, None] < place)).sum(axis=0)
        kept = divergence.skyband(n, c, place, k)
        assert kept[dominators < k].all() and not kept[dominators >= 20 * k].any()


def test_shares_are_exact_beyond_64_bits(spark):
    p, big = Audit(), 10**14
    got = spark.range(1).select(divergence.share(F.lit(big + 7), F.lit(3 * big), F.lit(11), p).alias("s")).first().s
    assert got == 1 + 10**9 * (big + 12) // (3 * big + 55)
