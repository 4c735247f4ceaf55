"""The pipeline's stages one after the other, each against plain code on the rows that it got."""

import re

import corpus_pipeline
from haulgrid.llm import toxicity
from haulgrid.llm.common import store
from tests.llm.conftest import DOCS, ODD
from tests.llm.test_operators import _classes, _near, _pieces_are_whole, _words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _benchmark_windows(items):
    windows = set()
    for text in items:
        ws = [w for w, _ in _words(text)]
        n = min(10, len(ws))
        windows |= {tuple(ws[a : a + n]) for a in range(len(ws) - n + 1)} if n else set()
    return windows


def test_stages_against_brute_force(spark, small_sf):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small_sf}/labels.parquet").collect()}
    windows = _benchmark_windows(r.text for r in spark.read.parquet(f"{small_sf}/benchmark.parquet").collect())
    lengths = {len(w) for w in windows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(store(stage(spark, docs, small_sf), name))
        assert docs.columns == COLUMNS
        left = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            p = toxicity.Ftrl()
            at = toxicity.train(spark.read.parquet(f"{small_sf}/documents.parquet"), spark.read.parquet(f"{small_sf}/labels.parquet"), p)
            score = toxicity.scorer(spark, at, p)
            scores = {r.doc_id: r.s for r in spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", score("text").alias("s")).collect()}
            want = {k for k in rows if scores[k] < p.threshold}
            clean = [k for k, t in marks.items() if t == 0 and k in rows]
            assert sum(k in left for k in clean) >= 0.98 * len(clean)
        elif name == "exact_dedup":
            want = {min(g, key=lambda r: (-len(r[1] or ""), r[0]))[0] for g in _classes(rows.items()).values()}
        elif name == "near_dedup":
            _, roots = _near(list(rows.items()), 5)
            want = {k for k, root in roots.items() if k == root}
        else:
            want = set()
            for k, text in rows.items():
                ws = [w for w, _ in _words(text)]
                if not any(tuple(ws[a : a + n]) in windows for n in lengths for a in range(len(ws) - n + 1)):
                    want.add(k)
        assert set(left) == want and all(left[k] == rows[k] for k in left)
        rows = left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small_sf).collect()
    _pieces_are_whole(pieces, list(rows.items()))


def test_stages_take_odd_rows_and_keep_columns(spark, small_sf, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small_sf)
            assert out.columns == DOCS.names and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small_sf).select("doc_id").distinct().count() == (0 if docs is empty else len({r[0] for r in ODD}))


def test_names_do_not_swallow_errors():
    with open(corpus_pipeline.__file__) as source:
        assert not re.search(r"\bexcept\b", source.read())
