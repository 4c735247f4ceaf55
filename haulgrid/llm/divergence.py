"""How far the sources of a language differ in their words: distances between sources, and the words that mark a source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.functions.scale import lookup_join
from haulgrid.llm.common import gathered, slices, stored, text_arrays
from haulgrid.llm.hashing import word_codes, word_spans, word_table

#: Terms are runs of ASCII letters and of all characters beyond ASCII; A-Z are lowered.
TERM_BYTES = word_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Texts are counted in runs of about this many bytes.
RUN_BYTES = 8 << 20
#: Rows of which a skyband is taken at once; what a block keeps meets that of other blocks in the merge.
BLOCK = 100_000
#: A tile compares this many sources with as many others over this many terms (all on average).
TILE_SOURCES, TILE_TERMS = 128, 512


@dataclass(frozen=True)
class Audit:
    """`least_docs` documents of a language must have a term; `smooth` is added to every count; shares are whole numbers out
    of 10^`digits` (a multiple of 3); the `top` terms of each source are named."""

    least_docs: int = 30
    smooth: int = 5
    digits: int = 9
    top: int = 50


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`lang, term, docs, n, cells(source, n)`: what a run of texts has of each term, by source."""
    names = ["lang", "term", "docs", "n", "cells"]
    for run in gathered(batches, "text", RUN_BYTES):
        data, offsets = text_arrays(run.column("text"))
        langs, sources = (run.column(c).dictionary_encode() for c in ("lang", "source"))
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
        for a, b in slices(offsets, RUN_BYTES):
            part = offsets[a : b + 1] - offsets[a]
            low, starts, ends, first = word_spans(data[offsets[a] : offsets[b]], part, TERM_BYTES)
            codes, terms = word_codes(low, starts, ends)
            doc = np.repeat(np.arange(a, b), np.diff(first))
            in_doc, n = np.unique(doc * max(1, len(terms)) + codes, return_counts=True)
            doc, code = np.divmod(in_doc, max(1, len(terms)))
            key = lang[doc] * len(terms) + code  # a language and a term
            cell, at = np.unique(key * len(sources.dictionary) + source[doc], return_inverse=True)
            cell_n = np.bincount(at, n, len(cell)).astype(np.int64)
            keys, begins, owner = np.unique(cell // max(1, len(sources.dictionary)), return_index=True, return_inverse=True)
            docs = np.bincount(np.searchsorted(keys, key), minlength=len(keys))
            inner = pa.StructArray.from_arrays([sources.dictionary.take(pa.array(cell % max(1, len(sources.dictionary)))), pa.array(cell_n)], ["source", "n"])
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(keys // max(1, len(terms)))), terms.take(pa.array(keys % max(1, len(terms)))), pa.array(docs.astype(np.int64)),
                pa.array(np.bincount(owner, cell_n, len(keys)).astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.append(begins, len(cell)), pa.int32()), inner),
            ], names)


def share(n: Column, total: Column, terms: Column, p: Audit) -> Column:
    """1 + floor(10^digits * (n + smooth) / (total + smooth * terms)), three digits at a time: no product passes 64 bits
    while the totals are below 10^15. 0 without terms."""
    whole = total + terms * p.smooth
    quotient, rest = F.lit(0).cast("long"), (n + p.smooth).cast("long")
    for _ in range(p.digits // 3):
        quotient = quotient * 1000 + F.call_function("div", rest * 1000, F.nullif(whole, F.lit(0)))
        rest = (rest * 1000) % F.nullif(whole, F.lit(0))
    return F.coalesce(quotient + 1, F.lit(0).cast("long"))


def skyband(n: np.ndarray, c: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which of the terms fewer than `k` others dominate: others with no smaller `n`, no larger `c` and an earlier `place`.

    In the order of n down, c up, place up, all that dominate a term come before it; a block of terms is held against the kept
    ones before it and against itself. A term with `k` dominators has `k` kept ones, so none is missed.
    """
    order = np.lexsort((place, c, -n))
    c, place = c[order], place[order]
    kept = np.zeros(len(order), bool)
    for a in range(0, len(order), 256):
        b = min(a + 256, len(order))
        before = kept[:a]
        worse = (c[:a][before][:, None] <= c[a:b]) & (place[:a][before][:, None] < place[a:b])
        own = (c[a:b][:, None] <= c[a:b]) & (place[a:b][:, None] < place[a:b])
        kept[a:b] = worse.sum(axis=0) + np.triu(own, 1).sum(axis=0) < k
    out = np.zeros(len(order), bool)
    out[order] = kept
    return out


def _skybands(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows)
            group = np.zeros(len(table), np.int64)
            for name in ("lang", "source"):
                seen = table.column(name).combine_chunks().dictionary_encode()
                group = group * len(seen.dictionary) + seen.indices.to_numpy()
            place = np.empty(len(table), np.int64)
            place[pc.sort_indices(table.column("term")).to_numpy()] = np.arange(len(table))
            n, c = (table.column(x).to_numpy() for x in ("n", "c"))
            order = np.argsort(group, kind="stable")
            bounds = np.append(np.unique(group[order], return_index=True)[1], len(order))
            keep = np.ones(len(table), bool)
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a > k:
                    at = order[a:b]
                    keep[at] = skyband(n[at], c[at], place[at], k)
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                yield from kept(held)
                held = []
        if held:
            yield from kept(held)

    return run


def _distances(table: pa.Table) -> pa.Table:
    """`lang, a, b, f`: for each two sources of a tile, the sum of the differences of their shares over the tile's terms. A
    row without a term tells a source's share of the terms that it lacks, and how many terms the tile has in all: those that none
    of its sources has are not among its rows."""
    sources = table.column("source").combine_chunks().dictionary_encode()
    terms = table.column("term").combine_chunks().dictionary_encode()
    row, names = sources.indices.to_numpy(), sources.dictionary.to_pylist()
    share, block = table.column("p").to_numpy(), np.zeros(len(names), np.int64)
    block[row] = table.column("block").to_numpy()
    lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi"))
    there = terms.is_valid().to_numpy(zero_copy_only=False)
    shares = np.zeros((len(names), len(terms.dictionary)), np.int64)
    shares[row[~there]] = share[~there][:, None]
    shares[row[there], terms.indices.drop_null().to_numpy()] = share[there]
    base, unseen = np.zeros(len(names), np.int64), pc.max(table.column("width")).as_py() - len(terms.dictionary)
    base[row[~there]] = share[~there]
    out = []
    for k in np.flatnonzero(block == lo):
        others = np.flatnonzero(block == hi)
        others = others[others > k] if lo == hi else others
        sums = np.abs(shares[others] - shares[k]).sum(axis=1) + unseen * np.abs(base[others] - base[k])
        out += [(names[k], names[o], int(f)) if names[k] < names[o] else (names[o], names[k], int(f)) for o, f in zip(others, sums)]
    lang = table.column("lang")[0].as_py()
    a, b, f = zip(*out) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "f": pa.array(f, pa.int64())})


@dataclass(frozen=True)
class Vocabulary:
    """`groups(lang, source, total, terms, lang_total, base)`: every source of every language, its occurrences of kept terms, their number,
    the occurrences in the language, the share of a term that it lacks; `kept(lang, term, c)`: the kept terms; `cells(lang, source, term,
    n, c)`: occurrences of a kept term in the source and in the language."""

    groups: DataFrame
    kept: DataFrame
    cells: DataFrame


def vocabulary(docs: DataFrame, p: Audit = Audit()) -> Vocabulary:
    """Count the terms of `docs` (`text, lang, source`; null counts as empty). A run of texts is counted in its task; only the
    terms that enough documents have are split by source."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    cell = "array<struct<source string, n long>>"
    runs = stored(docs.mapInArrow(_counter, f"lang string, term string, docs long, n long, cells {cell}"), "runs")
    kept = runs.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("c")).filter(F.col("docs") >= p.least_docs)
    kept = stored(kept.select("lang", "term", "c"), "terms")
    cells = lookup_join(runs.select("lang", "term", "cells"), kept, ["lang", "term"], stored=True).select("lang", "term", "c", F.inline("cells"))
    cells = stored(cells.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.max("c").alias("c")), "cells")
    zero = F.lit(0).cast("long")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("c").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
    return Vocabulary(stored(groups.withColumn("base", share(zero, F.col("total"), F.col("terms"), p)), "groups"), kept, cells)


def source_distances(v: Vocabulary, p: Audit = Audit()) -> DataFrame:
    """`lang, source, item, value`: for each two sources of a language (both ways) the sum of the differences of their shares
    over all kept terms, 0 without terms. Tiles of sources by sources by terms are summed in tasks of their own."""
    sizes = v.groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_SOURCES).cast("int").alias("blocks"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("terms") / TILE_TERMS)).cast("int")
    groups = v.groups.join(sizes, "lang").withColumns({"block": F.pmod(F.xxhash64("source"), "blocks").cast("int"), "parts": parts})
    part = F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part")
    rows = v.cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms"), p).alias("p"), "block", "blocks", part, F.lit(None).cast("long").alias("width")
    )
    widths = v.kept.join(groups.select("lang", "parts").distinct(), "lang").groupBy("lang", part).agg(F.count(F.lit(1)).alias("width"))
    lacking = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    lacking = lacking.join(widths, ["lang", "part"], "left").withColumn("width", F.coalesce("width", F.lit(0).cast("long")))
    tiles = rows.unionByName(lacking).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_other", "blocks")
    met = tiles.groupBy("lang", "part", "lo", "hi").applyInArrow(_distances, "lang string, a string, b string, f long")
    met = met.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return met.select("lang", F.inline(both), "value")


def marking_terms(v: Vocabulary, p: Audit = Audit()) -> DataFrame:
    """`lang, source, item, value, rank`: the `top` terms that a source has more of than its language, by the difference.

    The difference rises with the count in the source and falls with that in the language, so a term that `top` others
    dominate is not among the first. Each block of rows keeps its skyband, the skybands meet when their table is read
    again, and what is left is ranked by exact differences.
    """
    schema = "lang string, source string, term string, n long, c long"
    local = stored(v.cells.mapInArrow(_skybands(p.top), schema), "skybands")
    merged = local.mapInArrow(_skybands(p.top), schema)
    rows = merged.join(v.groups, ["lang", "source"]).filter("n > 0")
    own, whole = (share(F.col(n), F.col(t), F.col("terms"), p) for n, t in (("n", "total"), ("c", "lang_total")))
    rows = rows.select("lang", "source", F.col("term").alias("item"), (own - whole).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top)


def audit(docs: DataFrame, p: Audit = Audit()) -> DataFrame:
    """`lang, source, part, item, value, rank`: part `pair` ranks for every source the others of its language by their
    distance, part `term` the terms that mark it. Sources without terms have distances too; an empty table gives nothing."""
    v = vocabulary(docs, p)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_distances(v, p).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = marking_terms(v, p).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
