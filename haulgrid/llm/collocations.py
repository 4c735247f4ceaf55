"""Phrases whose words occur together more often than their parts, mined from stripes: for each prefix a counter of next words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.functions.scale import lookup_join
from haulgrid.llm.common import gathered, slices, stored, text_arrays
from haulgrid.llm.hashing import mix, prefix_sums, run_ids, word_codes, word_spans, word_table

#: Bytes that end a piece; blank and tab separate the words inside it; A-Z are lowered.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_BYTES = word_table(b"\x20\x09" + BREAKS)
#: Texts are counted in runs of about this many bytes.
RUN_BYTES = 4 << 20
#: Bits of a filter at most (32 MB), bits for each phrase in it up to there, and bits of one slice as it is built.
FILTER_BITS, BITS_EACH, SLICE_BITS = 1 << 28, 16, 1 << 16


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to 4 words with `least` occurrences are candidates; one that a longer candidate covers by `covered` percent
    goes; the `top` of each language stay. Scores are whole numbers out of `scale`."""

    least: int = 30
    covered: int = 80
    top: int = 2000
    scale: int = 2_000_000


def _string_ids(strings: pa.Array) -> np.ndarray:
    data, offsets = text_arrays(strings)
    return run_ids(prefix_sums(data), offsets[:-1], offsets[1:])


def _then(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Identifiers of phrases from those of their prefix and their last word."""
    return mix(ids * np.uint64(0x9FB21C651E98DF25) + words)


class PhraseFilter:
    """A set of (language, phrase) in a bitmap of fixed size, two bits each. What was put in is always found; of the rest a share is
    found as well, all of it once the bitmap is full, which costs counting but loses nothing."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(ids: np.ndarray, size: int) -> np.ndarray:
        return (np.stack([ids, mix(ids ^ np.uint64(0x5BD1E995))]) & np.uint64(size - 1)).astype(np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(ids, 8 * len(self.bits))
        return ((self.bits[at >> 3] >> (at & 7)) & 1).all(axis=0)


def filter_of(ids: DataFrame) -> PhraseFilter:
    """The filter of the identifiers `ids` (`id`), a written table. The slices of the bitmap are built in tasks; the driver gets the
    bitmap itself, of at most FILTER_BITS whatever the number of phrases."""
    size = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (BITS_EACH * ids.count()).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("id").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(PhraseFilter.places(found, size)))], ["at"])

    def packed(table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        bits = np.zeros(SLICE_BITS, np.uint8)
        bits[at % SLICE_BITS] = 1
        return pa.table({"slice": pa.array([int(at[0]) // SLICE_BITS]), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    places = ids.mapInArrow(placed, "at long").groupBy(F.expr(f"at div {SLICE_BITS}").alias("slice"))
    bits = np.zeros(size // 8, np.uint8)
    for r in places.applyInArrow(packed, "slice long, bits binary").collect():
        bits[r["slice"] * SLICE_BITS // 8 :][: SLICE_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return PhraseFilter(bits)


@dataclass
class Run:
    """The words of a run of texts: their numbers among the run's distinct `words`, the language of each, and whether each is in one
    piece with the word before."""

    code: np.ndarray
    words: pa.StringArray
    lang: np.ndarray
    langs: pa.Array
    joined: np.ndarray

    @staticmethod
    def of(texts: pa.Array, langs: pa.Array) -> Run:
        data, offsets = text_arrays(texts)
        low, starts, ends, first = word_spans(data, offsets, WORD_BYTES)
        code, words = word_codes(low, starts, ends)
        named = langs.dictionary_encode()
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(np.isin(data, np.frombuffer(BREAKS, np.uint8)), out=breaks[1:])
        joined = np.zeros(len(doc), bool)
        joined[1:] = (doc[1:] == doc[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
        return Run(code, words, named.indices.to_numpy()[doc].astype(np.int64), named.dictionary, joined)

    def phrases(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 1 to `most`: the length, the places of the first words of all phrases, their identifiers."""
        word_ids = _string_ids(self.words)[self.code]
        at = np.arange(len(self.code))
        ids = _then(_string_ids(self.langs)[self.lang], word_ids)
        yield 1, at, ids
        for m in range(2, most + 1):
            ahead = at[at + m - 1 < len(self.code)]
            ids, at = ids[: len(ahead)], ahead
            there = self.joined[at + m - 1]
            at, ids = at[there], ids[there]
            ids = _then(ids, word_ids[at + m - 1])
            yield m, at, ids


def phrase_counts(run: Run, orders: Sequence[int], known: PhraseFilter | None) -> pa.RecordBatch:
    """`id, n`: occurrences of the phrases of the lengths `orders`, by identifier. `known` has the words, or pairs of words, that
    may be part of one: the words for length 2, the pairs for 3 and 4."""
    parts, part = [], 1 if orders == (2,) else 2
    may = np.zeros(len(run.code), bool)
    for m, at, ids in run.phrases(max(orders)):
        if m == part:
            may[at] = True if known is None else known.has(ids)
        if m in orders:
            for k in range(0 if m > part else m, m - part + 1):
                kept = may[at + k]
                at, ids = at[kept], ids[kept]
            parts.append(ids)
    ids, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n.astype(np.int64))], ["id", "n"])


_STRIPE = "lang string, prefix array<string>, cells array<struct<next string, n long>>"


def _nested(columns: Sequence[pa.Array], rows: int) -> pa.ListArray:
    """An array of the columns' strings for each row."""
    flat = pa.concat_arrays([*columns, pa.array([], pa.string())])
    width = len(columns)
    order = (np.arange(rows)[:, None] + np.arange(width) * rows).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), flat.take(pa.array(order, pa.int64())))


def run_stripes(run: Run, orders: Sequence[int], known: PhraseFilter | None) -> Iterator[pa.RecordBatch]:
    """The stripes of a run for each phrase length of `orders`, of the phrases that `known` has, of all without. `known` must
    have the prefixes of what it has. With length 1 come the word occurrences of each language, as a cell without a word."""
    size = max(1, len(run.words))

    def batch(lang: np.ndarray, prefix: list[pa.Array], begins: np.ndarray, following: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        cells = pa.StructArray.from_arrays([following, pa.array(n.astype(np.int64))], ["next", "n"])
        stripes = pa.ListArray.from_arrays(pa.array(np.append(begins, len(n)), pa.int32()), cells)
        return pa.RecordBatch.from_arrays([run.langs.take(pa.array(lang)), _nested(prefix, len(lang)), stripes], ["lang", "prefix", "cells"])

    # Each phrase that goes on has a number; `before` gives for each its prefix's number and its last word.
    number, before = run.lang, []
    for m, at, ids in run.phrases(max(orders)):
        if m == 1 and m in orders:
            n = np.bincount(run.lang, minlength=len(run.langs))
            yield batch(np.arange(len(n)), [], np.arange(len(n)), pa.nulls(len(n), pa.string()), n)
        if known is not None and m in orders:
            kept = known.has(ids) & (number[at] >= 0)
            at = at[kept]
        found, index, n = np.unique(number[at] * size + run.code[at + m - 1], return_inverse=True, return_counts=True)
        if m in orders:
            prefix, begins = np.unique(found // size, return_index=True)
            own, parts = prefix, []
            for earlier in reversed(before):
                parts.insert(0, run.words.take(pa.array(earlier[own] % size)))
                own = earlier[own] // size
            yield batch(own, parts, begins, run.words.take(pa.array(found % size)), n)
        number = np.full(len(run.code), -1)
        number[at] = index
        before.append(found)


def _by_run(make):
    """Apply `make` to the runs of a partition's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in gathered(batches, "text", RUN_BYTES):
            _, offsets = text_arrays(texts.column("text"))
            for a, b in slices(offsets, RUN_BYTES):
                yield from make(Run.of(texts.column("text").slice(a, b - a), texts.column("lang").slice(a, b - a)))

    return run


def hashed_counts(docs: DataFrame, orders: Sequence[int], known: PhraseFilter | None = None) -> DataFrame:
    """`id, n`: a hashed phrase and its occurrences; no less than those of the phrase, more only where two phrases share an id."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    made = docs.select("text", "lang").mapInArrow(_by_run(lambda r: [phrase_counts(r, tuple(orders), sent.value)]), "id long, n long")
    return made.groupBy("id").agg(F.sum("n").alias("n"))


def stripe_cells(docs: DataFrame, orders: Sequence[int], known: PhraseFilter | None = None) -> DataFrame:
    """`lang, prefix, next, n`: the merged stripes of `docs` (`text, lang`). A stripe is merged cell by cell, as that of a frequent
    word, let alone of the empty prefix, would not fit a row."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    made = docs.select("text", "lang").mapInArrow(_by_run(lambda r: run_stripes(r, orders, sent.value)), _STRIPE)
    return made.select("lang", "prefix", F.inline("cells")).groupBy("lang", "prefix", "next").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, p: Mining) -> tuple[DataFrame, DataFrame]:
    """`lang, words, a` for all phrases of 1 to 4 words with `p.least` occurrences, and `lang, n` with all word occurrences of
    languages that have so many.

    Level by level: a phrase can be frequent only if its words, and its pairs of words, are. Which phrases may be frequent is
    counted by identifier, and goes on as a filter of fixed size; stripes with the words themselves are made of these alone,
    with all their occurrences. So counts are exact and whole, and nothing that grows with the corpus is broadcast.
    """
    enough = F.col("n") >= p.least
    ids, known = [], None
    for orders in ((1,), (2,), (3, 4)):
        ids.append(stored(hashed_counts(docs, orders, known).filter(enough).select("id"), "ids"))
        known = filter_of(ids[-1])
    known = filter_of(ids[0].unionByName(ids[1]).unionByName(ids[2]))
    cells = stored(stripe_cells(docs, (1, 2, 3, 4), known).filter(enough), "stripes")
    phrases = cells.filter(F.col("next").isNotNull()).select("lang", F.concat("prefix", F.array("next")).alias("words"), F.col("n").alias("a"))
    return phrases, cells.filter(F.col("next").isNull()).select("lang", "n")


def cohesion(a: Column, parts: Column, p: Mining) -> Column:
    """floor(scale * a / parts) in decimals, whose product does not pass 38 digits; the result is at most scale / 2."""
    return F.call_function("div", F.lit(p.scale).cast("decimal(10,0)") * a.cast("decimal(20,0)"), parts).cast("long")


def collocations(docs: DataFrame, p: Mining = Mining()) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score` of the `p.top` best phrases of each language (`docs`: `text, lang`; null texts
    count as empty, a null language as `und`). A language without candidates, and an empty table, give nothing.

    A phrase of a words is cut where its score is lowest; `l` and `r` are how often the parts occur. Both come from the
    stripes: a part is a prefix with its last word. The greatest extension of a phrase is the greatest cell of its own
    stripe or of the stripes that end in it.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    found, totals = frequent_phrases(docs, p)
    words, m = F.col("words"), F.size("words")
    candidates = found.filter(m >= 2)

    cuts = candidates.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("left"), F.slice(words, F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), F.slice(words, F.col("k") + 1, m - F.col("k")).alias("part")))
    sides = cuts.select("lang", "words", "a", "k", F.inline(sides))
    parts = stored(found.select("lang", F.col("words").alias("part"), F.col("a").alias("f")), "parts")
    met = lookup_join(sides, parts, ["lang", "part"], stored=True)
    met = met.groupBy("lang", "words", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = cohesion(F.col("a"), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)"), p)
    scored = met.groupBy("lang", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.array(F.slice(words, F.lit(1), m - 1), F.slice(words, F.lit(2), m - 1))
    longest = found.filter(m >= 3).select("lang", F.explode(inner).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    wide = "decimal(20,0)"
    covered = F.col("longer").cast(wide) * 100 >= F.col("a").cast(wide) * p.covered
    kept = scored.join(longest, ["lang", "words"], "left").filter(F.col("longer").isNull() | ~covered)
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
