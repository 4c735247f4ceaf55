"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items, each text read once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulgrid.llm.common import stored, text_arrays
from haulgrid.llm.hashing import word_table

#: Words are runs of ASCII letters and digits (A-Z lowered) and of everything beyond ASCII.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LOWER = bytes(word_table(SEPARATORS)).replace(b"\0", b" ")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Test items of this many bytes together make one automaton; more items are looked up in further passes.
BLOCK_BYTES = 8 << 20

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())),
])


def item_windows(text: str | None, window: int) -> list[str]:
    found = (text or "").encode().translate(_LOWER).decode().split(" ")
    found = [w for w in found if w]
    return [" ".join(found[k : k + window]) for k in range(max(1, len(found) - window + 1))] if found else []


class Windows:
    """The automaton; a pattern has a blank at both ends, so it only meets whole words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        by: dict[str, set[str]] = {}
        for item, text in items:
            for w in item_windows(text, window):
                by.setdefault(w, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, owners in by.items():
            self.automaton.add_word(f" {w} ", (len(w) + 2, w.count(" ") + 1, tuple(owners)))
        self.empty = not by
        if by:
            self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], list[int], list[str]]:
        """Words of a text; runs of hit words as offsets (code points) in the original; numbers of the hit words; items."""
        found = raw.translate(_LOWER).split()
        if self.empty or not found:
            return len(found), [], [], []
        line = f" {b' '.join(found).decode()} "
        hit: set[int] = set()
        items: set[str] = set()
        starts = None
        for end, (length, n, owners) in self.automaton.iter(line):
            if starts is None:
                codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
                starts = np.flatnonzero(codes == 32)  # the blank before each word
            k = int(np.searchsorted(starts, end - length + 1))
            hit.update(range(k, k + n))
            items.update(owners)
        numbers = sorted(hit)
        return len(found), self._original(raw, numbers), numbers, sorted(items)

    @staticmethod
    def _original(raw: bytes, numbers: list[int]) -> list[tuple[int, int]]:
        """Offsets of runs of consecutive word numbers, mapped back to the text as it was."""
        if not numbers:
            return []
        places = [m.span() for m in _WORD.finditer(raw)]
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        runs, first = [], numbers[0]
        for k, following in zip(numbers, [*numbers[1:], None]):
            if following != k + 1:
                runs.append((int(points[places[first][0]]), int(points[places[k][1]])))
                first = following
        return runs


def _scanner(items: list[tuple[str, str | None]], window: int, spark):
    sent = spark.sparkContext.broadcast(items)

    @F.arrow_udf(HITS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = Windows(sent.value, window)
        for texts in batches:
            data, offsets = text_arrays(texts)
            raw = memoryview(data)
            rows = [windows.scan(bytes(raw[offsets[k] : offsets[k + 1]])) for k in range(len(texts))]
            yield pa.array(
                [{"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "words": numbers, "items": found} for n, spans, numbers, found in rows],
                pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]),
            )

    return scan


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add `hits` to every row of `docs`: struct of `n_words`, `spans` (hit passages as code-point offsets in the original
    text), `words` (numbers of the hit words), `items` (item ids as strings, sorted).

    A window is `window` consecutive words of an item. Null and empty texts have no words; items without words and items
    without an id have no windows. Repeated items count once. A column of `docs` named `hits` is replaced.
    The items reach the tasks in blocks of at most about `block_bytes` of text; with one block the documents are read
    once, with more the passes follow each other over written tables and their hits are merged.
    """
    spark = docs.sparkSession
    items = stored(benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text"), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else items
        scan = _scanner([(r["item"], r["text"]) for r in part.collect()], window, spark)(F.col("text"))
        if k == 0:
            out = out.withColumn("hits", scan)
        else:
            both = out.withColumn("_more", scan)
            numbers = F.array_sort(F.array_union("hits.words", "_more.words"))
            out = both.withColumn("hits", F.struct(
                F.col("hits.n_words").alias("n_words"), F.array_sort(F.array_union("hits.spans", "_more.spans")).alias("spans"),
                numbers.alias("words"), F.array_sort(F.array_union("hits.items", "_more.items")).alias("items"))).drop("_more")
        if blocks > 1:
            out = stored(out, "scanned")
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
