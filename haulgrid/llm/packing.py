"""Packing into windows of equal length by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from haulgrid.llm.common import text_arrays

try:
    from public_tokenizers import PATTERN, path
except ImportError:  # the vocabulary can be given by path as well
    PATTERN, path = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", None

WINDOW = 1024
#: The id that ends a document.
END = 0
#: Remainders are cut into pieces of at most this many ids before they are balanced.
PIECE = 128
#: Windows that are balanced together, and how many ids of them all stay free for the imbalance.
GROUP = 32
SLACK = 64

def default_vocabulary() -> str:
    return path("byte_bpe_50k.tiktoken")


#: Without runs of white space the pattern's look-ahead is idle; leaving it out makes splitting much faster.
PLAIN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_RUNS = re.compile(r"\s\s")
#: White space of this length is beyond the stack of the fast encoder's pattern engine.
_LONG = re.compile(r"\s{10000}")


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of the tokenizers file beside the rank file, which stand for themselves in a text; without a file, none."""
    described = os.path.splitext(vocabulary)[0] + ".json"
    if not os.path.exists(described):
        return {}
    with open(described, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    odd = [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if odd:
        raise ValueError(f"added tokens that take in what is around them are not supported: {odd}")
    return {t["content"]: t["id"] for t in tokens}


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit numbers; an added token in a text is its own id, and what is
    before and after it is encoded by itself. Texts with very long white space go to the tokenizers library, which is slower
    and gives the same ids."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.added = added_tokens(vocabulary)
        self.vocabulary, self.slow = vocabulary, None
        self.full, self.plain = (tiktoken.Encoding("vocabulary", pat_str=p, mergeable_ranks=ranks, special_tokens=self.added) for p in (PATTERN, PLAIN))

    def text(self, text: str) -> bytes:
        if _LONG.search(text):
            if self.slow is None:
                self.slow = tokenizers.Tokenizer.from_file(os.path.splitext(self.vocabulary)[0] + ".json")
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        encoding = self.full if _RUNS.search(text) else self.plain
        if any(t in text for t in self.added):
            return array("I", encoding.encode(text, allowed_special="all")).tobytes()
        return array("I", encoding.encode_ordinary(text)).tobytes()


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Split the items into `k` parts of nearly equal sums: always merge the two partial partitions of the largest spread,
    the largest part of one with the smallest of the other. Returns the numbers of the items of each part."""
    heap = [(-s, n, ((s, (n,)),)) for n, s in enumerate(sizes)]  # parts that are empty are not written down
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # a is largest first, b is added smallest first; missing parts count as 0.
        pad = k - len(b)
        merged = [*a[:pad]] if pad < len(a) else [*a]
        if pad < len(a):
            tail, low = a[pad:], b[::-1]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(tail, low)] + [*low[len(tail) :]]
        else:
            merged += b
        merged.sort(key=lambda x: -x[0])
        if len(merged) == k:
            least = merged[-1][0]
            spread = merged[0][0] - least
        else:
            spread = merged[0][0]
        heapq.heappush(heap, (-spread, n, tuple(merged)))
        n += 1
    parts = [list(x[1]) for x in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


class Packer:
    """Windows of one task. Whole windows of long documents stand alone; remainders are cut into small pieces, gathered
    until they fill `GROUP` windows up to `SLACK` ids, and balanced over them; a group whose largest part passes the
    window gets one window more until all fit."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.room = GROUP * window - SLACK * window // WINDOW
        self.pieces: list[tuple] = []
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total // self.window
        for k in range(whole):
            self._emit([self._piece(doc_id, ids, k * self.window, self.window, total)])
        start, left = whole * self.window, total % self.window
        for n in range(-(-left // PIECE), 0, -1):
            length = -(-(total - start) // n)
            if self.held + length > self.room:
                self.flush()
            self.pieces.append(self._piece(doc_id, ids, start, length, total))
            self.held += length
            start += length

    @staticmethod
    def _piece(doc_id: int | None, ids: bytes, start: int, length: int, total: int) -> tuple:
        part = ids[4 * start : 4 * (start + length)]
        return doc_id, start, length, zlib.crc32(part), total, part

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.out.append((*p, self.next_id, offset))
            offset += p[2]
        self.next_id += 1

    def flush(self) -> None:
        sizes = [p[2] for p in self.pieces]
        k = -(-self.held // self.window)
        while k:
            parts = karmarkar_karp(sizes, k)
            if max(sum(sizes[n] for n in part) for part in parts) <= self.window:
                for part in parts:
                    self._emit([self.pieces[n] for n in part])
                break
            k += 1
        self.pieces, self.held = [], 0


_COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pack all documents (`doc_id, text`) into sequences of at most `window` ids: one row per piece with `doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset`, and `ids` (little-endian unsigned 32-bit) if asked for.

    A document is its byte-level BPE ids and then id 0; a null or empty text is that id alone. Every task packs what it
    reads in one pass: no shuffle, and no more than one group of windows in memory. `sequence_id` holds the partition in
    its upper bits. Rows that stand in the table twice are packed twice; an empty table gives no piece.
    """
    vocabulary = vocabulary or default_vocabulary()
    columns = [c for c in _COLUMNS if with_ids or c[0] != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(vocabulary), Packer(window, TaskContext.get().partitionId() << 36)

        def taken() -> pa.RecordBatch:
            by = list(zip(*packer.out)) or [()] * len(_COLUMNS)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for (name, t), v in zip(_COLUMNS, by) if with_ids or name != "ids"], [c[0] for c in columns])

        end = END.to_bytes(4, "little")
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            raw = memoryview(data)
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc_id, encoder.text(str(raw[offsets[k] : offsets[k + 1]], "utf-8")) + end)
                if len(packer.out) > 20_000:
                    yield taken()
            yield taken()
        packer.flush()
        yield taken()

    kinds = {pa.int64(): "long", pa.binary(): "binary"}
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in columns))
