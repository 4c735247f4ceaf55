"""Removal of repeated byte strings by bucket-pointer refinement: positions fall into buckets by a q-gram, and buckets
are refined by the bucket identifiers of later offsets until they tell whole strings of the wanted length apart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.functions.scale import lookup_join
from haulgrid.llm.common import slices, stored, text_arrays
from haulgrid.llm.hashing import mix, prefix_sums, run_ids

#: Strings of this many bytes are judged.
LENGTH = 100
#: The initial buckets are by q-grams of this many bytes.
GRAM = 24
#: Texts are read in runs of about this many bytes; a longer text in overlapping parts.
RUN_BYTES = 1 << 20

_SEGMENTS = "key long, seg long, _row long, start int, windows int, lead int, settled boolean"


def _parts(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, from, to): runs of whole texts, or parts of one text that share `length` - 1 bytes."""
    for a, b in slices(offsets, RUN_BYTES):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= RUN_BYTES + length:
            yield a, b, lo, hi
        else:
            for at in range(lo, hi - length + 1, RUN_BYTES):
                yield a, b, at, min(hi, at + RUN_BYTES + length - 1)


def _least_in(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (width - done)], v[width - done :]) if done < width else v


def anchored(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of `length` bytes that share their anchor, the q-gram with the least identifier in the window:
    (first window, last window, anchor, identifier of the anchor's q-gram, identifier of the bytes that the run covers).

    Which q-gram is the anchor depends on the window's bytes alone, so equal windows have equal anchors at equal places.
    `bounds` are the places where texts begin and end in `data`; no window crosses one.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(data)
    places = np.arange(len(data) - gram + 1, dtype=np.int64)
    grams = run_ids(sums, places, places + gram)
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    anchor = (_least_in(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    steps = np.zeros(len(anchor) + 1, np.int32)
    inner = np.minimum(np.maximum(bounds[1:-1] - length + 1, 0), len(anchor))
    inner = np.maximum(inner, np.minimum(bounds[:-2], len(anchor)))
    np.add.at(steps, inner, 1)
    np.add.at(steps, np.minimum(bounds[1:-1], len(anchor)), -1)
    windows = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    if not len(windows):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    of = anchor[windows]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first, last, at = windows[new], windows[np.append(new[1:], len(windows)) - 1], of[new]
    covered = mix(run_ids(sums, first, last + length) + (at - first).astype(np.uint64))
    return first, last, at, grams[at], covered


def _segments(length: int, gram: int):
    """Per Arrow batch: segments; one that the batch has already is settled and leaves as a covered run of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            rows = batch.column("_row").to_numpy(zero_copy_only=False).astype(np.int64)
            found: list[list[np.ndarray]] = []
            for a, b, lo, hi in _parts(offsets, length):
                bounds = np.clip(offsets[a : b + 1], lo, hi) - lo
                first, last, at, key, covered = anchored(data[lo:hi], bounds, length, gram)
                text = a + np.searchsorted(bounds, first, "right") - 1
                # Empty texts share a bound; the last text that begins there is meant.
                found.append([key, covered, rows[text] if len(text) else first, first + lo - offsets[text], last - first + 1, at - first])
            if not found:
                continue
            key, seg, row, start, windows, lead = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, row, seg, key))
            same = np.zeros(len(key), bool)
            same[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (seg[order[1:]] == seg[order[:-1]])
            # Settled runs that touch or overlap within a text become one.
            s = np.lexsort((start, row))
            s = s[same[s]]
            r, lo_, hi_ = row[s], start[s].astype(np.int64), (start[s] + windows[s] + length - 1).astype(np.int64)
            begin = np.ones(len(s), bool)
            begin[1:] = (r[1:] != r[:-1]) | (lo_[1:] > hi_[:-1])
            g = np.flatnonzero(begin)
            ends = np.maximum.reduceat(hi_, g) if len(g) else hi_
            keep = ~same
            out = (
                np.concatenate([key[keep].view(np.int64), mix(r[g].astype(np.uint64)).view(np.int64)]), np.concatenate([seg[keep].view(np.int64), np.zeros(len(g), np.int64)]),
                np.concatenate([row[keep], r[g]]), np.concatenate([start[keep], lo_[g]]).astype(np.int32), np.concatenate([windows[keep], ends - lo_[g] - length + 1]).astype(np.int32),
                np.concatenate([lead[keep], np.zeros(len(g), np.int64)]).astype(np.int32), np.concatenate([np.zeros(keep.sum(), bool), np.ones(len(g), bool)]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], [f.split()[0] for f in _SEGMENTS.split(", ")])

    return run


def refined(data: np.ndarray, first: int, windows: int, length: int) -> np.ndarray:
    """Identifiers of `windows` consecutive strings: buckets of a quarter of the length, refined by the bucket at the
    offset of a quarter, then the refined ones by that at the offset of a half."""
    part = data[first : first + windows + length - 1]
    quarter = -(-length // 4)
    sums = prefix_sums(part)
    places = np.arange(len(part) - quarter + 1, dtype=np.int64)
    ids, size = run_ids(sums, places, places + quarter), quarter
    while size < length:
        step = min(size, length - size)
        ids = mix(ids[: len(ids) - step] * np.uint64(0x9FB21C651E98DF25) + ids[step:])
        size += step
    return ids[:windows]


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            keys, ids, rows, places = [], [], [], []

            def taken() -> pa.RecordBatch:
                out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, ids, rows, places)]
                for x in (keys, ids, rows, places):
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2].astype(np.int64)), pa.array(out[3].astype(np.int32))], ["key", "id", "_row", "start"])

            for k, (row, segments) in enumerate(zip(batch.column("_row").to_pylist(), batch.column("segments").to_pylist())):
                text = data[offsets[k] : offsets[k + 1]]
                for s in segments:
                    # Windows of one anchor are told apart by its place in them as well.
                    at = np.arange(s["windows"])
                    found = mix(refined(text, s["start"], s["windows"], length) + (s["lead"] - at).astype(np.uint64))
                    keys.append(np.full(s["windows"], s["key"], np.int64))
                    ids.append(found.view(np.int64))
                    rows.append(np.full(s["windows"], row, np.int64))
                    places.append((s["start"] + at).astype(np.int32))
                if len(keys) > 2000:
                    yield taken()
            yield taken()

    return run


def repeated_runs(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`_row, runs`: for every text of `keyed` (`_row, text`) that has any, the covered runs (`start`, `end` in bytes, may
    overlap) of strings of `length` bytes that also start earlier: in a lower `_row`, or before in the same text.

    1. Every window of `length` bytes has an anchor, the q-gram of least identifier in it; windows in a row with the same
       anchor are a segment. The anchors' q-grams are the initial buckets, about one position in forty.
    2. A bucket is refined by what all its segments cover. Of equal segments the earliest is the first, the others are
       repeats in full. A bucket of one position, or of equal segments only, is finished. Copies that meet in a task
       are settled there, so what very many texts share leaves a task once.
    3. In buckets that hold different segments, the first of each gives its single windows. Their identifiers come from
       buckets of a quarter of the length, refined by the bucket identifiers at later offsets, the refined ones used for
       the next step. Of equal windows the earliest is the first, the others are repeats.
    Identifiers have 64 bits and only count within a bucket, whose own identifier has 64 bits more.
    """
    found = keyed.select("_row", "text").mapInArrow(_segments(length, gram), _SEGMENTS)
    within = Window.partitionBy("key", "seg").orderBy("_row", "start")
    bucket = Window.partitionBy("key")
    marked = (
        found.withColumn("rank", F.row_number().over(within))
        .withColumn("several", F.min("seg").over(bucket) != F.max("seg").over(bucket))
        .withColumn("repeat", F.col("settled") | (F.col("rank") > 1))
        .filter("repeat or several")
        .select(F.when(~F.col("repeat"), F.col("key")).alias("key"), "_row", "start", "windows", "lead", "repeat")
    )
    marked = stored(marked, "segments")
    mixed = marked.filter(~F.col("repeat")).groupBy("_row").agg(F.collect_list(F.struct("key", "start", "windows", "lead")).alias("segments"))
    texts = lookup_join(keyed.select("_row", "text"), stored(mixed, "mixed"), ["_row"], stored=True, weight=F.size("segments"))
    windows = texts.mapInArrow(_windows(length), "key long, id long, _row long, start int")
    order = Window.partitionBy("key", "id").orderBy("_row", "start")
    single = stored(windows.withColumn("rank", F.row_number().over(order)).filter("rank > 1").select("_row", "start"), "windows")
    covered = marked.filter("repeat").select("_row", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end"))
    covered = covered.unionByName(single.select("_row", "start", (F.col("start") + length).alias("end")))
    return covered.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


_CUT = "_row long, doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept binary"


def remove_repeats(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """`_row, doc_id, n_bytes, n_removed, spans, kept_sha256` and `kept` (the bytes that stay; left null without
    `with_kept`) for every row of `keyed` (`_row, doc_id, text`).

    Strings are judged on the input. Null and empty texts have no bytes; a text shorter than `length` stays whole. Rows with
    the same text repeat each other: the lowest `_row` keeps its bytes.
    """
    runs = repeated_runs(keyed, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            lists = batch.column("runs")
            out: list[tuple] = []
            for k in range(batch.num_rows):
                text, found = data[offsets[k] : offsets[k + 1]], lists[k].values
                spans, kept = [], text.tobytes()
                if found is not None and len(found):
                    a, b = (found.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (0, 1))
                    steps = np.bincount(a, minlength=len(text) + 1) - np.bincount(b, minlength=len(text) + 1)
                    gone = np.cumsum(steps[: len(text)]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans, kept = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])], text[~gone].tobytes()
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            by = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), *[pa.array(v, t) for v, t in zip(by, kinds)]], ["_row", "doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return keyed.select("_row", "doc_id", "text").join(runs, "_row", "left").mapInArrow(run, _CUT)
