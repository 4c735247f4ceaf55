"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures, confirmed on the full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulgrid.functions.scale import lookup_join
from haulgrid.llm.common import ONE_TASK, narrow, packed, row_keyed, slices, stored, text_arrays
from haulgrid.llm.components import components
from haulgrid.llm.hashing import mix, word_table, words

#: Words are separated by blank, tab, line feed, vertical tab, form feed, carriage return; A-Z are lowered.
WORD_BYTES = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")
RUN_BYTES = 1 << 18


@dataclass(frozen=True)
class Signature:
    """`chunks` chunks of `lanes` values of 16 bits each; `errors` values of a chunk may differ.

    By pigeonhole, two signatures that differ in at most `radius` values have a chunk with at most `errors` differing
    values; leaving out every choice of `errors` values of every chunk therefore brings all such pairs together, and many
    beyond. A pair of similarity 0.8 differs in a fifth of its values on average; the chance that it has no common key is
    about 2e-6 at the defaults. Pairs met by chance are let go if they differ in more than `most_differing` values, which
    a pair of similarity 0.8 does with a chance of about 1e-7.
    """

    words: int = 5
    chunks: int = 10
    lanes: int = 5
    errors: int = 1
    percent: int = 80
    most_differing: int = 26
    seed: int = 7

    @property
    def values(self) -> int:
        return self.chunks * self.lanes

    @property
    def radius(self) -> int:
        return self.chunks * (self.errors + 1) - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of every text as sorted 64-bit identifiers. A text of fewer words is one shingle of all of
    them, a text without words has none."""
    for a, b in slices(offsets, RUN_BYTES):
        part = offsets[a : b + 1]
        _, _, ids, first = words(data[part[0] : part[-1]], part - part[0], WORD_BYTES)
        rolled = ids.copy()
        for k in range(1, n_words):
            rolled[: len(ids) - k] = mix(rolled[: len(ids) - k] * np.uint64(0x9FB21C651E98DF25) + ids[k:])
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= n_words:
                yield np.unique(rolled[lo : hi - n_words + 1])
            elif hi > lo:
                yield np.frombuffer(hashlib.blake2b(ids[lo:hi].tobytes(), digest_size=8).digest(), np.uint64)
            else:
                yield ids[:0]


_SIGNED = "_row long, n long, same binary, signature binary"


def _signer(p: Signature):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(p.seed)
        factors = rng.integers(1, 1 << 63, p.values, np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 1 << 63, p.values, np.uint64)
        for batch in batches:
            sizes, same, signatures = [], [], []
            for found in shingle_sets(*text_arrays(batch.column("text")), p.words):
                sizes.append(len(found))
                same.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                if len(found):
                    least = np.full(p.values, 1 << 63, np.uint64)
                    for k in range(0, len(found), 4096):
                        np.minimum(least, (((found[k : k + 4096] * factors[:, None] + shifts[:, None]) >> np.uint64(24)).min(axis=1)), out=least)
                    signatures.append(mix(least).astype(np.uint16).tobytes())
                else:
                    signatures.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(signatures, pa.binary())], ["_row", "n", "same", "signature"])

    return run


def chunk_keys(p: Signature):
    """All keys of a signature: for each chunk and each choice of values left out, a hash of the values that remain."""
    keys = []
    for c in range(p.chunks):
        for kept in combinations(range(p.lanes), p.lanes - p.errors):
            values = [F.substring("signature", 2 * (c * p.lanes + k) + 1, 2) for k in kept]
            keys.append(F.xxhash64(F.lit(c), F.lit(sum(1 << k for k in kept)), F.concat(*values)))
    return F.array(*keys)


def _sets(p: Signature):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(*text_arrays(batch.column("text")), p.words)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.list_(pa.int64()))], ["_row", "shingles"])

    return run


def _similar(p: Signature):
    @F.arrow_udf(T.BooleanType())
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= p.percent * (len(a) + len(b) - both))
        return pa.array(out)

    return similar


def _near(p: Signature):
    @F.arrow_udf(T.BooleanType())
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(text_arrays(x)[0], np.uint16).reshape(-1, p.values) for x in (left, right))
        return pa.array((a != b).sum(axis=1) <= p.most_differing)

    return near


def _candidates(pairs: DataFrame, classes: DataFrame, p: Signature) -> DataFrame:
    """Distinct pairs (`a` < `b`) whose set sizes and signatures allow the similarity."""
    fits = 100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b")
    pairs = pairs.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    return _with_both(stored(pairs, "pairs"), classes, "a", "signature").filter(_near(p)("_left", "_right")).select("a", "b")


def _with_both(pairs: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """The stored `pairs` with `value` of their rows in `table` as `_left` and `_right`. Each side is cut to the rows that are that end of
    a pair before it is shuffled."""
    both, each = pairs, F.array(*[F.struct(F.col(end).alias("end"), F.lit(end == "a").alias("is_a")) for end in ("a", "b")])
    ends = narrow(pairs).select(F.inline(each)).groupBy("end").agg(F.bool_or("is_a").alias("_left"), F.bool_or(~F.col("is_a")).alias("_right"))
    ends = stored(ends, "ends")
    for end, name in (("a", "_left"), ("b", "_right")):
        side = table.select(F.col(key).alias(end), F.col(value).alias(name))
        both = both.join(lookup_join(side, ends.filter(name).select(F.col("end").alias(end)), [end], stored=True), end)
    return both


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, p: Signature) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    return _with_both(pairs, sets, "_row", "shingles").filter(_similar(p)("_left", "_right")).select("a", "b")


#: Buckets of at most this many rows give all their pairs at once.
SMALL = 8
#: In larger ones, parts of about this many rows do, dealt anew in each of so many rounds.
PART = 48
ROUNDS = 2
#: A row of the full tests carries so many of the shingles before its own.
BEFORE = 16


def _contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` (`node`, `root`) after the confirmed `links` (`a`, `b`) between nodes."""
    n_links = links.count()
    if not n_links:
        return roots
    few = max(n_links, roots.count()) <= ONE_TASK
    roots, ends = (t.coalesce(1) if few else t for t in (roots, links))
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"r_{end}"))
        ends = ends.join(own, end)
    ends = ends.select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))
    found = components(ends.coalesce(1) if few else ends)
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    return stored(moved.select("node", F.coalesce("_to", "root").alias("root")), "roots")


def _by_row(rows: DataFrame) -> DataFrame:
    """One row for each `a`, with the `keys` of its buckets: as many as a signature has, at most."""
    return stored(rows.groupBy("a", "n").agg(F.collect_list("key").alias("keys")), "large")


def _open(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets that lie in several components: `key, a, n, root, first, size`; `first` is the least row of the bucket.
    Components are looked up once a row, not once for each of its buckets."""
    few = max(large.agg(F.sum(F.size("keys"))).first()[0] or 0, roots.count()) <= ONE_TASK
    large, roots = (t.coalesce(1) if few else t for t in (large, roots))
    named = large.join(roots.select(F.col("node").alias("a"), "root"), "a").select(F.explode("keys").alias("key"), "a", "n", "root")
    named = named.coalesce(1) if few else named
    parts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("s"), F.min("a").alias("first"))
    sizes = parts.groupBy("key").agg(F.min("first").alias("first"), F.sum("s").alias("size"), F.count(F.lit(1)).alias("_parts"))
    return stored(named.join(sizes.filter("_parts > 1").drop("_parts"), "key"), "open")


def _few_tests(rows: DataFrame, step: int) -> DataFrame:
    """A few pairs for every row of the open buckets, in the largest of its buckets only: first with the bucket's least row,
    then with the rows of its part, of which each has about `PART`."""
    best = rows.groupBy("a", "n", "root").agg(F.max(F.struct("size", "key", "first")).alias("_b"))
    best = best.select("a", "n", "root", "_b.size", "_b.key", "_b.first")
    if step == 0:
        firsts = rows.filter("a = first").select("key", F.col("a").alias("b"), F.col("n").alias("n_b"))
        return best.select("key", "a", F.col("n").alias("n_a")).join(firsts, "key").filter("a != b")
    dealt = best.withColumn("part", F.pmod(F.xxhash64("a", F.lit(step)), F.ceil(F.col("size") / PART)))
    others = dealt.select("key", "part", F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("_root"))
    left = dealt.withColumnRenamed("n", "n_a")
    return left.join(others, (left["key"] == others["key"]) & (left["part"] == others["part"]) & (left["a"] < others["b"]) & (left["root"] != others["_root"])).select("a", "n_a", "b", "n_b")


def _rarest(rows: DataFrame, sets: DataFrame, p: Signature) -> DataFrame:
    """`a, own, prefix`: how many shingles no other of these rows has, and the rarest of the others, from the rarest on.

    In any order of all shingles, of two sets x and y that need m shingles in common the first |x| - m + 1 of x and the first
    |y| - m + 1 of y meet. The order here is by the number of these rows that have the shingle, so a row of many changes is
    left with its own. `prefix` reaches as far as the smallest m asks.
    """
    own = lookup_join(sets, stored(rows.select(F.col("a").alias("_row")).distinct(), "ends"), ["_row"], stored=True)
    tokens = stored(own.select(F.col("_row").alias("a"), F.size("shingles").alias("size"), F.explode("shingles").alias("token")), "tokens")
    counted = tokens.join(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    ranked = counted.groupBy("a", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"), F.count_if(F.col("df") == 1).cast("int").alias("own"))
    length = (F.col("size") - F.ceil(F.col("size") * p.percent / 100) + 1).cast("int")
    return ranked.select("a", "own", F.transform(F.filter(F.slice("ranked", F.lit(1), length), lambda x: x["df"] > 1), lambda x: x["token"]).alias("prefix"))


def _all_tests(rows: DataFrame, sets: DataFrame, p: Signature) -> DataFrame:
    """Every pair of rows that share an open bucket, lie in different components and whose rarest shingles meet: at
    the first shingle that both have among as many of the rarest as the sizes of the two ask for. The rows meet by these
    shingles and not by their buckets, so a bucket of very many rows is not gone through pair by pair. A row of the join holds only
    the last `BEFORE` shingles before its own, not all: they would grow with the square of a text's length. A pair may
    therefore come more than once, but never less."""
    keys = rows.groupBy("a", "n", "root").agg(F.collect_list("key").alias("keys"))
    full = stored(keys.join(_rarest(rows, sets, p).filter(F.size("prefix") > 0), "a"), "full")
    before = F.slice("prefix", F.greatest(F.col("pos") - BEFORE, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(BEFORE)))
    tokens = full.select("*", F.posexplode("prefix").alias("pos", "token")).withColumn("before", before).drop("prefix")
    left = tokens.withColumnRenamed("n", "n_a")
    # Merged: Spark takes the rows for as many as their texts, and would send the driver all shingles of long ones.
    right = tokens.toDF(*[f"_{c}" for c in tokens.columns]).withColumnsRenamed({"_a": "b", "_n": "n_b"}).hint("merge")
    needed = F.ceil(p.percent * (F.col("n_a") + F.col("n_b")) / (100 + p.percent) - 1e-9)
    early = [F.col(pos) < F.col(n) - needed + 1 - F.col(own) for pos, n, own in (("pos", "n_a", "own"), ("_pos", "n_b", "_own"))]
    apart = (F.col("a") < F.col("b")) & (F.col("root") != F.col("_root")) & F.arrays_overlap("keys", "_keys")
    met = (F.col("token") == F.col("_token")) & early[0] & early[1] & apart & ~F.arrays_overlap("before", "_before")
    return left.join(right, met).select("a", "n_a", "b", "n_b")


def near_classes(keyed: DataFrame, p: Signature = Signature()) -> DataFrame:
    """`_row, n, component` for every row of `keyed` (`_row, text`): the size of its shingle set and the least `_row` that
    links reach. Rows without shingles (null, empty or blank texts) are linked with nothing, not with each other.

    1. Rows with equal shingle sets form a class; its least row stands for it, so copies never meet as pairs.
    2. Class rows are keyed by chunk and choice of values left out; rows with a common key share a bucket.
    3. Buckets of a few rows give all their pairs. In larger ones every row is first tested with the bucket's least row,
       then with some others, dealt anew by a hash each round; confirmed links are contracted to components, and a
       bucket within one component is finished. What is left between components after the rounds is tested in full:
       rows of different components that share a bucket and whose rarest shingles meet, as those of linked sets must. No link between different components is lost, and a group of thousands of near copies costs
       about in proportion to its size.
    4. Every link is confirmed on the full sets of both texts.
    """
    signed = stored(keyed.select("_row", "text").mapInArrow(_signer(p), _SIGNED), "signed")
    classes = stored(signed.filter("n > 0").groupBy("same", "n", "signature").agg(F.min("_row").alias("a")), "classes")
    keys = classes.select(F.explode(chunk_keys(p)).alias("key"), "a", "n")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    # Merged: by the size of the classes' files Spark would take the fifty keys of each for a small table and broadcast them.
    buckets = stored(keys.join(shared.hint("merge"), "key"), "buckets")

    small = buckets.filter(F.col("_size") <= SMALL)
    large = _by_row(buckets.filter(F.col("_size") > SMALL))
    ends = small.select("key", F.col("a").alias("b"), F.col("n").alias("n_b"))
    met = small.withColumnRenamed("n", "n_a").join(ends, "key").filter("a < b")
    first = stored(_candidates(met, classes, p), "candidates")
    wanted = stored(_ends(first).unionByName(large.select(F.col("a").alias("_row"))).distinct(), "wanted")
    sets = stored(lookup_join(keyed.select("_row", "text"), wanted, ["_row"], stored=True).mapInArrow(_sets(p), "_row long, shingles array<long>"), "sets")
    roots = _contracted(wanted.select(F.col("_row").alias("node"), F.col("_row").alias("root")), stored(_confirmed(first, sets, p), "links"))
    for step in range(ROUNDS + 2):
        rows = _open(large, roots)
        if rows.isEmpty():
            break
        if step <= ROUNDS:
            few = max(rows.count(), large.count() * PART // 2) <= ONE_TASK
            tests = _few_tests(rows.coalesce(1) if few else rows, step)
            tests = tests.coalesce(1) if few else tests
        else:
            tests = _all_tests(rows, sets, p)
        candidates = stored(_candidates(tests, classes, p), "candidates")
        roots = _contracted(roots, stored(_confirmed(candidates, sets, p), "links"))
        large = _by_row(narrow(rows))
    owned = classes.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("same", F.coalesce("root", "a").alias("_root"))
    return signed.join(owned.hint("merge"), "same", "left").select("_row", "n", F.coalesce("_root", "_row").alias("component"))


def with_ids(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """Add to the rows of `near_classes` their `doc_id`, and as `component_id` that of the component's least row."""
    ids = keyed.select("_row", "doc_id")
    if ids.filter(~F.col("_row").eqNullSafe(F.col("doc_id"))).isEmpty():
        return found.withColumns({"doc_id": F.col("_row"), "component_id": F.col("component")})
    own = stored(found.join(ids, "_row"), "classes")
    return own.join(ids.select(F.col("_row").alias("component"), F.col("doc_id").alias("component_id")), "component")


def drop_near_copies(docs: DataFrame, p: Signature = Signature()) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component the one with the smallest doc_id (nulls
    last), and every row without words."""
    keyed = row_keyed(packed(docs))
    kept = stored(near_classes(keyed.select("_row", "text"), p).filter("_row = component").select("_row"), "kept")
    return keyed.join(kept, "_row", "left_semi").select("doc.*")

