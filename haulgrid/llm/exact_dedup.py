"""Exact deduplication by Grace hashing: spill files by hash, split again until a bucket fits, then a table that
compares complete content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.common import forget, packed, row_keyed, store, stored, text_arrays

#: What the comparison of texts leaves out.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A bucket fits a task's table up to this many bytes of content.
BUCKET_BYTES = 32 << 20
#: Bits of the hash that one level of splitting uses.
LEVEL_BITS = 8


class ContentTable:
    """Open addressing with linear probing; equal hashes are told apart by the complete content."""

    def __init__(self, slots: int = 1 << 10):
        self.slots: list[int] = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.owners: list[int] = []
        self.bytes = 0

    def _place(self, slots: list[int], h: int, content: bytes | None) -> int:
        mask = len(slots) - 1
        at = h & mask
        while (k := slots[at]) >= 0 and (content is None or self.hashes[k] != h or self.contents[k] != content):
            at = (at + 1) & mask
        return at

    def owner(self, h: int, content: bytes, row: int) -> int:
        """The row that brought this content first; `row` itself where the content is new."""
        at = self._place(self.slots, h, content)
        if self.slots[at] >= 0:
            return self.owners[self.slots[at]]
        self.slots[at] = len(self.owners)
        self.hashes.append(h)
        self.contents.append(content)
        self.owners.append(row)
        self.bytes += len(content)
        if 2 * len(self.owners) > len(self.slots):
            larger = [-1] * (2 * len(self.slots))
            for k, kept in enumerate(self.hashes):
                larger[self._place(larger, kept, None)] = k
            self.slots = larger
        return row


_HASHED = "_row long, doc_id long, n long, h long, sha binary, owner long, size long, content binary"


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalise and hash; copies within a task point to the first one and carry no content on."""
    seen = ContentTable()
    for batch in batches:
        data, offsets = text_arrays(batch.column("text"))
        raw, rows = memoryview(data), batch.column("_row").to_pylist()
        shas, hashes, owners, sizes, contents = [], [], [], [], []
        for k, row in enumerate(rows):
            content = bytes(raw[offsets[k] : offsets[k + 1]]).translate(None, BLANKS)
            sha = hashlib.sha256(content).digest()
            h = int.from_bytes(sha[:8], "big", signed=True)
            if seen.bytes > BUCKET_BYTES:
                seen = ContentTable()
            owner = seen.owner(h, content, row)
            shas.append(sha)
            hashes.append(h)
            owners.append(owner)
            sizes.append(len(content))
            contents.append(content if owner == row else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("doc_id"), batch.column("n"), pa.array(hashes, pa.int64()), pa.array(shas, pa.binary()),
             pa.array(owners, pa.int64()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())],
            ["_row", "doc_id", "n", "h", "sha", "owner", "size", "content"],
        )


def _table_pass(thin: bool):
    """A table per bucket over rows sorted by bucket. `thin`: while splitting, copies that meet lose their content, and
    the table starts afresh when it is full; else every row gets the final owner of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seen = None, ContentTable()
        for batch in batches:
            owners, contents = [], []
            for b, h, row, content in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "_row", "content"))):
                if b != bucket or thin and seen.bytes > BUCKET_BYTES:
                    bucket, seen = b, ContentTable()
                owner = seen.owner(h, content, row)
                owners.append(owner)
                contents.append(content if owner == row else None)
            out = [batch.column("_row"), pa.array(owners, pa.int64())]
            names = ["_row", "owner"]
            if thin:
                out += [batch.column("h"), batch.column("size"), pa.array(contents, pa.binary())]
                names += ["h", "size", "content"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _with_bucket(df: DataFrame, bits: int) -> DataFrame:
    return df.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))


def _by_bucket(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket", "_row")


def content_classes(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Class of every row by its text without blanks (null: empty): `_row, doc_id, n, sha, cls`.

    `docs` has `_row` (unique), `doc_id`, `text`; `cls` is the `_row` of one member, `n` the code points.

    1. Each task hashes its texts and writes them; a copy of a text that the task has seen carries no content, so a
       text that a third of the rows share leaves a task once for each table's fill, not once a row.
    2. The rows are dealt into buckets by the leading bits of the hash, as many as the total size asks for.
    3. Buckets over `bucket_bytes` are written to spill files under `LEVEL_BITS` more bits, again and again. Every such
       pass drops the content of copies that meet in a task, so a bucket made of copies shrinks as well; one that only a
       single text fills ends when no content is dropped and no bit is left.
    4. Buckets that fit pass through an open-addressing table that compares complete contents.
    """
    spark = docs.sparkSession
    hashed = stored(docs.select("_row", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), "text").mapInArrow(_hash_texts, _HASHED), "hashed")
    spill = hashed.filter(F.col("content").isNotNull()).select("_row", "h", "size", "content")
    total = spill.agg(F.sum("size")).first()[0] or 0
    bits = max(0, min(16, (2 * total // bucket_bytes).bit_length()))
    owners, gone, path = [], [], None
    while True:
        level = _with_bucket(spill, bits)
        sums = level.groupBy("bucket").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
        large = stored(sums.filter((F.col("_bytes") > bucket_bytes) & (F.col("_n") > 1)).select("bucket"), "large-buckets")
        ended = bits + LEVEL_BITS > 64 or large.isEmpty()
        fits = level if ended else level.join(large, "bucket", "left_anti")
        owners.append(stored(_by_bucket(fits).mapInArrow(_table_pass(False), "_row long, owner long"), "owners"))
        if ended:
            break
        bits += LEVEL_BITS
        deeper = _with_bucket(level.join(large, "bucket", "left_semi").drop("bucket"), bits)
        before, path = path, store(_by_bucket(deeper).mapInArrow(_table_pass(True), "_row long, owner long, h long, size long, content binary"), "spill")
        if before:
            forget(spark, before)
        written = spark.read.parquet(path)
        gone.append(stored(written.filter(F.col("content").isNull()).select("_row", "owner"), "met"))
        spill = written.filter(F.col("content").isNotNull()).select("_row", "h", "size", "content")
    final = owners[0]
    for more in owners[1:]:
        final = final.unionByName(more)
    # A row that met its copy on the way down has the owner of that copy; later levels are resolved first.
    for met in reversed(gone):
        via = met.select("_row", F.col("owner").alias("_via")).join(final.select(F.col("_row").alias("_via"), "owner"), "_via")
        final = stored(final.unionByName(via.select("_row", "owner")), "owners")
    rows = hashed.select("_row", "doc_id", "n", "sha", F.col("owner").alias("_first"))
    return rows.join(final.select(F.col("_row").alias("_first"), F.col("owner").alias("cls")), "_first").drop("_first")


def exact_groups(keyed: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document of `keyed` (`_row, doc_id, text`): `_row, doc_id, keep_id, keep_row, group_size, kept, text_sha256`.

    Of equal texts the row with the most code points stays, then the smallest doc_id (nulls last), then one row: of a row
    that stands in the table twice, one stays. Null counts as an empty text; empty texts are equal. An empty table gives none.
    """
    links = stored(content_classes(keyed, bucket_bytes), "classes")
    order = F.struct(-F.col("n"), F.col("doc_id").isNull(), "doc_id", "_row")
    best = links.groupBy("cls").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return links.join(best, "cls").select(
        "_row", "doc_id", F.col("_best.doc_id").alias("keep_id"), F.col("_best._row").alias("keep_row"), "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    keyed = row_keyed(packed(docs))
    kept = stored(exact_groups(keyed.select("_row", "doc_id", "text"), bucket_bytes).filter("kept").select("_row"), "kept")
    return keyed.join(kept, "_row", "left_semi").select("doc.*")
