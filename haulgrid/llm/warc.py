"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, headers and digests
computed anew, commit through temporary names and a manifest."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulgrid.functions.lineage import scratch_path
from haulgrid.functions.scale import running_total
from haulgrid.llm.common import store, stored

#: A shard holds consecutive pages of about this many payload bytes; one task writes it.
SHARD_BYTES = 32 << 20
#: A file is closed once it has this many compressed bytes.
FILE_BYTES = 32 << 20
#: Equal payloads from this size on are written once.
REVISIT_BYTES = 1000
#: Archives of equal input are equal byte for byte, so the date is a parameter.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4

_WROTE = "shard long, file long, temporary string, final string, bytes long, records long, first_page long, last_page long, sha256 string"


def record_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Narrow rows `page_id, url, bytes, digest, refers_to` of `pages`; the payload is the html in UTF-8, null is empty.

    Of equal payloads of `least` bytes or more the largest page_id is the response (`refers_to` null), others revisit it.
    Smaller payloads, and pages without an id, are responses. Rows that repeat the response's page_id are responses too.
    The digest of a payload is taken as the payload (SHA-1 and length). Copies are grouped before they are joined.
    """
    body = F.coalesce("html", F.lit(""))
    rows = stored(pages.select("page_id", "url", F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("digest")), "payloads")
    groups = rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(groups.filter(F.col("_n") > 1).drop("_n"), ["digest", "bytes"], "left")
    return joined.select("page_id", "url", "bytes", "digest", F.when(F.col("page_id") != F.col("response"), F.col("response")).alias("refers_to"))


def _base32(digest: str) -> str:
    import base64

    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or "urn:none" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
             f"WARC-Payload-Digest: {_base32(digest)}", f"WARC-Block-Digest: {_base32(hashlib.sha1(block).hexdigest())}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """One archive under a temporary name, one gzip member for each record."""

    def __init__(self, folder: str, shard: int, number: int):
        self.files, root = fs.FileSystem.from_uri(folder)
        name = f"part-{shard:08d}-{number:05d}.warc.gz"
        self.shard, self.number = shard, number
        self.temporary, self.final = f"{root}/.tmp/{uuid.uuid4().hex}-{name}", f"{root}/{name}"
        self.files.create_dir(f"{root}/.tmp", recursive=True)
        self.out, self.sha = self.files.open_output_stream(self.temporary, compression=None), hashlib.sha256()
        self.bytes = self.records = 0
        self.first = self.last = None

    def write(self, page_id: int | None, record: bytes) -> None:
        member = gzip.compress(record, LEVEL, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1
        self.first = page_id if self.first is None else self.first
        self.last = page_id

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.number, self.temporary, self.final, self.bytes, self.records, self.first, self.last, self.sha.hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in _WROTE.split(", ")]
    by = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(by, kinds)], names)


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write one record per row of `pages` (`page_id, url, html`) under `folder` and return the manifest, a stored table.

    Shards are cut by the running total of payload bytes in the order of page_id, address and digest, so they are the same in every run,
    whatever the partitions, and no id, missing or repeated, makes one of its own size. Each shard is sorted and written by one task, which opens a new file whenever the present one
    has `file_bytes`. Tasks write temporary names only; the manifest names the files of the attempts that counted, these
    get their final names, and what lost attempts left under temporary names goes. `folder` must be one that all executors reach
    (any file system that Arrow opens by its address). An empty table gives no file.
    """
    spark = pages.sparkSession
    types = stored(record_types(pages), "record-types")
    order = [F.col("page_id").asc_nulls_last(), F.col("url"), F.col("digest")]
    placed = running_total(types, F.col("bytes") + 500, order, out="_end", before="_start")
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url"), "digest")
    starts = placed.groupBy(F.floor(F.col("_start") / shard_bytes).alias("k")).agg(F.min(place).alias("first"))
    # One place for every `shard_bytes` of the pages. Pages of one id, or of none, are cut by address and digest as well.
    firsts = sorted({(r["first"]["none"], r["first"]["page_id"] or 0, r["first"]["url"], r["first"]["digest"]) for r in starts.collect()})
    sent = spark.sparkContext.broadcast(firsts)

    @F.arrow_udf(T.LongType())
    def shard_of(page_ids: pa.Array, urls: pa.Array, digests: pa.Array) -> pa.Array:
        firsts = sent.value
        numbers = np.array([f[1] for f in firsts if not f[0]], np.int64)
        ids, absent = pc.fill_null(page_ids, 0).to_numpy(zero_copy_only=False), page_ids.is_null().to_numpy(zero_copy_only=False)
        shards = np.searchsorted(numbers, ids, "right") - 1
        # Only where a shard begins within an id do the other columns matter.
        for k in np.flatnonzero(absent | np.isin(ids, numbers)):
            shards[k] = bisect.bisect_right(firsts, (bool(absent[k]), int(ids[k]), urls[k].as_py() or "", digests[k].as_py())) - 1
        return pa.array(np.maximum(shards, 0).astype(np.int64))

    # What a record refers to travels in a narrow row that sorts before the pages it belongs to: pages are shuffled once.
    body = F.coalesce("html", F.lit(""))
    digest = F.sha1(body.cast("binary")).alias("digest")
    nothing, key = F.lit(None), ["page_id", "url", "digest"]
    notes = types.filter(F.col("refers_to").isNotNull()).select(*key, "refers_to", nothing.cast("string").alias("html")).distinct()
    rows = notes.unionByName(pages.select("page_id", "url", digest, nothing.cast("long").alias("refers_to"), body.alias("html")))
    rows = rows.withColumn("shard", shard_of("page_id", "url", "digest")).repartition("shard")
    rows = rows.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "url", "digest", F.col("html").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done, noted, target = None, [], None, None
        for batch in batches:
            for shard, page_id, url, digest, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "digest", "html", "refers_to"))):
                if html is None:
                    noted, target = (page_id, url, digest), refers_to
                    continue
                if file and (file.shard != shard or file.bytes >= file_bytes):
                    done.append(file.close())
                    file = _File(folder, shard, file.number + 1 if file.shard == shard else 0)
                file = file or _File(folder, shard, 0)
                file.write(page_id, record_bytes(page_id, url, html.encode(), target if noted == (page_id, url, digest) else None, date))
        if file:
            done.append(file.close())
        yield _batch(done)

    wrote = stored(rows.mapInArrow(run, _WROTE), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temporary, final, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "final", "bytes"))):
                there = files.get_file_info(final)
                if there.type == fs.FileType.NotFound or there.size != size:
                    files.move(temporary, final)
            yield batch

    manifest = spark.read.parquet(store(wrote.mapInArrow(commit, _WROTE), "committed"))
    files, root = fs.FileSystem.from_uri(folder)
    if files.get_file_info(f"{root}/.tmp").type != fs.FileType.NotFound:
        files.delete_dir(f"{root}/.tmp")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    return manifest


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().strip().lower(): v.decode().strip() for k, _, v in (x.partition(b":") for x in lines) if v}


def records_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after the other; no more than one record in memory."""
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            parts.append(member.decompress(rest))
            rest = member.unused_data
            if not member.eof:
                rest = stream.read(chunk)
                if not rest:
                    raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the files in `manifest`: `page_id, url, record_type, refers_to, payload_bytes, payload_digest, html`
    (`html` null for revisits). Digests of blocks and payloads are checked, `payload_bytes` of a response is measured on what was
    read. There are as many tasks as files, dealt by the names' order, so hardly one gets two."""
    spec = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        for batch in batches:
            for name, folder in zip(batch.column("final").to_pylist(), batch.column("address").to_pylist()):
                files, _ = fs.FileSystem.from_uri(folder)
                rows: list[tuple] = []
                with files.open_input_stream(name, compression=None) as stream:
                    for record in records_of(stream):
                        head, _, rest = record.partition(b"\r\n\r\n")
                        h = _headers(head.split(b"\r\n")[1:])
                        block = rest[: int(h["content-length"])]
                        if _base32(hashlib.sha1(block).hexdigest()) != h["warc-block-digest"]:
                            raise ValueError(f"block digest of {h['warc-record-id']}")
                        payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                        digest = base64.b32decode(h["warc-payload-digest"][5:]).hex()
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload digest of {h['warc-record-id']}")
                        number = lambda k: int(h[k]) if k in h else None
                        rows.append((number("x-page-id"), h["warc-target-uri"], h["warc-type"], number("x-refers-to-page-id"), int(h["x-payload-length"]) if payload is None else len(payload), digest, payload.decode() if payload is not None else None))
                        if len(rows) >= 500:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        by = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(by, kinds)], [f.split()[0] for f in spec.split(", ")])

    files = max(1, manifest.count())
    return manifest.select("final", "address").repartitionByRange(files, "final").mapInArrow(run, spec)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write `pages` and read them back: the rows of `read_archives`."""
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    if "://" not in folder:  # a plain path, or Hadoop's form with one slash
        folder = "file://" + folder.removeprefix("file:")
    return read_archives(write_archives(pages, folder, **options).withColumn("address", F.lit(folder)))
