"""What the operators share: stored intermediate tables, row keys, text arrays."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.functions.lineage import scratch_path
from haulgrid.functions.scale import running_total

#: While a table is written: its shuffle files go as soon as the job has ended, and Python workers get batches of few rows.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings of `_WRITING` for the jobs inside."""
    before = {key: spark.conf.get(key) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def store(df: DataFrame, name: str) -> str:
    """Write `df` to the shared folder and return the place."""
    path = scratch_path(df.sparkSession, name)
    with writing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table: survives lost executors, is computed once."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


#: Up to this many narrow rows (a few MB) are joined and grouped in one task, which saves their shuffles; more are spread.
ONE_TASK = 200_000


def narrow(table: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """The stored `table`, as a single partition if it has at most `most` rows. A join of two such tables no longer counts as one, so
    what is grouped or joined after it is cut down by `coalesce(1)` again."""
    return table.coalesce(1) if table.count() <= most else table


def forget(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def row_keyed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add `_row`, a unique long that rises with `key` (nulls last).

    Where the key is unique it is the row number itself. Rows with a repeated or missing key are
    numbered by their rank, and the table is written so that the numbers stay.
    """
    odd = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(key).isNull())
    if odd.isEmpty():
        return docs.withColumn("_row", F.col(key).cast("long"))
    rest = [F.col(c) for c in docs.columns if c != key]
    ranked = running_total(docs, F.lit(1), [F.col(key).asc_nulls_last(), *rest], out="_row", before="_rank")
    return stored(ranked.drop("_rank").withColumn("_row", F.col("_row").cast("long")), "rows")


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct `doc`, next to `doc_id` and `text`: no name can clash with a working column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")


def text_arrays(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of texts of at most `most` bytes together; a longer text is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in fewer, larger batches: each ends when its texts in `column` reach `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
