"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settle, shared_dir


#: Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.
saved = settle


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "4m") -> SparkSession:
    """Let Arrow batches to and from Python hold few rows and bytes, as texts may be long; returns the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


@contextlib.contextmanager
def few_rows(spark: SparkSession, rows: int, size: str = "16m") -> Iterator[None]:
    """Arrow batches of few rows within the block, for tables whose rows are large; the session's settings come back afterwards."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bucketed(df: DataFrame, buckets: int, key: str) -> tuple[str, DataFrame]:
    """Write a table in buckets of a key to the shared folder: tables with the same buckets join without a shuffle. Its name, for :func:`dropped`."""
    spark, name = df.sparkSession, f"rollcall_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name, spark.table(name)


def dropped(spark: SparkSession, name: str) -> None:
    """Delete a table of :func:`bucketed` and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def finite(v: Column) -> Column:
    """Whether an array has components, none of them null or no finite number."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def whole(v: Column, scale: int, most: int) -> Column:
    """``floor(scale * component)`` of each; an error beyond ``most``, as results of such vectors needn't fit a long."""
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))
    too_large = F.exists(v, lambda c: F.abs(c) * F.lit(float(scale)) >= F.lit(float(most)))
    return F.when(too_large, F.raise_error(F.lit(f"a component times {scale} is beyond {most}"))).otherwise(x)


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(k))


def give_back() -> None:
    """Return freed memory to the system, as workers stay while other stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the C library of Linux
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches so that the strings of ``column`` hold about ``max_bytes``; nulls become ''."""
    for batch in batches:
        col = pc.fill_null(batch.column(column), "")
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))])
        i, n = 0, len(col)
        while i < n:
            j = int(np.searchsorted(sizes, sizes[i] + max_bytes, side="right")) - 1
            j = min(max(j, i + 1), n)
            yield batch.slice(i, j - i), col.slice(i, j - i)
            i = j
        del batch, col
        give_back()


def utf8_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its values in them."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every (start, count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
