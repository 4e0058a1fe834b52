"""Helpers shared by the operators: scratch tables, text batches, null rules.

Every operator selects the columns it needs by name before it adds any, so
extra or clashing columns of the input never reach its plan.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python task holds at once (a longer text comes alone).
CHUNK_BYTES = 6 << 20
#: Bytes of an Arrow batch, where the session leaves Spark's own limit as it is.
ARROW_BATCH = 8 << 20
#: Rows of a few numbers, and bytes of text, that one file of a scratch table takes at least.
FILE_ROWS, FILE_BYTES = 1_000_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session of one machine has none (tests), a local one is made; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = getattr(spark, "_factloom_scratch", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="factloom-")
            spark._factloom_scratch = base
    return base.rstrip("/")


def fine_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes: thousands of documents in one would fill the executor's and the worker's memory.

    Changes the session's setting, unless the session has set one.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(key, ARROW_BATCH)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def compact(df: DataFrame, rows: int = 0, size: int = 0) -> DataFrame:
    """As many partitions as about ``rows`` short rows or ``size`` bytes of text deserve, where the shuffle made more; Python still runs partition by partition."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS), -(-size // FILE_BYTES)))


def materialize(df: DataFrame, name: str, rows: int = 0, size: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors.

    Where ``rows`` or ``size`` is known, small tables get few files instead of one for each shuffle partition.
    """
    spark = df.sparkSession
    if rows or size:
        df = compact(df, rows, size)
    fine_batches(spark)
    path, schema = scratch(spark, name), df.schema
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        if t is not None and getattr(t, "scratch_path", None):
            jvm = t.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that leaves its worker small when the task ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: list[str] = ()) -> DataFrame:
    """``mapInArrow`` of rows that stay as they are but for their texts: columns go by place (c0, c1, ...), so that their names can be any; the columns ``more`` go in, but not out."""
    kept = [c for c in docs.columns if c not in more]
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    schema = plain.select(*plain.columns[: len(kept)]).schema
    return plain.mapInArrow(tidy(run), schema).toDF(*kept)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
