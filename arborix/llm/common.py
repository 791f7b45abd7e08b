"""Shared plumbing of the training-data operators: the shared folder, scratch tables, Arrow batches.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor sees, so a lost executor costs a recomputation and never a table.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch: long texts stay within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 400, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a temporary one serves a session of one machine (local tests);
    a cluster must name its own."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="arborix-")
    spark.sparkContext.setCheckpointDir(base)
    delete_on_exit(spark, base)
    return base


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder on whatever file system it lives."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver's JVM ends, whether the session was stopped before or not."""
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)


#: How scratch tables are written.
WRITING = {"compression": "zstd"}


class Scratch:
    """Tables of one operator run, each written once and read back. What is not dropped or closed before goes when the driver ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        delete_on_exit(spark, self.path)

    def save(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        where, schema = f"{self.path}/{name}", df.schema
        df.write.options(**WRITING).partitionBy(*by).parquet(where)
        return self.spark.read.schema(schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")

    def keep(self, df: DataFrame) -> DataFrame:
        """Materialises a result, removes everything that led to it, and keeps it until the driver ends."""
        where, schema = f"{self.path}-kept", df.schema
        delete_on_exit(self.spark, where)
        df.write.mode("append").options(**WRITING).parquet(where)
        self.close()
        return self.spark.read.schema(schema).parquet(where)

    def close(self) -> None:
        delete(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


def partitions(df: DataFrame, each: int = 128 << 20) -> int:
    """How many tasks to deal a table's rows to: as the session says, and more where its files would give a task over ``each`` bytes."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 60)  # tables of unknown size claim to be larger than anything
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // each))


def free_shuffles(spark: SparkSession) -> None:
    """Asks Spark's cleaner to remove shuffle files that no live plan needs any more."""
    spark._jvm.System.gc()


#: What a Python worker holds between the tasks of an operator, by operator: functions that let go of it.
HELD: dict[str, list[Callable[[], None]]] = {}
_worker = {"operator": None}


def held(operator: str, release: Callable[[], None]) -> None:
    """Registers what to call in a worker when it goes on to another operator."""
    HELD.setdefault(operator, []).append(release)


def begin(operator: str) -> None:
    """Called where an operator's work begins in a worker. Workers are reused, so what other operators held there goes,
    and memory that was freed is given back to the system, where the C library can."""
    if _worker["operator"] == operator:
        return
    try:
        if _worker["operator"] is None:
            pa.set_memory_pool(pa.system_memory_pool())
            library = ctypes.CDLL(None)
            library.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: larger blocks go back to the system when they are freed
            library.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
        for other, releases in HELD.items():
            if other != operator:
                for release in releases:
                    release()
        _worker["operator"] = operator
        gc.collect()
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        _worker["operator"] = operator


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches that a worker can hold, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def arrow_udf(operator: str, function: Callable[..., pa.Array], schema: str) -> Callable[..., Column]:
    """An Arrow function of columns as a column function."""
    arity = function.__code__.co_argcount - len(function.__defaults__ or ())

    def one(a: pa.Array) -> pa.Array:
        begin(operator)
        return function(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        begin(operator)
        return function(a, b)

    limit_batches(SparkSession.getActiveSession())
    return F.arrow_udf({1: one, 2: two}[arity], schema)


def arrow_stream(operator: str, df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        yield from function(batches)

    limit_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_map(operator: str, df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return arrow_stream(operator, df, run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts' bytes; null stays null."""
    return column.cast(pa.binary()).to_pylist()


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on documents that may have columns named like its inner ones, which all begin with two underscores."""

    @wraps(operator)
    def run(documents: DataFrame, *tables: DataFrame, **options) -> DataFrame:
        hidden = {c: f"hidden{k}-{uuid.uuid4().hex}" for k, c in enumerate(documents.columns) if c.startswith("__") and c not in options.values()}
        if not hidden:
            return operator(documents, *tables, **options)
        return operator(documents.withColumnsRenamed(hidden), *tables, **options).withColumnsRenamed({v: k for k, v in hidden.items()})

    return run


def columns(df: DataFrame, but: tuple[str, ...] | list[str] = ()) -> list[Column]:
    """A table's columns by their exact names, except those named: what an operator adds under a name replaces what was there."""
    without = {c.lower() for c in but}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in without]


def crc32_mod3(doc_id: str = "doc_id") -> Column:
    """The fold of a document; those without id are in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
