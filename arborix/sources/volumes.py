"""Volumes as voxel tables, read from and written to chunked arrays (``arrays``); background (0) has no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import reading, register
from .codecs import decompressed  # noqa: F401  part of this module's names
from .files import folder_of, remove


def load_labels(spark: SparkSession, path: str, key: str = "volumes") -> DataFrame:
    """(z, y, x, label) of the voxels that belong to a fragment; a box of them reads the chunks it touches."""
    return reading(spark, path, key, value="label")


def load_raw(spark: SparkSession, path: str, key: str = "volumes/raw") -> DataFrame:
    """(z, y, x, r, g, b) of the voxels that are not black."""
    return reading(spark, path, key, channels="r,g,b")


def write_zarr(voxels: DataFrame, path: str, key: str, axes: list[str], value: str, shape: list[int], chunks: list[int], dtype: str = "<u8", overwrite: bool = False) -> bool:
    """Writes values other than 0 as a gzip-compressed array, whole or not at all; leaves an array that is there alone and returns False.

    The rows of a chunk meet in one task: as many as a chunk has voxels at most.
    """
    fs, base = folder_of(f"{path}/{key}")
    if not overwrite and fs.get_file_info(f"{base}/.zarray").type != pafs.FileType.NotFound:
        return False
    register(voxels.sparkSession)
    place = [F.floor(F.col(a) / F.lit(n)) for a, n in zip(axes, chunks, strict=True)]
    rows = voxels.filter(F.col(value) != 0).select(*[F.col(a).cast("int").alias(a) for a in axes], F.col(value).cast("long").alias(value))
    by_chunk = rows.repartition(*place).sortWithinPartitions(*place)
    options = {"path": path, "key": key, "axes": ",".join(axes), "value": value, "shape": ",".join(map(str, shape)), "chunks": ",".join(map(str, chunks)), "dtype": dtype}
    by_chunk.write.format("arborix_zarr").mode("overwrite" if overwrite else "append").options(**options).save()
    return True


def read_hdf(spark: SparkSession, path: str, key: str, slab: int = 1 << 22, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """(file, z, y, x, value), or with c before z, of the values other than 0 of a dataset of each HDF5 file of a folder: a file is
    one task's work, read by slabs of its first axis. One large file goes by chunks instead: ``arborix_zarr`` with the option
    ``format`` ``hdf``. Needs h5py on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches):
        try:
            import h5py
        except ImportError as e:
            raise RuntimeError("HDF5 needs h5py; convert the files to zarr or Parquet") from e
        for batch in batches:
            for where in batch.column(0).to_pylist():
                fs, name = folder_of(where)
                with fs.open_input_file(name) as source, h5py.File(source, "r") as f:
                    data = f[key]
                    step = max(1, slab // max(1, int(np.prod(data.shape[1:]))))
                    for a in range(0, data.shape[0], step):
                        block = np.asarray(data[a : a + step])
                        at = np.argwhere(block)
                        values = block[tuple(at.T)].astype(np.int64)
                        at[:, 0] += a
                        yield pa.record_batch({"file": pa.array([where.rsplit("/", 1)[-1]] * len(at), pa.string()), **{a: at[:, k].astype(np.int32) for k, a in enumerate(axes)}, "value": values})

    return files.repartition(max(1, files.count())).mapInArrow(run, f"file string, {', '.join(f'{a} int' for a in axes)}, value long")


def cached(table: DataFrame, path: str) -> DataFrame:
    """A table read from its folder, which is written first if it is not there."""
    spark = table.sparkSession
    try:
        return spark.read.schema(table.schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    try:
        table.write.parquet(path)
    except Exception:
        remove(spark, path)  # half a table must not be found by the next run
        raise
    return spark.read.schema(table.schema).parquet(path)
