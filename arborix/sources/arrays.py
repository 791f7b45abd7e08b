"""Chunked arrays as a Spark data source: ``spark.read.format("arborix_zarr")`` and ``df.write.format("arborix_zarr")``.

Reading: rows are the voxels that are not 0, with plain integer columns. A task
reads some chunks (``chunks_per_task``; by default about 32 MB of them).
Comparisons of z, y and x with numbers become a range of chunks, so that a box
opens only the chunks it touches; they and comparisons of values are then tested
in the tasks, and Spark does not test them again. Arrays of three axes have the
column ``value`` (its name is an option); those of four, channels first, have a
column for each channel, so a colour volume needs no shuffle. Formats: zarr 2,
zarr 3 without shards, and with ``format`` ``hdf``, where h5py is installed, HDF5.

Writing: each task writes whole chunks into a hidden folder beside the array, each
under its final name in one step, and reports how many. The commit compares what
lies there with what was reported, adds the metadata and renames the folder: the
array is there whole, or not at all. A task that is killed or run twice writes
the same chunks again; a job that fails removes the hidden folder.

Defined cases: a missing chunk is background; a fill value other than 0, filters
and shards are errors; an empty table writes an array without chunks; two rows
of one voxel are an error only if their chunk is split over tasks, else the last counts.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from .codecs import decompressed
from .files import folder_of

AXES = ("z", "y", "x")
#: Bytes of chunks, as they are in memory, that a task reads.
TASK_BYTES = 32 << 20
NUMPY = {"bool": "|b1", "int8": "|i1", "uint8": "|u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "int64": "<i8", "uint64": "<u8"}


def contents(fs: pafs.FileSystem, path: str) -> bytes | None:
    try:
        with fs.open_input_stream(path, compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return None


class Zarr:
    """An array's metadata, and its chunks by their place in the grid."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        fs, base = folder_of(folder)
        if (text := contents(fs, f"{base}/.zarray")) is not None:
            self._second(json.loads(text))
        elif (text := contents(fs, f"{base}/zarr.json")) is not None:
            self._third(json.loads(text))
        else:
            raise FileNotFoundError(f"no array at {folder}")

    def _second(self, meta: dict) -> None:
        if meta.get("filters"):
            raise ValueError("arrays with filters cannot be read")
        self.shape, self.chunks, self.dtype, self.order = meta["shape"], meta["chunks"], meta["dtype"], meta["order"]
        self.codecs = [c["id"] for c in [meta.get("compressor")] if c]
        separator = meta.get("dimension_separator", ".")
        self.name = lambda at: separator.join(map(str, at))
        self._check_fill(meta.get("fill_value"))

    def _third(self, meta: dict) -> None:
        if meta.get("node_type") != "array" or meta["data_type"] not in NUMPY:
            raise ValueError(f"not an array of whole numbers: {meta.get('node_type')}, {meta.get('data_type')}")
        self.shape, self.chunks = meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]
        self.dtype, self.order, self.codecs = NUMPY[meta["data_type"]], "C", []
        for codec in meta["codecs"]:
            name, options = codec["name"], codec.get("configuration", {})
            if name == "transpose":
                if list(options["order"]) != list(range(len(self.shape)))[::-1]:
                    raise ValueError("only whole transpositions of axes can be read")
                self.order = "F"
            elif name == "bytes":
                self.dtype = (">" if options.get("endian") == "big" else "<") + self.dtype[1:] if self.dtype[0] != "|" else self.dtype
            elif name in ("gzip", "zstd", "blosc", "crc32c"):
                self.codecs.append(name)
            else:
                raise ValueError(f"codec {name!r} cannot be read")
        encoding = meta.get("chunk_key_encoding", {"name": "default"})
        plain = encoding["name"] == "v2"
        separator = encoding.get("configuration", {}).get("separator", "." if plain else "/")
        self.name = lambda at: ("" if plain else f"c{separator}") + separator.join(map(str, at))
        self._check_fill(meta.get("fill_value"))

    @staticmethod
    def _check_fill(value: object) -> None:
        if value not in (None, 0, False):
            raise ValueError("a fill value other than 0 cannot be read")

    def open(self):
        fs, base = folder_of(self.folder)

        def chunk(at: tuple[int, ...]) -> np.ndarray | None:
            data = contents(fs, f"{base}/{self.name(at)}")
            if data is None:
                return None
            for codec in reversed(self.codecs):
                data = data[:-4] if codec == "crc32c" else decompressed(data, codec)
            block = np.frombuffer(data, self.dtype).reshape(self.chunks, order=self.order)
            inside = tuple(slice(0, min(c, s - i * c)) for i, c, s in zip(at, self.chunks, self.shape, strict=True))
            return block[inside]

        return chunk


class Hdf:
    """A dataset of an HDF5 file, by its chunks or by slabs of its next-to-last axes."""

    def __init__(self, file: str, key: str, slab: int = 1 << 22) -> None:
        self.file, self.key = file, key
        with self._file() as f:
            data = f[key]
            self.shape, self.dtype = list(data.shape), data.dtype.str
            rows = max(1, slab // max(1, math.prod(self.shape[-2:])))
            self.chunks = list(data.chunks or [*self.shape[:-3], min(rows, self.shape[-3]), *self.shape[-2:]])

    def _file(self):
        try:
            import h5py
        except ImportError as e:
            raise RuntimeError("HDF5 needs h5py; convert the files to zarr or Parquet") from e
        fs, name = folder_of(self.file)
        return h5py.File(fs.open_input_file(name), "r")

    def open(self):
        f = self._file()
        data = f[self.key]
        return lambda at: np.asarray(data[tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(at, self.chunks, self.shape, strict=True))])


def opened(options: dict[str, str]) -> Zarr | Hdf:
    if options.get("format", "zarr") == "hdf":
        return Hdf(options["path"], options["key"])
    return Zarr(f"{options['path']}/{options['key']}" if options.get("key") else options["path"])


def value_names(options: dict[str, str], shape: list[int]) -> list[str]:
    if len(shape) == 3:
        return [options.get("value", "value")]
    if len(shape) != 4:
        raise ValueError("arrays have three axes, or four with channels first")
    names = options["channels"].split(",") if options.get("channels") else ["r", "g", "b"] if shape[0] == 3 else [f"c{k}" for k in range(shape[0])]
    if len(names) != shape[0]:
        raise ValueError(f"{shape[0]} channels have {len(names)} names")
    return names


@dataclass
class Chunks(InputPartition):
    """Places ``first`` to ``end`` of the grid of chunks that a box touches."""

    first: int
    end: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.array, self.options = opened(options), options
        self.names = value_names(options, self.array.shape)
        self.low, self.high = [0, 0, 0], [s - 1 for s in self.array.shape[-3:]]  # of voxels, both included
        self.tests: list[tuple[str, str, object]] = []

    def _narrow(self, column: str, low: float, high: float) -> None:
        if column in AXES:
            k = AXES.index(column)
            self.low[k], self.high[k] = max(self.low[k], math.ceil(low)), min(self.high[k], math.floor(high))

    def grid(self) -> tuple[list[int], list[int]]:
        """The first chunk of each axis that the box touches, and how many."""
        size = self.array.chunks[-3:]
        first = [a // c for a, c in zip(self.low, size, strict=True)]
        return first, [max(0, b // c - f + 1) for b, c, f in zip(self.high, size, first, strict=True)]

    def partitions(self) -> list[Chunks]:
        _, counts = self.grid()
        total = math.prod(counts)
        each = math.prod(self.array.chunks[-3:]) * np.dtype(self.array.dtype).itemsize * len(self.names)
        group = int(self.options.get("chunks_per_task") or max(1, TASK_BYTES // each))
        return [Chunks(a, min(a + group, total)) for a in range(0, total, group)] or [Chunks(0, 0)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        first, counts = self.grid()
        size, chunk = self.array.chunks[-3:], self.array.open()
        channels = [()] if len(self.array.shape) == 3 else [(k,) for k in range(-(-self.array.shape[0] // self.array.chunks[0]))]
        for number in range(partition.first, partition.end):
            at = tuple(f + int(i) for f, i in zip(first, np.unravel_index(number, counts), strict=True))
            parts = [chunk((*c, *at)) for c in channels]
            if all(p is None for p in parts):
                continue
            if len(self.array.shape) == 3:
                block = parts[0][None]
            else:
                there = next(p for p in parts if p is not None).shape[1:]
                sizes = [min(self.array.chunks[0], self.array.shape[0] - c[0] * self.array.chunks[0]) for c in channels]
                block = np.concatenate([np.zeros((n, *there), self.array.dtype) if p is None else p for p, n in zip(parts, sizes, strict=True)])
            places = np.nonzero(block.any(axis=0))
            columns = {a: p.astype(np.int32) + np.int32(i * n) for a, p, i, n in zip(AXES, places, at, size, strict=True)}
            columns |= {name: block[k][places].astype(np.int64) for k, name in enumerate(self.names)}
            kept = np.ones(len(places[0]), bool)
            for column, test, value in self.tests:
                v = columns[column]
                kept &= np.isin(v, value) if test == "in" else {"=": v.__eq__, ">": v.__gt__, ">=": v.__ge__, "<": v.__lt__, "<=": v.__le__}[test](value)
            if kept.any():
                yield pa.record_batch({c: pa.array(v[kept]) for c, v in columns.items()})


class PushingReader(ArrayReader):
    """The same where the session lets filters through to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if column not in (*AXES, *self.names):
                yield f
            elif isinstance(f, IsNotNull):
                continue  # no column has nulls
            elif isinstance(f, In) and value and all(isinstance(v, int) for v in value):
                self.tests.append((column, "in", np.array(sorted(value))))
                self._narrow(column, min(value), max(value))
            elif (test := known.get(type(f))) and isinstance(value, int):
                self.tests.append((column, test, value))
                low = {"=": value, ">": value + 1, ">=": value}.get(test, -math.inf)
                high = {"=": value, "<": value - 1, "<=": value}.get(test, math.inf)
                self._narrow(column, *(b if math.isfinite(b) else d for b, d in ((low, 0), (high, 1 << 62))))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    chunks: int


class ZarrWriter(DataSourceArrowWriter):
    """Whole chunks from rows that stand together by chunk."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder = f"{options['path']}/{options['key']}" if options.get("key") else options["path"]
        self.axes, self.value = options["axes"].split(","), options["value"]
        self.shape, self.chunks = ([int(n) for n in options[k].split(",")] for k in ("shape", "chunks"))
        self.dtype, self.overwrite = options.get("dtype", "<u8"), overwrite
        parent, _, name = self.folder.rstrip("/").rpartition("/")
        self.stage = f"{parent}/.{name}-{uuid.uuid4().hex}"
        fs, base = folder_of(self.stage)
        fs.create_dir(f"{base}/array", recursive=True)
        fs.create_dir(f"{base}/drafts", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = folder_of(self.stage)
        grid = [-(-s // c) for s, c in zip(self.shape, self.chunks, strict=True)]
        done: set[int] = set()
        held, block = -1, np.zeros(self.chunks, self.dtype)

        def finish() -> None:
            if held < 0:
                return
            packed = zlib.compressobj(5, zlib.DEFLATED, 31)
            draft = f"{base}/drafts/{uuid.uuid4().hex}"
            with fs.open_output_stream(draft, compression=None) as f:
                f.write(packed.compress(block.tobytes()) + packed.flush())
            fs.move(draft, f"{base}/array/{'.'.join(str(int(i)) for i in np.unravel_index(held, grid))}")
            done.add(held)

        for batch in iterator:
            at = [batch.column(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in self.axes]
            if any(len(a) and (a.min() < 0 or a.max() >= s) for a, s in zip(at, self.shape, strict=True)):
                raise ValueError(f"voxels outside of {self.shape}")
            values = batch.column(self.value).to_numpy(zero_copy_only=False)
            number = np.ravel_multi_index([a // c for a, c in zip(at, self.chunks, strict=True)], grid)
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in itertools.pairwise(edges):
                if a == b:
                    continue
                if number[a] != held:
                    finish()
                    held = int(number[a])
                    if held in done:
                        raise ValueError("rows must stand together by chunk")
                    block[...] = 0
                block[tuple(p[a:b] % c for p, c in zip(at, self.chunks, strict=True))] = values[a:b]
        finish()
        return Written(len(done))

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = folder_of(self.stage)
        lies, told = len(fs.get_file_info(pafs.FileSelector(f"{base}/array"))), sum(m.chunks for m in messages if m)
        if lies != told:
            self.abort(messages)
            raise RuntimeError(f"tasks wrote {told} chunks, of which {lies} are there: a chunk's rows were split over tasks")
        meta = {"zarr_format": 2, "shape": self.shape, "chunks": self.chunks, "dtype": self.dtype, "compressor": {"id": "gzip", "level": 5}, "fill_value": 0, "order": "C", "filters": None}
        with fs.open_output_stream(f"{base}/array/.zarray", compression=None) as f:
            f.write(json.dumps(meta).encode())
        _, final = folder_of(self.folder)
        if fs.get_file_info(final).type != pafs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.folder)
            fs.move(final, f"{base}/before")
        fs.move(f"{base}/array", final)
        fs.delete_dir(base)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = folder_of(self.stage)
        if fs.get_file_info(base).type != pafs.FileType.NotFound:
            fs.delete_dir(base)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arborix_zarr"

    def schema(self) -> str:
        names = value_names(self.options, opened(self.options).shape)
        return ", ".join([*(f"{a} int" for a in AXES), *(f"`{n}` long" for n in names)])

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else ArrayReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ZarrWriter:
        return ZarrWriter(dict(self.options), overwrite)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession, pushdown: bool = True) -> None:
    """Makes the source known to a session, and by default lets filters through to sources in Python. Readers that should
    prune chunks have the option ``pushdown`` true."""
    if pushdown:
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ArraySource)


def reading(spark: SparkSession, path: str, key: str, **options: str):
    """A reader of an array, with chunks pruned where the session lets filters through."""
    register(spark)
    return spark.read.format("arborix_zarr").options(path=path, key=key, pushdown=spark.conf.get(PUSHDOWN, "false"), **options).load()
