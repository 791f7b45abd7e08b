"""Chunked arrays as a data source: what is read under a filter, and writes that are whole or not there."""

import json
import os
import subprocess
import sys
import types
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.sources import arrays, volumes

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture
def labels(spark, tmp_path):
    """A volume of 20 x 30 x 40 in chunks of 8 x 8 x 16, in two thirds of its voxels."""
    data = np.random.default_rng(4).integers(0, 3, (20, 30, 40)).astype(np.int64) * np.arange(1, 41)
    rows = [(*map(int, at), int(data[tuple(at)])) for at in np.argwhere(data)]
    voxels = spark.createDataFrame(rows, "z int, y int, x int, label long")
    assert volumes.write_zarr(voxels, f"file://{tmp_path}/v", "volumes", ["z", "y", "x"], "label", list(data.shape), [8, 8, 16])
    return data, tmp_path / "v", voxels


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def expected(data, keep=lambda z, y, x, v: True):
    return sorted((*map(int, at), int(data[tuple(at)])) for at in np.argwhere(data) if keep(*at, data[tuple(at)]))


def test_round_trip(spark, labels):
    data, path, _ = labels
    found = volumes.load_labels(spark, f"file://{path}")
    assert found.dtypes == [("z", "int"), ("y", "int"), ("x", "int"), ("label", "bigint")]
    assert rows_of(found) == expected(data)
    assert sorted(p.name for p in path.iterdir()) == ["volumes"]  # nothing hidden is left


@pytest.mark.parametrize(
    ("condition", "keep"),
    [
        ("z >= 3 AND z < 7 AND y > 9 AND y <= 14 AND x BETWEEN 17 AND 30", lambda z, y, x, v: 3 <= z < 7 and 9 < y <= 14 and 17 <= x <= 30),
        ("z = 2 AND x IN (16, 20, 31) AND y = 8", lambda z, y, x, v: z == 2 and x in (16, 20, 31) and y == 8),
        ("z < 8 AND y < 16 AND y >= 8 AND x >= 16 AND x < 32 AND label > 20 AND label % 2 = 0", lambda z, y, x, v: z < 8 and 8 <= y < 16 and 16 <= x < 32 and v > 20 and v % 2 == 0),
    ],
)
def test_a_box_opens_only_its_chunks(spark, labels, condition, keep):
    data, path, _ = labels
    want = expected(data, keep)
    kept = {f"{z // 8}.{y // 8}.{x // 16}" for z, y, x in np.ndindex(data.shape) if keep(z, y, x, 22)}
    assert 0 < len(kept) < 5
    for chunk in (path / "volumes").iterdir():
        if chunk.name not in kept and chunk.name != ".zarray":
            chunk.write_bytes(b"cannot be read")
    found = volumes.load_labels(spark, f"file://{path}").filter(condition)
    assert rows_of(found) == want
    with pytest.raises(Exception, match="incorrect header|Error"):
        volumes.load_labels(spark, f"file://{path}").count()


def test_filters_that_hold_for_nothing(spark, labels):
    _, path, _ = labels
    found = volumes.load_labels(spark, f"file://{path}")
    for condition in ("z > 100", "z < 0", "x > 5 AND x < 4", "y IS NULL", "label = -1"):
        assert found.filter(condition).count() == 0
    assert found.filter("z > 2.5 AND z < 3.5").count() == found.filter("z = 3").count()


def test_filters_where_the_session_holds_them_back(spark, labels):
    data, path, _ = labels
    held = spark.conf.get(arrays.PUSHDOWN)
    arrays.register(spark)
    try:
        spark.conf.set(arrays.PUSHDOWN, "false")
        found = spark.read.format("arborix_zarr").options(path=f"file://{path}", key="volumes", value="label").load()
        assert rows_of(found.filter("z = 3 AND label > 30")) == expected(data, lambda z, y, x, v: z == 3 and v > 30)
    finally:
        spark.conf.set(arrays.PUSHDOWN, held)


def test_tasks_take_some_chunks(labels):
    _, path, _ = labels
    reader = arrays.ArrayReader({"path": f"file://{path}", "key": "volumes", "chunks_per_task": "5"})
    assert [p.end - p.first for p in reader.partitions()] == [5] * 7 + [1]  # 3 x 4 x 3 chunks
    assert len(arrays.ArrayReader({"path": f"file://{path}", "key": "volumes"}).partitions()) == 1


def test_colours_need_no_shuffle(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, (3, 6, 7, 9)) * rng.integers(0, 2, (1, 6, 7, 9))
    rows = [(*map(int, at), int(data[tuple(at)])) for at in np.argwhere(data)]
    voxels = spark.createDataFrame(rows, "c int, z int, y int, x int, v long")
    for chunks in ([1, 4, 4, 4], [3, 4, 4, 4], [2, 6, 7, 9]):
        assert volumes.write_zarr(voxels, f"file://{tmp_path}/{chunks[0]}", "volumes/raw", ["c", "z", "y", "x"], "v", [3, 6, 7, 9], chunks, "|u1")
        raw = volumes.load_raw(spark, f"file://{tmp_path}/{chunks[0]}")
        assert "Exchange" not in raw._jdf.queryExecution().executedPlan().toString()
        assert rows_of(raw) == sorted((*map(int, at), *map(int, data[(slice(None), *at)])) for at in np.argwhere(data.any(axis=0)))


def third(folder, data, chunks, codecs, encoding, pack):
    """An array in the third version of the format, by hand."""
    folder.mkdir(parents=True)
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(data.shape), "data_type": str(data.dtype), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": encoding, "codecs": codecs, "fill_value": 0}
    (folder / "zarr.json").write_text(json.dumps(meta))
    for at in np.ndindex(*(-(-s // c) for s, c in zip(data.shape, chunks, strict=True))):
        block = np.zeros(chunks, data.dtype)
        part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        if block.any():
            sep = encoding.get("configuration", {}).get("separator", "/" if encoding["name"] == "default" else ".")
            name = ("" if encoding["name"] == "v2" else f"c{sep}") + sep.join(map(str, at))
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_bytes(pack(block))


def test_third_version(spark, tmp_path):
    import gzip

    zstandard = pytest.importorskip("zstandard")
    data = np.random.default_rng(3).integers(0, 4, (5, 6, 7)).astype(np.uint16)
    zstd = lambda b: zstandard.ZstdCompressor().compress(b)
    forms = {
        "plain": ([{"name": "bytes", "configuration": {"endian": "little"}}], {"name": "default", "configuration": {"separator": "/"}}, lambda b: b.tobytes()),
        "gzip": ([{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 5}}], {"name": "v2"}, lambda b: gzip.compress(b.astype(">u2").tobytes())),
        "zstd": ([{"name": "transpose", "configuration": {"order": [2, 1, 0]}}, {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}, {"name": "crc32c"}], {"name": "default", "configuration": {"separator": "."}}, lambda b: zstd(b.tobytes(order="F")) + b"\0\0\0\0"),
    }
    for name, (codecs, encoding, pack) in forms.items():
        third(tmp_path / name, data, [2, 3, 4], codecs, encoding, pack)
        assert rows_of(arrays.reading(spark, f"file://{tmp_path}/{name}", "")) == expected(data)
    third(tmp_path / "shards", data, [2, 3, 4], [{"name": "sharding_indexed"}], {"name": "default"}, lambda b: b.tobytes())
    with pytest.raises(Exception, match="sharding_indexed"):
        arrays.reading(spark, f"file://{tmp_path}/shards", "").count()
    with pytest.raises(Exception, match="no array at"):
        arrays.reading(spark, f"file://{tmp_path}/nothing", "").count()


def test_hdf_by_chunks(monkeypatch, tmp_path):
    """With a stand-in for the library: what is asked of it is slices of a dataset."""
    data = np.random.default_rng(3).integers(0, 3, (5, 6, 7))
    np.save(tmp_path / "x.npy", data)
    asked = []

    class Dataset:
        shape, dtype, chunks = data.shape, data.dtype, (2, 3, 7)

        def __init__(self, held):
            self.held = held

        def __getitem__(self, at):
            asked.append(at)
            return self.held[at]

    class File(dict):
        def __init__(self, source, mode):
            super().__init__({"volumes/raw": Dataset(np.load(source))})

        __enter__, __exit__ = (lambda self: self), (lambda self, *e: None)

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File))
    options = {"format": "hdf", "path": f"file://{tmp_path}/x.npy", "key": "volumes/raw", "chunks_per_task": "2"}
    reader = arrays.PushingReader(options)
    assert len(reader.partitions()) == 3
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["z"], r["y"], r["x"], r["value"]) for r in got) == expected(data)
    asked.clear()
    box = arrays.PushingReader(options)
    from pyspark.sql.datasource import EqualTo

    assert list(box.pushFilters([EqualTo(("z",), 4), EqualTo(("y",), 1)])) == []
    got = [r for p in box.partitions() for b in box.read(p) for r in b.to_pylist()]
    assert len(asked) == 1 and sorted((r["z"], r["y"], r["x"], r["value"]) for r in got) == expected(data, lambda z, y, x, v: z == 4 and y == 1)


# ---- writes


def test_written_once_or_over(spark, labels):
    data, path, voxels = labels
    write = lambda df, **o: volumes.write_zarr(df, f"file://{path}", "volumes", ["z", "y", "x"], "label", list(data.shape), [8, 8, 16], **o)
    assert not write(voxels.filter("z = 1")) and volumes.load_labels(spark, f"file://{path}").count() == voxels.count()
    assert write(voxels.filter("z = 1"), overwrite=True)
    assert rows_of(volumes.load_labels(spark, f"file://{path}")) == expected(data, lambda z, y, x, v: z == 1)
    assert write(voxels.filter("z = 100"), overwrite=True) and volumes.load_labels(spark, f"file://{path}").count() == 0
    assert sorted(p.name for p in path.iterdir()) == ["volumes"]


def test_a_failed_write_leaves_what_was_there(spark, labels):
    data, path, voxels = labels
    bad = voxels.withColumn("label", F.when(F.col("z") == 19, F.raise_error(F.lit("no such label")).cast("long")).otherwise(1))
    with pytest.raises(Exception, match="no such label"):
        volumes.write_zarr(bad, f"file://{path}", "volumes", ["z", "y", "x"], "label", list(data.shape), [8, 8, 16], overwrite=True)
    assert rows_of(volumes.load_labels(spark, f"file://{path}")) == expected(data)
    with pytest.raises(Exception, match="outside of"):
        volumes.write_zarr(voxels, f"file://{path}", "new", ["z", "y", "x"], "label", [20, 30, 39], [8, 8, 16])
    assert sorted(p.name for p in path.iterdir()) == ["volumes"]


def test_a_chunk_split_over_tasks_is_an_error(spark, labels):
    data, path, voxels = labels
    options = {"path": f"file://{path}", "key": "split", "axes": "z,y,x", "value": "label", "shape": "20,30,40", "chunks": "8,8,16"}
    with pytest.raises(Exception, match="split over tasks|stand together"):
        voxels.repartition(4, "x", "y").sortWithinPartitions("z", "y", "x").write.format("arborix_zarr").mode("append").options(**options).save()
    assert sorted(p.name for p in path.iterdir()) == ["volumes"]


RETRY = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,3]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}).getOrCreate()
from arborix.sources import volumes
path = sys.argv[1]
voxels = spark.range(4000).selectExpr("cast(id div 400 as int) AS z", "cast(id div 20 % 20 as int) AS y", "cast(id % 20 as int) AS x", "id + 1 AS label")
def dying(batches):  # the first attempt at each task ends its process in the middle of its rows
    from pyspark import TaskContext
    for k, b in enumerate(batches):
        yield b
    if TaskContext.get().attemptNumber() == 0:
        os._exit(1)
from arborix.sources import arrays
arrays.register(spark)
place = ["z div 4", "y div 8", "x div 8"]
from pyspark.sql import functions as F
rows = voxels.repartition(3, *map(F.expr, place)).sortWithinPartitions(*map(F.expr, place)).mapInArrow(dying, voxels.schema)
options = {"path": path, "key": "volumes", "axes": "z,y,x", "value": "label", "shape": "10,20,20", "chunks": "4,8,8"}
rows.write.format("arborix_zarr").mode("append").options(**options).save()
found = volumes.load_labels(spark, path)
assert found.count() == 4000 and found.exceptAll(voxels).isEmpty()
spark.stop()
"""


def test_a_second_attempt_writes_the_same(tmp_path):
    done = subprocess.run([sys.executable, "-c", RETRY, f"file://{tmp_path}"], env=os.environ | {"PYTHONPATH": str(ROOT)}, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert sorted(p.name for p in tmp_path.iterdir() if "spark" not in p.name) == ["volumes"]
