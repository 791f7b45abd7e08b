"""Properties of the whole search and of the parts that the queries do not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.operators import filters, joins, kernels, selection, skeletonize
from arborix.plans import search, stages
from arborix.plans.catalogue import QUERIES
from arborix.plans.views import view
from arborix.sources import files, volumes


def test_search_properties(spark, sf_dir):
    rows = QUERIES["e2e_search"](spark, sf_dir).collect()
    assert rows and all(r.cov_score <= 0 for r in rows)
    for r in rows:
        assert (r.frag_ids is None) == (r.cov_score == 0)
        if r.frag_ids is not None:
            assert 0 < r.aggregate_coverage <= 100 + 1e-9 and 0 < len(r.frag_ids) <= r.n_fragments
    for em in {r.em_id for r in rows}:
        mine = sorted((r for r in rows if r.em_id == em), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine))) and [r.merged_rank for r in mine] == sorted(r.merged_rank for r in mine)


def test_energy_lies_within_bounds(spark, sf_dir):
    em, frags = view(spark, sf_dir, "em_point"), view(spark, sf_dir, "frag_point").withColumn("side", F.lit("normal"))
    sizes = frags.groupBy("side", "lm_vol", "frag_id").agg(F.count("*").alias("frag_points"))
    scores = em.select("em_id").distinct().crossJoin(sizes).withColumn("score_full", (F.col("frag_id") * 7 % 10) / 10.0).withColumn("score_pruned", F.lit(0.1))
    points = em.groupBy("em_id").agg(F.count("*").alias("points"))
    options = search.SearchOptions(energy_threshold=0.0)
    able = search.candidates(scores, em, options)
    covered = search.covered_points(able, em, frags, options)
    fragments = search.scored_fragments(able, covered, points, options, "score_full")
    bounds = {(r.em_id, r.lm_vol): r for r in search.side_bounds(fragments, covered, points).collect()}
    colors = fragments.select("lm_vol", "frag_id").distinct().select("*", *[((F.col("frag_id") * m) % 255 + 1.0).alias(c) for m, c in ((37, "r"), (91, "g"), (53, "b"))])
    found = selection.best_fragments(covered, fragments.join(colors, ["lm_vol", "frag_id"]), points, keys=("em_id", "lm_vol", "side")).collect()
    assert found
    for r in found:
        b = bounds[r.em_id, r.lm_vol]
        assert b.lower - 1e-6 <= r.cov_score <= b.upper + 1e-6


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    em, frags = view(spark, sf_dir, "em_point"), view(spark, sf_dir, "frag_point")
    one = sorted(map(tuple, kernels.coverage(em, frags, 25).collect()))
    other = sorted(map(tuple, kernels.coverage(em.repartition(5), frags.repartition(3), 25).collect()))
    assert one == other


def test_missing_keys_and_double_values_are_errors(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert joins.checked_lookup(rows.filter("k = 1"), table, ["k"]).count() == 1
    with pytest.raises(Exception, match="missing"):
        joins.checked_lookup(rows, table, ["k"]).collect()
    a, b = spark.createDataFrame([(1, 0.5)], "k int, v double"), spark.createDataFrame([(1, 0.6)], "k int, v double")
    with pytest.raises(Exception, match="two values"):
        files.merge_scores([a, b], ["k"], "v").collect()


def test_codes_in_blocks(spark):
    names, codes = spark.createDataFrame([(f"R{i}-x",) for i in range(30)], "name string"), spark.createDataFrame([(str(i),) for i in range(7)], "code string")
    rows = lambda most: sorted(map(tuple, joins.containing(names, codes, "name", "code", most).collect()))
    assert rows(100) == rows(2) and len(rows(2)) > 7


def test_named_box(spark):
    nodes = spark.createDataFrame([(100.0, 50.0, 50.0), (500.0, 50.0, 50.0)], "x double, y double, z double")
    assert [r.x for r in filters.crop(nodes, "hemibrain", nodes).collect()] == [500.0]


def test_swc_lines_that_are_skipped(spark):
    lines = ["# comment", "", "x", " 1 0 1 2 3 4 -1", "2 0 10 20 30 2 1"]
    table = spark.createDataFrame([(v,) for v in lines], "value string")
    assert [r.node_id for r in files.parse_swc(table).collect()] == [1, 2]
    strict = files.parse_swc(table, strict=True, factor=0.1).collect()
    assert [(r.node_id, r.x, r.diameter, r.parent_id) for r in strict] == [(2, 1.0, 0.2, 1)]


def test_zarr_in_other_forms(spark, tmp_path):
    import json

    zstandard = pytest.importorskip("zstandard")
    block = np.arange(24, dtype="<u2").reshape(2, 3, 4)
    folder = tmp_path / "v" / "volumes"
    for i in range(2):
        (folder / str(i) / "0").mkdir(parents=True)
        (folder / str(i) / "0" / "0").write_bytes(zstandard.ZstdCompressor().compress((block + i).tobytes(order="F")))
    (folder / ".zarray").write_text(json.dumps({"shape": [3, 3, 4], "chunks": [2, 3, 4], "dtype": "<u2", "compressor": {"id": "zstd"}, "order": "F", "filters": None, "dimension_separator": "/"}))
    got = {(r.z, r.y, r.x): r.label for r in volumes.load_labels(spark, f"file://{tmp_path}/v").collect()}
    want = {(z, y, x): int(block[z % 2, y, x] + z // 2) for z in range(3) for y in range(3) for x in range(4)}
    assert got == {k: v for k, v in want.items() if v}


def blosc_frame(data: bytes, size: int, block: int, codec: str, shuffle: bool, split: bool) -> bytes:
    """A frame as the format says, for reading back."""
    import struct
    import zlib

    import pyarrow as pa

    pack = {"lz4": lambda b: pa.compress(b, "lz4_raw", asbytes=True), "zlib": zlib.compress, "zstd": lambda b: pa.compress(b, "zstd", asbytes=True), "snappy": lambda b: pa.compress(b, "snappy", asbytes=True)}[codec]
    number = {"lz4": 1, "snappy": 2, "zlib": 3, "zstd": 4}[codec]
    bodies = []
    for a in range(0, len(data), block):
        part = data[a : a + block]
        if shuffle:
            part = np.frombuffer(part, np.uint8).reshape(-1, size).T.tobytes()
        streams = size if split and len(part) == block and block // size >= 128 else 1
        pieces = [part[k * len(part) // streams : (k + 1) * len(part) // streams] for k in range(streams)]
        packed = [c if len(c := pack(p)) < len(p) else p for p in pieces]
        bodies.append(b"".join(struct.pack("<i", len(c)) + c for c in packed))
    starts, at = [], 16 + 4 * len(bodies)
    for b in bodies:
        starts.append(at)
        at += len(b)
    flags = number << 5 | (0 if split else 16) | shuffle
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(data), block, at) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(bodies)


@pytest.mark.parametrize("codec", ["lz4", "zlib", "zstd", "snappy"])
@pytest.mark.parametrize(("shuffle", "split"), [(True, True), (False, True), (True, False)])
def test_blosc_frames(codec, shuffle, split):
    data = np.concatenate([np.arange(3000), np.random.default_rng(1).integers(0, 9, 1500)]).astype("<u8").tobytes()
    for block in (4096, 8192, len(data)):
        assert volumes.decompressed(blosc_frame(data, 8, block, codec, shuffle, split), "blosc") == data
    stored = bytes([2, 1, 1 << 5 | 2, 8]) + len(data).to_bytes(4, "little") + len(data).to_bytes(4, "little") + (len(data) + 16).to_bytes(4, "little") + data
    assert volumes.decompressed(stored, "blosc") == data


def test_zarr_of_blosc_chunks(spark, tmp_path):
    import json

    block = np.arange(24, dtype="<u2").reshape(2, 3, 4)
    folder = tmp_path / "v" / "volumes"
    folder.mkdir(parents=True)
    (folder / "0.0.0").write_bytes(blosc_frame(block.tobytes(), 2, 48, "lz4", True, True))
    (folder / ".zarray").write_text(json.dumps({"shape": [2, 3, 4], "chunks": [2, 3, 4], "dtype": "<u2", "compressor": {"id": "blosc", "cname": "lz4"}, "order": "C", "filters": None}))
    got = {(r.z, r.y, r.x): r.label for r in volumes.load_labels(spark, f"file://{tmp_path}/v").collect()}
    assert got == {tuple(map(int, at)): int(block[tuple(at)]) for at in np.argwhere(block)}


def test_hdf_needs_its_library(spark, tmp_path):
    pytest.importorskip("pyarrow")
    (tmp_path / "x.h5").write_bytes(b"")
    try:
        import h5py
    except ImportError:
        with pytest.raises(Exception, match="h5py"):
            volumes.read_hdf(spark, f"file://{tmp_path}", "volumes/raw").collect()
        return
    with h5py.File(tmp_path / "x.h5", "w") as f:
        f["volumes/raw"] = np.arange(24).reshape(2, 3, 4)
    assert volumes.read_hdf(spark, f"file://{tmp_path}", "volumes/raw", slab=4).count() == 23


def test_skeleton_files_have_names(spark, tmp_path):
    nodes = spark.createDataFrame([(f"S{s}_{s + 1}", n, 0, n * 1.5, 0.0, 2.0, 1.0, n - 1 if n > 1 else -1) for s in range(5) for n in range(1, 9)], "skel string, node_id int, node_type int, x double, y double, z double, diameter double, parent_id int")
    files.write_swc(nodes, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"S{s}_{s + 1}.swc" for s in range(5)]
    read = files.read_swc(spark, f"file://{tmp_path}/out").select(nodes.columns)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, nodes.collect()))


def test_skeleton_of_a_tube_is_its_axis():
    voxels = np.array([(z, y, x) for x in range(40) for y in range(-2, 3) for z in range(-2, 3) if y * y + z * z <= 4])
    rows = skeletonize.skeleton(voxels)
    xs = sorted(v[2] for _, v, _, _ in rows)
    assert sum(p == -1 for _, _, p, _ in rows) == 1 and xs[0] <= 1 and xs[-1] >= 38
    middle = [v for _, v, _, _ in rows if 8 < v[2] < 32]
    assert all(abs(v[0]) <= 1 and abs(v[1]) <= 1 for v in middle)


def test_skeleton_of_a_fork_has_a_branch():
    arms = [(0, 0, x) for x in range(60)] + [(0, y, 30) for y in range(1, 40)]
    voxels = np.array(sorted({(z + a, y + b, x + c) for z, y, x in arms for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)}))
    rows = skeletonize.skeleton(voxels)
    children = [p for _, _, p, _ in rows if p != -1]
    assert any(children.count(p) > 1 for p in children) and max(v[1] for _, v, _, _ in rows) > 30


def test_boundary_distance_by_hand():
    mask = np.zeros((5, 5, 5), bool)
    mask[1:4, 1:4, 1:4] = True
    d = skeletonize.boundary_distance(mask)
    assert d[2, 2, 2] == 2 and d[1, 1, 1] == 1 and d[0, 0, 0] == 0


def read_png(data):
    import struct
    import zlib

    from arborix.sources import pages

    width, height, rows = pages.png_stream(data)
    at = len(pages.SIGNATURE)
    while at < len(data):  # every chunk's sum
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(rows), np.uint8).reshape(height, 1 + 3 * width)
    assert not raw[:, 0].any()
    return raw[:, 1:].reshape(height, width, 3)


def test_pixels_become_images_and_pages(spark, tmp_path):
    import re

    from arborix.operators import images
    from arborix.sources import pages

    voxels = spark.createDataFrame([(z, y, x, 10 * x, 20, 0) for z in range(3) for y in range(4) for x in range(6)], "z int, y int, x int, r int, g int, b int")
    line = spark.createDataFrame([(1, 2, x) for x in range(5)], "z int, y int, x int")
    view = images.overlay(voxels, line)
    assert pages.write_png(view.withColumn("em", F.lit("one")).unionByName(images.by_depth(images.depth_view(voxels, line, line, channel="r", depth=3, clip=50.0)).withColumn("em", F.lit("two"))), f"file://{tmp_path}", "em", 4, 6) == 2
    image = read_png((tmp_path / "one.png").read_bytes())
    assert image[2, 3].tolist() == [255, 0, 255] and image[0, 0].tolist() == [100, 106, 100] or image[0, 0, 2] == 100
    rows = [("em", k, f"{k}: (line)", f"R{k % 2}", ["a", "b\\"], [f"file://{tmp_path}/one.png", f"file://{tmp_path}/two.png"]) for k in range(5)] + [("other", 0, "x", None, None, None)]
    table = spark.createDataFrame(rows, pages.PAGES)
    assert sorted(map(tuple, pages.write_pdf(table, f"file://{tmp_path}/pdf").collect())) == [("em", 5), ("other", 1)]
    data = (tmp_path / "pdf" / "em.pdf").read_bytes()
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    places = [int(m) for m in re.findall(rb"(\d{10}) 00000 n", data[start:])]
    for number, at in enumerate(places, 1):  # every object stands where the table says
        assert data[at:].startswith(b"%d 0 obj" % number)
    assert data.count(b"/Subtype /Image") == 10 and len(re.findall(rb"/Type /Page ", data)) == 5 and rb"(0: \(line\))" in data
    for m in re.finditer(rb"/Length (\d+) >>\nstream\n", data):
        assert data[m.end() + int(m[1]) :].startswith(b"\nendstream")


def test_stages_from_volumes_to_reports(spark, tmp_path):
    """Two lines of voxels: one is the target's, one stands elsewhere; the volume with the first comes out."""
    rng = np.random.default_rng(0)
    data = f"file://{tmp_path}"
    lines = {1: [(30 + dz, 40 + dy, x) for x in range(20, 90) for dz in (-1, 0, 1) for dy in (-1, 0, 1)], 2: [(10 + dz, y, 12 + dx) for y in range(100, 150) for dz in (0, 1) for dx in (0, 1)], 3: [(5, 5, 5)]}
    voxels = spark.createDataFrame([(*v, label) for label, vs in lines.items() for v in vs], "z int, y int, x int, label long")
    shape, chunks = [64, 160, 160], [32, 64, 64]
    volumes.write_zarr(voxels, f"{data}/labels", "volumes", ["z", "y", "x"], "label", shape, chunks)
    raw = voxels.select("z", "y", "x", F.posexplode(F.array(F.lit(10), F.col("label") * 50, F.lit(200))).alias("c", "v"))
    volumes.write_zarr(raw, f"{data}/raw", "volumes/raw", ["c", "z", "y", "x"], "v", [3, *shape], [1, *chunks], "|u1")
    stage = lambda *words: stages.run(spark, [words[0], "--data", data, *words[1:]])
    assert stage("small", "--labels", "labels", "--out", "large", "--least-voxels", "50")
    assert not stage("small", "--labels", "labels", "--out", "large") and stage("small", "--labels", "labels", "--out", "large", "--least-voxels", "50", "--again")
    assert stage("skeletons", "--labels", "large", "--out", "fragments", "--volume", "R1-line")
    assert sorted(p.name for p in (tmp_path / "fragments").iterdir()) == ["R1-line_1.swc", "R1-line_2.swc"]
    assert stage("colors", "--labels", "large", "--raw", "raw", "--volume", "R1-line", "--out", "colors") and spark.read.parquet(f"{data}/colors").count() == 2
    target = spark.createDataFrame([("7", n, 0, float(x), 40.0 + rng.uniform(-1, 1), 30.0, 1.0, n - 1 if n > 1 else -1) for n, x in enumerate(range(20, 90), 1)], "skel string, node_id int, node_type int, x double, y double, z double, diameter double, parent_id int")
    files.write_swc(target, f"{data}/targets")
    assert stage("prune", "--skeletons", "targets", "--out", "pruned", "--length", "2.5", "--rounds", "1")
    assert files.read_swc(spark, f"{data}/pruned").count() <= 70
    assert stage("resample", "--skeletons", "targets", "--out", "even", "--step", "0.5")
    even = files.read_swc(spark, f"{data}/even")
    assert even.count() > 130 and even.filter("parent_id = -1").count() == 1
    assert stage("spines", "--skeletons", "targets", "--out", "spines") and files.read_swc(spark, f"{data}/spines").count() == 70
    (tmp_path / "table.csv").write_text("0,0,0.5\n0,0.5,1\n5,0.2,0.5\n20,-1,-1\n")
    shared = ("--targets", "targets", "--fragments", "fragments", "--width", "160")
    assert stage("scores", *shared, "--pruned", "pruned", "--table", f"{tmp_path}/table.csv", "--out", "scores")
    assert stage("scores", *shared, "--pruned", "pruned", "--table", f"{tmp_path}/table.csv", "--near", "1", "--out", "near_scores")
    both = [sorted((r.em_id, r.side, r.lm_vol, r.frag_id, round(r.score_full, 9), round(r.score_pruned, 9)) for r in spark.read.parquet(f"{data}/{n}").collect()) for n in ("scores", "near_scores")]
    assert both[0] == both[1]
    assert stage("match", *shared, "--scores", "scores", "--colors", "colors", "--out", "entries", "--energy-threshold", "-1.0", "--least-aggregate", "0.1", "--adaptive-factor", "1")
    rows = spark.read.parquet(f"{data}/entries").collect()
    assert [(r.em_id, r.lm_vol, r.frag_ids) for r in rows] == [("7", "R1-line", [1])] and rows[0].cov_score < 0 and not rows[0].mirrored
    same = ("--scores", "scores", "--colors", "colors", "--energy-threshold", "-1.0", "--least-aggregate", "0.1", "--adaptive-factor", "1")
    for _ in range(2):  # the second time nothing is left to score
        assert stage("follow", *shared, *same, "--out", "followed", "--volumes-per-batch", "1")
        assert sorted(map(str, spark.read.parquet(f"{data}/followed/ranked").collect())) == sorted(map(str, spark.read.parquet(f"{data}/entries").select(spark.read.parquet(f"{data}/followed/ranked").columns).collect()))
    assert stage("report", "--entries", "entries", "--out", "report")
    assert [r.line_name for r in spark.read.csv(f"{data}/report", header=True).collect()] == ["R1-line"]
