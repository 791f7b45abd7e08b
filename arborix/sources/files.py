"""Readers and writers of skeleton text, score and colour documents, and reports.

Documents are parsed by schema; nothing that is read is ever evaluated as code.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..schemas import COLORS, SCORES


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder that the session names, removed when the driver's JVM ends. Only a session of one
    machine that names none gets a temporary one."""
    base, current = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and current.isDefined():
        base = current.get()
    elif not base:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="arborix-")
        spark.sparkContext.setCheckpointDir(base)
        remove_on_exit(spark, base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    remove_on_exit(spark, path)
    return path


def remove_on_exit(spark: SparkSession, path: str) -> None:
    """Whether the session was stopped before or not. The folder is left for its writer to create."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    fs.delete(where, True)  # the name stays on the list


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, as executors see it."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def parse_swc(lines: DataFrame, *, line: str = "value", factor: float = 1.0, strict: bool = False) -> DataFrame:
    """Rows with a line of text -> node_id, node_type, x, y, z, diameter, parent_id.

    Comments and blank lines are skipped; ``strict`` also skips lines that begin
    with a blank, as the graph reader does. ``factor`` scales lengths.
    """
    keep = ~F.col(line).startswith("#") & (F.length(F.trim(line)) > 1)
    if strict:
        keep &= ~F.col(line).startswith(" ")
    f = F.split(F.trim(F.col(line)), r"\s+")
    number = lambda k: F.try_element_at(f, F.lit(k)).try_cast("double") * F.lit(float(factor))
    whole = lambda k: F.try_element_at(f, F.lit(k)).try_cast("double").cast("int")
    fields = {"node_id": whole(1), "node_type": whole(2), "x": number(3), "y": number(4), "z": number(5), "diameter": number(6), "parent_id": whole(7)}
    return lines.filter(keep).withColumns(fields).drop(line)


def read_swc(spark: SparkSession, path: str, **options) -> DataFrame:
    """Skeleton files of a folder; ``skel`` is the file's name without its ending."""
    lines = spark.read.text(path).withColumn("skel", F.regexp_replace(F.col("_metadata.file_name"), r"\.swc$", ""))
    return parse_swc(lines, **options)


def swc_lines(nodes: DataFrame) -> Column:
    """A node as a line: id, type, coordinates, diameter, parent."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in ("node_id", "node_type", "x", "y", "z", "diameter", "parent_id")])


def write_swc(nodes: DataFrame, path: str) -> None:
    """A file ``<skel>.swc`` for each skeleton, its nodes in order of id. Files appear whole, so a repeated task does no harm."""
    lines = nodes.select(F.col("skel").cast("string").alias("skel"), "node_id", swc_lines(nodes).alias("value"))

    def run(batches):
        fs, base = folder_of(path)
        fs.create_dir(base, recursive=True)
        name, out, part, n = None, None, "", 0

        def finish():
            out.close()
            fs.move(part, f"{base}/{name}.swc")
            return pa.record_batch({"skel": pa.array([name]), "nodes": pa.array([n], pa.int64())})

        for batch in batches:
            for skel, value in zip(batch.column("skel").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if skel != name:
                    if out is not None:
                        yield finish()
                    name, part, n = skel, f"{base}/_{skel}-{uuid.uuid4().hex}", 0
                    out = fs.open_output_stream(part)
                out.write(value.encode() + b"\n")
                n += 1
        if out is not None:
            yield finish()

    lines.repartition("skel").sortWithinPartitions("skel", "node_id").mapInArrow(run, "skel string, nodes long").agg(F.sum("nodes")).collect()


def parse_scores(documents: DataFrame, column: str = "value") -> DataFrame:
    """Score documents -> em, lm_vol, frag_id, scores; composite names become columns."""
    by_em = documents.select(F.explode(F.from_json(column, SCORES)).alias("em", "m"))
    each = by_em.select("em", F.explode("m").alias("name", "scores"))
    return each.select("em", scalars.volume_of(F.col("name")).alias("lm_vol"), scalars.fragment_of(F.col("name")).alias("frag_id"), "scores")


def parse_colors(documents: DataFrame, column: str = "value") -> DataFrame:
    """Colour documents -> lm_vol, frag_id, r, g, b."""
    by_volume = documents.select(F.explode(F.from_json(column, COLORS)).alias("lm_vol", "m"))
    each = by_volume.select("lm_vol", F.explode("m").alias("frag_id", "text"))
    rgb = F.from_json("text", "array<int>")
    return each.select("lm_vol", F.col("frag_id").cast("int").alias("frag_id"), *[rgb[k].alias(c) for k, c in enumerate("rgb")])


def merge_scores(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Score tables of several files as one; a key must have one value, and one that has two is an error."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    one = out.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most"))
    differ = one.withColumn("__same", F.when(F.col(value) == F.col("__most"), F.lit(True)).otherwise(F.raise_error(F.lit("a key has two values"))))
    return differ.filter("__same").select(*keys, value)


def write_scores(scores: DataFrame, path: str) -> None:
    """Parquet by group and em, best score first."""
    grouped = scores.withColumn("em_group", scalars.em_group(F.col("em_id")))
    grouped.repartition("em_group", "em_id").sortWithinPartitions("em_group", "em_id", F.col("score_full").desc(), "lm_vol", "frag_id").write.partitionBy("em_group").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Comma-separated report: line name, slide code, rank."""
    rows.select(F.col("line_name").alias("Line Name"), F.col("slide_code").alias("Slide Code"), "rank").write.csv(path, header=True)


def save_new(table: DataFrame, path: str, keys: list[str]) -> None:
    """Appends only rows whose keys the folder does not hold yet."""
    spark = table.sparkSession
    try:
        table = table.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    table.write.mode("append").parquet(path)


def read_back(table: DataFrame, label: str) -> DataFrame:
    """A table written and read again."""
    path = work_folder(table.sparkSession, label)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


