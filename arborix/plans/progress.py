"""A search that goes on where it stopped: volumes come as a stream, some at a time, and each batch's entries are kept.

The scores of pairs are dealt to files so that a volume lies in one of them.
Structured Streaming reads the files that it has not read, writes down which ones
make up batch k before it begins, and that the batch is done after its entries
are there. A batch that failed is the same batch in the next run, and its
entries take the place of what it left behind; so a search that is stopped at
any moment and started again has the entries of one that was not, and scores no
finished batch twice. Files that are added later are scored by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import folder_of

KEY = ("em_id", "lm_vol", "variant")


def exists(path: str) -> bool:
    fs, place = folder_of(path)
    return fs.get_file_info(place).type != pafs.FileType.NotFound


def deal_by_volume(scores: DataFrame, path: str, volumes_per_file: int, volume: str = "lm_vol") -> None:
    """Writes scores with each volume in one file of about so many volumes; a table that is there, whole, stays."""
    if exists(f"{path}/_SUCCESS"):
        return
    count = scores.select(volume).distinct().count()
    scores.repartition(max(1, -(-count // volumes_per_file)), volume).write.mode("overwrite").parquet(path)


def follow(spark: SparkSession, scores: str, out: str, score: Callable[[DataFrame], DataFrame], *, files_per_batch: int = 1) -> None:
    """Runs ``score`` on every file of ``scores`` that has not been scored, some files at a time, and returns when all are.

    ``out`` has a folder of entries for each batch and the stream's own notes.
    """
    schema = spark.read.parquet(scores).schema

    def one(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            score(held).write.mode("overwrite").parquet(f"{out}/entries/batch={number}")
        finally:
            held.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(scores)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/notes").trigger(availableNow=True).start()
    query.awaitTermination()


def entries(spark: SparkSession, out: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """The entries of all finished batches; where a volume was scored again, the later batch counts."""
    fs, base = folder_of(f"{out}/entries")
    done = [i.path for i in fs.get_file_info(pafs.FileSelector(base)) if fs.get_file_info(f"{i.path}/_SUCCESS").is_file]
    if not done:
        raise FileNotFoundError(f"no finished batch at {out}")
    rows = spark.read.option("basePath", f"{out}/entries").parquet(*[f"{out}/entries/{p.rsplit('/', 1)[-1]}" for p in done])
    others = [c for c in rows.columns if c not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in others if c != "batch"]), "batch").alias("e"))
    return latest.select(*key, "e.*")
