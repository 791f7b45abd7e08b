"""From documents to token files: the stages that a training corpus passes, in order.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; every stage but the last returns the columns of documents.

Defined cases: null and empty texts and texts without a letter go in the first
stage, since no language is told for them; of repeated rows and equal texts one
stays; a row without doc_id stays like others, and its tokens stand first; null
languages teach nothing, null sources are the last source; an empty table gives
an empty result after every stage; columns besides those of documents pass all
stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborix.llm import common, decontaminate, langid, mixing, simhash, tokenbin


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go; ``lang`` stays as it was."""
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target size; documents taken more than once are repeated."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, and each document's place in them."""
    return tokenbin.op3_token_binary(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: Language models and fingerprints have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written as Parquet and read by the next."""
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.options(**common.WRITING).parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            common.delete(spark, f"{folder}/{k - 1}")
    common.delete_on_exit(spark, folder)
    return docs
