"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, infill, langid, linededup, mixing, mpegaudio, periodic, simhash, suffixdedup, surrogates, tokenbin, wordpiece
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_decontaminate": lambda spark, sf_dir: decontaminate.op1_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op2_langid": on_documents(langid.op2_langid),
    "op3_token_binary": on_documents(tokenbin.op3_token_binary),
    "op4_pii_surrogates": on_documents(surrogates.op4_pii_surrogates),
    "op5_line_dedup": on_documents(linededup.op5_line_dedup),
    "op6_mpeg_audio": on_documents(mpegaudio.op6_mpeg_audio),
    "op7_mix": on_documents(mixing.op7_mix),
    "op8_simhash": on_documents(simhash.op8_simhash),
    "op9_token_counts": on_documents(wordpiece.op9_token_counts),
    "op10_suffix_dedup": on_documents(suffixdedup.op10_suffix_dedup),
    "op11_infill": on_documents(infill.op11_infill),
    "op12_periodic": on_documents(periodic.op12_periodic),
    "op13_bpe": on_documents(bpe.op13_bpe),
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op5_line_dedup": linededup.SQL,
    "op7_mix": mixing.SQL,
    "op11_infill": infill.SQL,
}
