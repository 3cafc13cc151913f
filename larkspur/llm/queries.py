"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate, htmltext, langid, lmscore, media, mixing, ngramjoin, quality, substrings, toxicity
from larkspur.llm.shared import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _on(*tables: str, run: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return run(*(_table(spark, sf_dir, t) for t in tables))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": _on("documents", run=langid.languages),
        "op2_ngram_jaccard_join": _on("documents", run=ngramjoin.ngram_join),
        "op3_mixing": _on("documents", run=mixing.mix_documents),
        "op4_media": _on("documents", run=media.media_digests),
        "op5_quality": _on("documents", "labels", run=quality.quality_scores),
        "op6_decontamination": _on("documents", "benchmark", run=decontaminate.contamination),
        "op7_html_text": _on("pages", run=htmltext.page_texts),
        "op8_lm_scoring": _on("documents", run=lmscore.model_scores),
        "op9_substring_dedup": _on("documents", run=substrings.substring_dedup),
        "op10_toxicity": _on("documents", "labels", run=toxicity.toxicity_scores),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.ORACLE_SQL,
        "op6_decontamination": decontaminate.ORACLE_SQL,
        "op9_substring_dedup": substrings.ORACLE_SQL,
    }
