"""Registered queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .exact_topk import exact_topk
from .jaccard_join import jaccard_components
from .language_id import identify_language
from .mixing import mixture
from .packing import pack_documents
from .periodic_runs import run_report, with_repeats
from .quality_classifier import quality_scores
from .quality_rules import quality_cascade
from .ring_sharding import shard_documents
from .sql import ORACLES
from .suffix_dedup import dedup_report
from .tool_calls import TOOLS, calls_of_turns, link_tool_calls
from .toxicity import toxicity_scores
from .whitening import whitened_components


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture(read_table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("weight", "prob", "draw")})


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"))


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read_table(spark, sf_dir, "embeddings"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(read_table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, refs, context = calls_of_turns(read_table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, refs, TOOLS, context)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(read_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).drop("set_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(read_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(with_repeats(read_table(spark, sf_dir, "documents")))


ALL = (op1_mixing, op2_language_id, op3_ring_sharding, op4_exact_topk, op5_suffix_array_dedup, op6_chat_formatting, op7_quality_rules, op8_ngram_jaccard_join, op9_packing, op10_quality_classifier, op11_embedding_whitening, op12_toxicity, op13_periodic_runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
