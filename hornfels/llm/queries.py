"""The registered queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornfels.llm import mixing, quality, topk
from hornfels.llm.common import documents
from hornfels.llm.imatch import fingerprints
from hornfels.llm.license_scan import license_scan
from hornfels.llm.line_dedup import line_dedup
from hornfels.llm.lm_score import lm_scores
from hornfels.llm.near_dedup import near_duplicates
from hornfels.llm.packing import best_fit_pack
from hornfels.llm.token_io import round_trip


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_deleted", "text")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


_ALL = (
    op1_license_scan,
    op2_lm_score,
    op3_near_dedup,
    op4_quality_classifier,
    op5_best_fit_packing,
    op6_line_dedup,
    op7_source_mixing,
    op8_document_fingerprints,
    op9_exact_top_k,
    op10_token_output,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op7_source_mixing": mixing.ORACLE, "op9_exact_top_k": topk.ORACLE}
