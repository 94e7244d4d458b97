"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets what it wrote, read again.  All
but the last return the columns of documents:

* quality: the documents that the classifier does not reject;
* lines: texts without the blocks they share with earlier documents; a document of which nothing is left goes;
* near: one document of each near-duplicate group (five-word shingles, similarity 0.8 or more);
* mix: each document as often as its source's target asks for, the last repetition of a source cut to its share;
* pack: one row for each piece of at most 4096 tokens with its sequence and offset.

Edge cases: null texts count as empty; the classifier scores them like any other, line dedup and near-dedup leave them,
and the mix, which takes words, takes none of them; null ids stay until the mix, which deals them like others; rows of
an equal id and text are one document, so they stay or go together; very long texts pass whole and are cut only by the
last stage; without labels of both classes nothing is rejected; an empty table gives empty results; columns with names
that stages use inside stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornfels.llm.common import persist
from hornfels.llm.line_dedup import drop_repeated_lines
from hornfels.llm.mixing import mixed_rows
from hornfels.llm.near_dedup import drop_near_duplicates
from hornfels.llm.packing import best_fit_pack
from hornfels.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]

ORACLE_SQL: str | None = None
"""Classifier, shingles and tokenizer cannot be said in SQL; tests compare with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = persist(docs)
    return docs
