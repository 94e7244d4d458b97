"""The log of facts: entity, attribute, value and causal links, addressed by content."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornfels.functions.content import cid_column, fact_cid
from hornfels.plans.compile_rule import CID
from hornfels.types import ANY_TYPE, to_any

SCHEMA = T.StructType(
    [T.StructField("entity", ANY_TYPE), T.StructField("attribute", ANY_TYPE), T.StructField("value", ANY_TYPE), T.StructField("links", T.ArrayType(T.BinaryType())), T.StructField(CID, T.BinaryType())]
)


@dataclass(frozen=True)
class InputTuple:
    entity: Any
    attribute: Any
    value: Any
    links: tuple[bytes, ...] = ()

    @property
    def cid(self) -> bytes:
        return fact_cid(self.entity, self.attribute, self.value, self.links)


def from_tuples(spark: SparkSession, tuples: Iterable[InputTuple]) -> DataFrame:
    rows = [(to_any(t.entity), to_any(t.attribute), to_any(t.value), list(t.links), t.cid) for t in tuples]
    return spark.createDataFrame(rows, SCHEMA)


def from_columns(df: DataFrame, entity: Column, attribute: Column, value: Column, links: Column | None = None) -> DataFrame:
    """Facts from a table; the first three columns hold values of any type (see :func:`hornfels.types.pack`)."""
    no_links = F.array().cast("array<binary>")
    linked = F.coalesce(links, no_links) if links is not None else no_links
    return df.select(entity.alias("entity"), attribute.alias("attribute"), value.alias("value"), linked.alias("links"), cid_column(entity, attribute, value, linked).alias(CID))


def evac(facts: DataFrame) -> DataFrame:
    """Rows of the input ``evac``; facts of equal columns and other links differ by their content id."""
    return facts.select("entity", "attribute", "value", CID).distinct()


def links(facts: DataFrame) -> DataFrame:
    """Rows of the input ``links``: one for each link of a fact; they have no content id of their own."""
    rows = facts.select(F.col(CID).alias("from"), F.explode("links").alias("to"))
    return rows.distinct().withColumn(CID, F.lit(None).cast("binary"))


def inputs(facts: DataFrame) -> dict[str, DataFrame]:
    return {"evac": evac(facts), "links": links(facts)}
