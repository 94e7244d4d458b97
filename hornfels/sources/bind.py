"""Binding tables to declared inputs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.errors import ColumnMissing
from hornfels.plans.compile_rule import CID
from hornfels.plans.terms import Declaration
from hornfels.types import ANY, ANY_TYPE, SPARK, pack, spark_type

_NATIVE = {"boolean": "bool", "tinyint": "s8", "smallint": "s16", "int": "s32", "bigint": "s64", "decimal(20,0)": "u64", "float": "f32", "double": "f64", "string": "string", "binary": "cid"}


def bind(df: DataFrame, decl: Declaration, columns: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of ``df`` as rows of the input: declared columns and types, distinct, without rows that hold a null.

    ``columns`` maps the input's columns to those of ``df``, where names differ.  A column of any type takes the
    type of the native column that it is bound to.
    """
    out = []
    for column, kind in decl.columns.items():
        source = (columns or {}).get(column, column)
        if source not in df.columns:
            raise ColumnMissing(decl.name, column)
        value = F.col(f"`{source}`")
        there = df.schema[source].dataType
        if kind == ANY:
            value = value.cast(ANY_TYPE) if there.typeName() == "struct" else pack(value, _NATIVE[there.simpleString()])
        elif there != SPARK[kind]:
            value = value.cast(SPARK[kind])
        out.append(value.alias(column))
    cid = F.col(CID) if CID in df.columns else F.lit(None).cast("binary")
    rows = df.select(*out, cid.alias(CID)).dropna(subset=list(decl.columns)) if decl.columns else df.select(cid.alias(CID))
    return rows.distinct()


def rows(spark: SparkSession, decl: Declaration, values: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Rows made on the driver, for small inputs and tests."""
    from pyspark.sql import types as T

    from hornfels.types import to_any

    schema = T.StructType([T.StructField(c, spark_type(k)) for c, k in decl.columns.items()])
    data = [tuple(to_any(r[c]) if k == ANY else r[c] for c, k in decl.columns.items()) for r in values]
    return bind(spark.createDataFrame(data, schema), decl)
