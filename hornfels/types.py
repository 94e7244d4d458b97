"""Types of columns and variables, literals, and the struct that stands for a value of any type.

A value of unknown type is ``STRUCT<t, i, d, s, b>``: a tag, and one payload field that is not null.  Tags are in the
order of the types, so comparing structs orders values by type first and then by payload, and equality never mixes
types.  Variables with a type read the payload of their own tag only, as a native column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornfels.errors import TypeMismatch

ANY = "any"
NAMES = ("bool", "s8", "u8", "s16", "u16", "s32", "u32", "f32", "s64", "u64", "f64", "char", "string", "cid")
TAGS = {name: tag for tag, name in enumerate(NAMES)}
SPARK = {
    "bool": T.BooleanType(), "s8": T.ByteType(), "u8": T.ShortType(), "s16": T.ShortType(), "u16": T.IntegerType(), "s32": T.IntegerType(),
    "u32": T.LongType(), "f32": T.FloatType(), "s64": T.LongType(), "u64": T.DecimalType(20, 0), "f64": T.DoubleType(), "char": T.StringType(),
    "string": T.StringType(), "cid": T.BinaryType(),
}
RANGES = {f"{sign}{bits}": (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if sign == "s" else (0, 2**bits - 1) for sign in "su" for bits in (8, 16, 32, 64)}
INTEGERS, FLOATS = frozenset(RANGES), frozenset({"f32", "f64"})
ANY_TYPE = T.StructType([T.StructField("t", T.ByteType()), T.StructField("i", T.DecimalType(20, 0)), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType())])


@dataclass(frozen=True)
class Typed:
    """A literal of an explicit type, as in ``Typed("u8", 7)``."""

    type: str
    value: Any


def spark_type(name: str) -> T.DataType:
    return ANY_TYPE if name == ANY else SPARK[name]


def check_name(name: str) -> str:
    if name != ANY and name not in TAGS:
        raise TypeMismatch(name, ANY)
    return name


def unify(a: str, b: str) -> str:
    """The narrower of two types of which one is any or both are the same."""
    if a == ANY or a == b:
        return b
    if b == ANY:
        return a
    raise TypeMismatch(a, b)


def _fits(value: Any, name: str) -> bool:
    if name in RANGES:
        return isinstance(value, int) and not isinstance(value, bool) and RANGES[name][0] <= value <= RANGES[name][1]
    kinds = {"bool": bool, "f32": float, "f64": float, "char": str, "string": str, "cid": (bytes, bytearray)}
    return isinstance(value, kinds[name]) and (name != "char" or len(value) == 1)


def literal(value: Any, column: str) -> Typed:
    """The literal for a column: an explicit type must match; a plain one takes the column's type if it fits."""
    if isinstance(value, Typed):
        if not _fits(value.value, check_name(value.type)):
            raise TypeMismatch(value.type, type(value.value).__name__)
        unify(column, value.type)
        return value
    if column != ANY:
        if not _fits(value, column):
            raise TypeMismatch(column, type(value).__name__)
        return Typed(column, value)
    for name in ("bool", "s32", "s64", "u64", "f64", "string", "cid"):
        if _fits(value, name):
            return Typed(name, value)
    raise TypeMismatch(column, type(value).__name__)


def payload(name: str) -> str:
    return "i" if name in INTEGERS or name == "bool" else "d" if name in FLOATS else "b" if name == "cid" else "s"


def pack(column: Column, name: str) -> Column:
    """A native column as a value of any type."""
    field = payload(name)
    own = column.cast("int") if name == "bool" else column
    parts = [F.lit(TAGS[name]).cast("tinyint").alias("t")]
    for f in ANY_TYPE.fields[1:]:
        parts.append((own if f.name == field else F.lit(None)).cast(f.dataType).alias(f.name))
    return F.struct(*parts)


def unpack(column: Column, name: str) -> Column:
    """The payload of a value that is known to have the type."""
    out = column[payload(name)]
    return (out == 1) if name == "bool" else out.cast(SPARK[name])


def has_type(column: Column, name: str) -> Column:
    return column["t"] == F.lit(TAGS[name]).cast("tinyint")


def lit(value: Typed, column: str) -> Column:
    """A literal as the column's representation."""
    native = F.lit(float(value.value) if value.type in FLOATS else bytes(value.value) if value.type == "cid" else value.value).cast(SPARK[value.type])
    return pack(native, value.type) if column == ANY else native


def convert(column: Column, source: str, target: str) -> tuple[Column, Column | None]:
    """The column in another representation, and the condition on rows under which it has one."""
    if source == target:
        return column, None
    if target == ANY:
        return pack(column, source), None
    return unpack(column, target), has_type(column, target)


def to_any(value: Any) -> dict:
    """A Python value as the fields of the struct, for rows made on the driver."""
    typed = literal(value, ANY)
    field, v = payload(typed.type), typed.value
    if typed.type in FLOATS:
        v = float(v) if not math.isnan(v) else float("nan")
    elif field == "i":
        from decimal import Decimal

        v = Decimal(int(v))
    return {"t": TAGS[typed.type], "i": None, "d": None, "s": None, "b": None, field: v}


def from_any(row) -> Any:
    """The Python value of such a struct."""
    name = NAMES[row["t"]]
    v = row[payload(name)]
    return bool(v) if name == "bool" else int(v) if name in INTEGERS else bytes(v) if name == "cid" else v
