"""Aggregates of a rule: the built-in ones and the user's.

A built-in or column aggregate is an expression over the argument columns, so Catalyst plans it with partial
aggregation.  A stepwise aggregate (``init``, ``step``, ``finish``) runs in JVM-side higher-order functions if its
parts are column expressions, or in a grouped Pandas UDF if they are Python functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from hornfels.plans.terms import Var
from hornfels.types import ANY, FLOATS, spark_type


@dataclass(frozen=True)
class Spec:
    """``build(args, type of the first, target type)`` gives the aggregated column.

    ``empty`` is the value of an empty group; ``None`` means that there is no row.
    """

    name: str
    build: Callable[[list[Column], str, str], Column]
    empty: Any = None

    def __call__(self, *args: Var) -> Bound:
        return Bound(self, args)


@dataclass(frozen=True)
class Bound:
    spec: Spec
    args: tuple[Var, ...]


def _sum(args: list[Column], kind: str, target: str) -> Column:
    wide = args[0] if kind in FLOATS else args[0].cast("decimal(38,0)")
    return F.sum(wide).cast(spark_type(target if target != ANY else kind))


def _mean(args: list[Column], kind: str, target: str) -> Column:
    out = spark_type(target if target != ANY else kind)
    if kind in FLOATS:
        return F.avg(args[0]).cast(out)
    total, n = F.sum(args[0].cast("decimal(20,0)")), F.count(args[0]).cast("decimal(20,0)")
    return ((total - total % n) / n).cast("decimal(20,0)").cast(out)  # truncates towards zero


count = Spec("count", lambda args, kind, target: F.count(F.lit(1)).cast(spark_type(target) if target != ANY else "bigint"), 0)
sum_ = Spec("sum", _sum, 0)
min_ = Spec("min", lambda args, kind, target: F.min(args[0]))
max_ = Spec("max", lambda args, kind, target: F.max(args[0]))
mean = Spec("mean", _mean)


def aggregate(build: Callable[..., Column], name: str | None = None, empty: Any = None) -> Spec:
    """An aggregate from a function of columns to an aggregated column; usable as a decorator."""

    def typed(args: list[Column], kind: str, target: str) -> Column:
        out = build(*args)
        return out.cast(spark_type(target)) if target != ANY else out

    return Spec(name or build.__name__, typed, empty)


def stepwise(init: Callable[[], Column], step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, name: str = "stepwise") -> Spec:
    """Column expressions folded over a group: ``step(state, args)``, with the arguments as a struct of c0, c1, ..."""

    def build(*args: Column) -> Column:
        rows = F.collect_list(F.struct(*[a.alias(f"c{k}") for k, a in enumerate(args)]))
        return F.aggregate(rows, init(), step, finish) if finish else F.aggregate(rows, init(), step)

    return aggregate(build, name)


def python_aggregate(make: Callable[[], Any], name: str = "python") -> Callable[..., Bound]:
    """An aggregate object with ``step(*args)`` and ``finish()``; a ``finish`` of None gives no row.

    One group is folded in one Python call, so it must fit in a task; prefer :func:`aggregate`.
    """

    def typed(args: list[Column], kind: str, target: str) -> Column:
        from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

        def fold(*columns):
            state = make()
            for row in zip(*columns):
                state.step(*row)
            return state.finish()

        return pandas_udf(fold, returnType=spark_type(target), functionType=PandasUDFType.GROUPED_AGG)(*args)

    return Spec(name, typed)
