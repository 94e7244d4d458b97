"""Conditions on variables: functions of columns to a boolean column, which Catalyst can push down, or Python UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def predicate(test: Callable[..., Column]) -> Callable[..., Column]:
    """Marks a function of columns as a predicate, for use with ``when``."""
    test.is_predicate = True
    return test


def python_predicate(test: Callable[..., bool | None]) -> Callable[..., Column]:
    """A Python test of values, run over Arrow batches; None counts as an error, as a predicate must decide."""

    def decide(*values) -> bool:
        out = test(*values)
        if out is None:
            raise ValueError("a predicate gave no answer")
        return bool(out)

    return F.udf(decide, "boolean", useArrow=True)
