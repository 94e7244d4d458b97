"""Joins of a relation with itself in which many rows meet many.

Rows that share a key all meet, so a group of n rows makes n * n.  Joined by the key, they come out of as many tasks as
there are large groups, or of a single one where the rows are few enough to be broadcast.  Here each group is cut into
blocks, pairs of blocks are dealt over tasks by number, and a task expands its pairs of blocks as they are read: tasks
stay of one size and hold two blocks at a time, and it is their number that grows with the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 4_000_000
"""Pairs up to which the ordinary join is as good."""
BLOCK = 1024
"""Rows of a block, about."""
TASK = 8_000_000
"""Pairs that a task makes, about."""


def _sizes(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def _blocks(rows: DataFrame, keys: list[str], own: list[str], name: str) -> DataFrame:
    """(keys, rows of a block as an array)."""
    dealt = rows.join(_sizes(rows, keys, "_n"), keys).withColumn("_block", F.pmod(F.xxhash64(*own), F.ceil(F.col("_n") / BLOCK)))
    return dealt.groupBy(*keys, "_block").agg(F.collect_list(F.struct(*own)).alias(name)).drop("_block")


def join_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, bool, int] | None:
    """The distinct rows of an inner join on ``keys``, whether they stay distinct without the keys, and the number of
    tasks for them; None where there are too few rows to be worth it.  Both sides have columns of their own."""
    own, other = ([c for c in df.columns if c not in keys] for df in (left, right))
    left, right = left.distinct(), right.distinct()
    n = _sizes(left, keys, "_l").join(_sizes(right, keys, "_r"), keys).agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    if n <= FEW:
        return None
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -int(-n // TASK))
    single = left.groupBy(*own).count().agg(F.max("count")).first()[0] == 1  # no left row has two keys
    both = _blocks(left, keys, own, "_own").join(_blocks(right, keys, other, "_other"), keys).repartition(tasks)
    both = both.select(*keys, F.explode("_own").alias("_a"), "_other").select(*keys, "_a", F.explode("_other").alias("_b"))
    return both.select(*keys, *[F.col(f"_a.{c}").alias(c) for c in own], *[F.col(f"_b.{c}").alias(c) for c in other]), single, tasks
