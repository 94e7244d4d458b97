"""Mixing sources to target weights: capped water-filling with seeded whole and fractional repetitions.

Only DataFrame expressions are used.  Water-filling asks for the level L with
``sum(min(cap_i, L * weight_i)) = share * total``, where ``cap_i`` is ``max_epochs`` times the size of source i.
Clamping sources at their cap and sharing out the excess until none is above its cap ends at that level.  A
source is clamped exactly if filling up to its own ratio ``cap_i / weight_i`` needs no more than the total, which
two running sums over the sources ordered by ratio tell; so no loop is needed.

Each document is repeated ``floor(target / size of its source)`` times as a whole.  The rest of the target is
taken from the documents of the source in the order of a seeded hash; the document at the edge gives its first
words only.  The edge is found in two steps, so that no task sees more than 1/4096 of a source: sums by source and
hash bucket, then a running sum inside the one bucket that holds the edge.

Edge cases: a null text has size 0 and takes nothing; a very long text counts whole; a null source is a source of its own, ordered last;
documents with equal ids are ordered by their size; repeated rows count as often as they occur; an empty table
gives an empty result; a target of a source without words is 0.  Columns of ``docs`` are kept; the five that are
added win over columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornfels.llm.common import WORD, persist

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
MAX_BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size) to (source, source_size, target): one row for each source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    place = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place + 1).cast("int"))
    cap = F.col("source_size") * F.lit(int(max_epochs))
    level = F.col("_ratio") * (F.col("_w_all") - F.col("_w_below")).cast("double") + F.col("_cap_below").cast("double")
    free = (F.col("_w_all") - F.col("_w_capped")).cast("double")
    return (
        sums.withColumn("_w", weight.cast("long"))
        .withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w").cast("double"))
        .withColumn("_goal", F.sum("source_size").over(everything).cast("double") * F.lit(float(share)))
        .withColumn("_w_all", F.sum("_w").over(everything))
        .withColumn("_w_below", F.sum("_w").over(by_ratio))
        .withColumn("_cap_below", F.sum("_cap").over(by_ratio))
        .withColumn("_capped", level <= F.col("_goal"))
        .withColumn("_w_capped", F.sum(F.when(F.col("_capped"), F.col("_w")).otherwise(0)).over(everything))
        .withColumn("_cap_capped", F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(everything))
        .withColumn("_level", F.when(free > 0, (F.col("_goal") - F.col("_cap_capped").cast("double")) / F.nullif(free, F.lit(0.0))))
        .select("source", "source_size", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w").cast("double") * F.col("_level")).alias("target"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target (its source's) and taken (words the mix takes, repeats counted)."""
    added = ("size", "source_size", "target", "taken")
    docs = docs.drop(*added)
    parts = docs.select("source", F.substring(_key(seed), 1, 3).alias("_bucket"), n_words(F.col("text")).alias("_n"))
    parts = persist(parts.groupBy("source", "_bucket").agg(F.sum("_n").alias("_n")))
    goal = targets(parts.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size").cast("double"))).otherwise(0)
    goal = goal.withColumn("_whole", whole.cast("long")).withColumn("_rest", F.col("target") - (F.col("_whole") * F.col("source_size")).cast("double"))
    run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parts.withColumn("_end", F.sum("_n").over(run)).withColumnRenamed("source", "_s").alias("p")
    edge = (
        goal.alias("g")
        .join(ends, F.col("g.source").eqNullSafe(F.col("p._s")) & (F.col("_end").cast("double") > F.col("_rest")), "left")
        .groupBy("g.source", "source_size", "target", "_whole", "_rest")
        .agg(F.min(F.struct("_bucket", "_end", "_n")).alias("_e"))
        .select(F.col("source").alias("_s"), "source_size", "target", "_whole", F.col("_e._bucket").alias("_edge"), (F.col("_rest") - (F.col("_e._end") - F.col("_e._n")).cast("double")).alias("_left"))
    )
    edge = persist(edge)
    if edge.count() <= MAX_BROADCAST_SOURCES:
        edge = F.broadcast(edge)
    keyed = docs.withColumn("_k", _key(seed)).join(edge, F.col("source").eqNullSafe(F.col("_s")), "inner")
    bucket = F.substring("_k", 1, 3)
    sized = n_words(F.col("text"))
    at_edge = F.coalesce(bucket == F.col("_edge"), F.lit(False))
    order = Window.partitionBy("source", "_edge").orderBy("_k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("size").over(order) - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.floor(F.col("_left") - before.cast("double")))).cast("long")
    inside = keyed.filter(at_edge).withColumn("size", sized).withColumn("_part", part)
    outside = keyed.filter(~at_edge).withColumn("size", sized)
    outside = outside.withColumn("_part", F.when(F.col("_edge").isNull() | (bucket < F.col("_edge")), F.col("size")).otherwise(F.lit(0)).cast("long"))
    taken = F.col("_whole") * F.col("size") + F.when(F.col("_whole") >= max_epochs, 0).otherwise(F.col("_part"))
    out = outside.unionByName(inside).withColumn("taken", taken.cast("long"))
    return out.select(*docs.columns, *added)


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, the columns unchanged.

    The last, partial repetition holds the first words of the text with the white space between them.
    """
    out = mix(docs, **settings)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    lengths = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_take", F.explode(lengths))
    head = F.expr(r"array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, greatest(_take, 0)), '')")
    out = out.withColumn("text", F.when(F.col("_take") < 0, F.col("text")).otherwise(head))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_take") < 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         source_size * 2 AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS goal, sum(w) OVER () AS w_all FROM w),
b AS (
  SELECT *, sum(w) OVER (ORDER BY ratio RANGE UNBOUNDED PRECEDING) AS w_below,
         sum(cap) OVER (ORDER BY ratio RANGE UNBOUNDED PRECEDING) AS cap_below FROM r),
c AS (SELECT *, ratio * CAST(w_all - w_below AS DOUBLE) + CAST(cap_below AS DOUBLE) <= goal AS capped FROM b),
l AS (
  SELECT *, (goal - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE))
            / nullif(CAST(w_all - sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS DOUBLE), 0) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * level END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / CAST(source_size AS DOUBLE)) AS BIGINT) ELSE 0 END AS whole FROM t),
o AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - CAST(g.whole * g.source_size AS DOUBLE) AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN whole >= 2 THEN 0 ELSE least(size, greatest(0, floor(rest - CAST(before AS DOUBLE)))) END AS BIGINT) AS taken
FROM o
"""
