"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integer vectors; a dimension is a term, its component the term's weight.  The largest and the smallest
weight of every term in a set of rows, summed over the terms of a query (largest for its positive weights, smallest
for negative ones), bound every score in the set.  Bounds prune at two levels:

* Rows are dealt to groups by their best of at most ``PIVOTS`` pivots, a bounded sample of the rows (any choice gives
  right results), large groups in shards.  The groups' extreme weights are few and go to all tasks.  Each query visits
  groups from the highest bound down in rounds, first one, then those up to the 4th, the 16th and so on.  After each
  round its kth score so far is a floor: it goes only to groups whose bound reaches it, and brings back only rows that
  do, so a few times k rows a round however many groups there are.
* In a shard, rows are put in an order that brings similar ones together and cut into blocks.  A query visits blocks
  from the highest bound down, scores them through their forward index (the rows of the block), and stops when the
  next bound falls below its kth score or its floor.

No result can be lost: a set is skipped only when its bound is below the kth score, ties included.  Queries of a shard
are dealt to chunks, and memory of a task is bounded by the sizes of a shard and a chunk; a window over each query's
rows merges them.

Edge cases: a vector that is null, or holds a null or a non-finite component, takes no part; vectors are compared
with those of equal length only; ties go to the smaller vec_id; a row never meets itself, but equal rows with other
or repeated ids do meet; fewer than k candidates give fewer rows; an empty table gives an empty result; scores are
exact while they fit in a long; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornfels.llm.common import persist

SCALE = 64
K = 20
SHARD = 12_000
CHUNK = 8_000
BLOCK = 128
PIVOTS, PIVOT_CELLS = 1024, 2**20
"""Most pivots, and most components of all of them."""
ROWS_OF_A_PIVOT = 2_000


def _vectors(every: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, queries, data = [], [], [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                if vec_id is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = np.floor(vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    dims.append(len(x))
                    queries.append(vec_id % every == 0)
                    data.append(x.astype("<f8").tobytes() if len(x) and np.abs(x).max() >= 2**15 else x.astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(queries, pa.bool_()), pa.array(data, pa.binary())], ["vec_id", "dim", "is_query", "data"])

    return run


def _matrix(column, dim: int) -> np.ndarray:
    rows = [np.frombuffer(v, "<i2") if len(v) == 2 * dim else np.frombuffer(v, "<f8") for v in column.to_pylist()]
    return np.array(rows, np.float64).reshape(len(rows), dim)


def search_shard(ids: np.ndarray, uids: np.ndarray, x: np.ndarray, query_uids: np.ndarray, q: np.ndarray, k: int = K, block: int = BLOCK, floor: np.ndarray | None = None):
    """(query number, row number, score) of the k best rows for each query, the query's own row left out.

    floor: least score of each query's rows that matters.
    """
    n, nq = len(x), len(q)
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    x, q = x.astype(kind), q.astype(kind)
    pivots = x[np.linspace(0, n - 1, min(n, max(1, n // block))).astype(int)]
    near = np.empty(n, np.int64)
    for at in range(0, n, 2048):
        near[at : at + 2048] = (x[at : at + 2048] @ pivots.T).argmax(axis=1)
    order = np.lexsort((ids, near))
    ids, uids, x = ids[order], uids[order], x[order]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((uids, ids))] = np.arange(n)  # ties: the smaller id first
    starts = np.arange(0, n, block)
    largest, smallest = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    out = []
    for a in range(0, nq, 1024):
        part, own = q[a : a + 1024], query_uids[a : a + 1024]
        bound = np.maximum(part, 0) @ largest.T + np.minimum(part, 0) @ smallest.T
        visit = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((len(part), k), -np.inf if kind != np.int64 else np.iinfo(np.int64).min, kind)
        rows = np.full((len(part), k), -1, np.int64)
        least = best[:, -1].copy() if floor is None else np.maximum(best[:, -1], floor[a : a + 1024].astype(kind))
        for step in range(len(starts)):
            at = visit[:, step]
            alive = np.flatnonzero(bound[np.arange(len(part)), at] >= least)
            if not len(alive):
                break
            alive = alive[np.argsort(at[alive], kind="stable")]
            for group in np.split(alive, np.flatnonzero(np.diff(at[alive])) + 1):
                lo = at[group[0]] * block
                score = part[group] @ x[lo : lo + block].T
                number = np.arange(lo, lo + score.shape[1])
                hopeful = (score >= least[group, None]) & (uids[number][None, :] != own[group][:, None])
                for g in np.flatnonzero(hopeful.any(axis=1)):
                    r = group[g]
                    s = np.concatenate([best[r][rows[r] >= 0], score[g][hopeful[g]]])
                    m = np.concatenate([rows[r][rows[r] >= 0], number[hopeful[g]]])
                    keep = np.lexsort((rank[m], -s))[:k]
                    best[r, : len(keep)], rows[r, : len(keep)] = s[keep], m[keep]
                    least[r] = max(least[r], best[r, -1])
        r, c = np.nonzero(rows >= 0)
        out.append((r + a, order[rows[r, c]], best[r, c].astype(np.int64)))
    return [np.concatenate(p) for p in zip(*out)] if out else [np.empty(0, np.int64)] * 3


class Groups:
    """The pivots of each length of vectors, and later the extreme weights of their groups."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.extremes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The pivot of each row, -1 where its length has none."""
        pivots = self.pivots.get(x.shape[1])
        if pivots is None:
            return np.full(len(x), -1)
        return (x @ pivots.T - 0.5 * (pivots * pivots).sum(axis=1)).argmax(axis=1)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the groups, and for each query a bound of the scores in each."""
        own = self.extremes.get(q.shape[1])
        if own is None:
            return np.array([-1]), np.full((len(q), 1), np.inf)
        numbers, largest, smallest = own
        out = np.maximum(q, 0) @ largest.T + np.minimum(q, 0) @ smallest.T
        return numbers, out + np.abs(out) * 1e-9  # scores beyond 2**53 are rounded


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of a batch with columns dim and data."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _matrix(batch.column("data").take(pa.array(at)), int(dim))


def _assign(groups: Groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = np.full(batch.num_rows, -1, np.int32)
            for _, at, x in _by_length(batch):
                pivot[at] = groups.nearest(x)
            yield batch.append_column("pivot", pa.array(pivot))

    return run


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Largest and smallest weights of each group in a task, -1 left out."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        pivots = batch.column("pivot").to_numpy()
        for dim, at, x in _by_length(batch):
            for p in np.unique(pivots[at]):
                if p >= 0:
                    own = x[pivots[at] == p]
                    now = np.stack([own.max(axis=0), -own.min(axis=0)]) if dim else np.zeros((2, 0))
                    held[dim, int(p)] = np.maximum(held[dim, int(p)], now) if (dim, int(p)) in held else now
    rows = [(d, p, x.astype("<f8").tobytes()) for (d, p), x in held.items()]
    yield _extreme_rows(rows)


def _extreme_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.int32(), pa.binary()))], ["dim", "pivot", "x"])


def _merge(table: pa.Table) -> pa.Table:
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), "<f8").reshape(table.num_rows, -1).max(axis=0)
    return pa.Table.from_batches([_extreme_rows([(table.column("dim")[0].as_py(), table.column("pivot")[0].as_py(), x.tobytes())])])


def _visits(groups: Groups, first: int, last: int):
    """For each query its groups from the ``first`` to before the ``last`` highest bound, if they reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            out: list[list[int]] = [[]] * batch.num_rows
            for _, at, q in _by_length(batch):
                numbers, bound = groups.bounds(q)
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                reach = np.take_along_axis(bound, order, axis=1) >= floor[at, None].astype(np.float64)
                for k, own, there in zip(at.tolist(), order, reach):
                    out[k] = numbers[own[there]].tolist()
            yield batch.append_column("pivots", pa.array(out, pa.list_(pa.int32())))

    return run


def _pair(k: int, block: int):
    """The best rows of each query of a chunk in a shard, of those that reach its floor."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_uid", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        dim = left.column("dim")[0].as_py()
        ids, uids = left.column("vec_id").to_numpy(), left.column("uid").to_numpy()
        query_uids = right.column("uid").to_numpy()
        r, c, s = search_shard(ids, uids, _matrix(left.column("data"), dim), query_uids, _matrix(right.column("data"), dim), k, block, right.column("floor").to_numpy())
        return pa.table([query_uids[r], right.column("vec_id").to_numpy()[r], ids[c], s], names)

    return run


_FOUND = "query_uid long, query_id long, vec_id long, score long"
_LOWEST = -(2**63)


def top_k(vectors: DataFrame, every: int = 20, k: int = K, scale: int = SCALE, shard: int = SHARD, chunk: int = CHUNK, block: int = BLOCK, rows_of_a_pivot: int = ROWS_OF_A_PIVOT) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest scores of each row whose vec_id is divisible by ``every``."""
    schema = "vec_id long, dim int, is_query boolean, data binary"
    made = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_vectors(every, scale), schema)
    made = persist(made.withColumn("uid", F.monotonically_increasing_id()))
    n, longest = made.agg(F.count(F.lit(1)), F.max("dim")).first()
    few = max(1, min(n // rows_of_a_pivot, PIVOTS, PIVOT_CELLS // max(1, longest or 1)))
    sample = made.orderBy(F.xxhash64("uid"), "uid").select("dim", "data").limit(few).toArrow()  # a bounded sample
    pivots: dict[int, list[bytes]] = {}
    for dim, data in zip(sample.column("dim").to_pylist(), sample.column("data").to_pylist()):
        pivots.setdefault(dim, []).append(data)
    groups = Groups({d: _matrix(pa.array(x, pa.binary()), d) for d, x in pivots.items()})
    rows = persist(made.mapInArrow(_assign(groups), schema + ", uid long, pivot int"))
    partial = rows.select("dim", "data", "pivot").mapInArrow(_extremes, "dim int, pivot int, x binary")
    for dim, pivot, x in sorted(partial.groupBy("dim", "pivot").applyInArrow(_merge, "dim int, pivot int, x binary").collect()):  # a row for each pivot at most
        groups.extremes.setdefault(dim, []).append((pivot, np.frombuffer(x, "<f8").reshape(2, dim)))
    groups.extremes = {d: (np.array([p for p, _ in own], np.int32), np.array([x[0] for _, x in own]), -np.array([x[1] for _, x in own])) for d, own in groups.extremes.items()}
    sizes = persist(rows.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards")))
    group, key = ["dim", "pivot"], ["dim", "pivot", "shard"]
    rows = rows.join(sizes, group).withColumn("shard", F.pmod(F.xxhash64("uid"), F.col("shards")).cast("int"))

    def search(queries: DataFrame) -> DataFrame:
        """queries: rows with dim, pivot and shard, several for one query where it visits several shards."""
        chunks = persist(queries.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")))
        left = rows.join(chunks, key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        right = queries.join(chunks, key).withColumn("chunk", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("chunks")).cast("int"))
        left = left.select(*key, "chunk", "vec_id", "uid", "data").groupBy(*key, "chunk")
        right = right.select(*key, "chunk", "vec_id", "uid", "data", "floor").groupBy(*key, "chunk")
        return left.cogroup(right).applyInArrow(_pair(k, block), _FOUND)

    query_schema = "vec_id long, uid long, dim int, data binary, floor long"
    queries = made.filter("is_query").select("vec_id", "uid", "dim", "data")
    best = made.sparkSession.createDataFrame([], _FOUND)
    place = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    most = max([1, *(len(own[0]) for own in groups.extremes.values())])
    first, last = 0, 1
    while first < most:
        floors = best.groupBy(F.col("query_uid").alias("uid")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        known = queries.join(floors, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(_LOWEST)))
        visits = known.select("vec_id", "uid", "dim", "data", "floor").mapInArrow(_visits(groups, first, last), query_schema + ", pivots array<int>")
        visits = persist(visits.withColumn("pivot", F.explode("pivots")).drop("pivots"))
        first, last = last, 4 * last
        if visits.isEmpty():  # bounds fall from round to round
            break
        now = visits.join(sizes, group).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
        merged = best.unionByName(search(now)).withColumn("rank", place).filter(F.col("rank") <= k)
        best = persist(merged.drop("rank"))
    return best.withColumn("rank", place).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
