"""MinHash near-duplicates with odd sketches, linked exactly.

1. Each document becomes the set of its distinct word shingles (64-bit hashes).  Documents with equal sets are one
   class; only the smallest id of each class goes on.
2. 128 MinHash samples give 32 bands of four (two sets of similarity 0.8 share no band with a chance of 5e-8) and an
   odd sketch: each sample flips one of 512 bits, so the population count of the XOR of two sketches estimates how
   many samples differ.  Within a band bucket only pairs whose estimate is 0.6 or more, five standard errors below
   the threshold, are candidates.
3. Round one confirms for each document its most similar earlier one of each bucket, large buckets in salted parts
   that share their first document.  A link is confirmed on the full sets, from the texts.
4. Confirmed links give components.  Buckets whose documents lie in one component are done.  In each other bucket
   the documents outside its largest component are compared with all others of the bucket that are candidates, each
   pair in the first bucket that both share, in square blocks of bounded size.  The documents that take part bring
   their texts, links are confirmed on the full sets inside the task, and pairs that it has joined already are
   skipped.  So no link between components is lost, and pairs are never listed.

Rows of a hot bucket are split over tasks; links, components and sketches stay in distributed tables.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; a text with fewer
words than a shingle is one shingle of all of them; a null id takes no part and is kept with a null component;
rows with an equal id are one document that links if any of its texts does, and all get its component (one of them
without shingles too); a very long text is sketched and compared whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.llm.common import forget, in_slices, persist, release_memory, tasks, texts
from hornfels.llm.components import connected_components

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BITS = 512
LEAST = 0.6
"""Of the estimate."""
PART = 1000
"""Documents of a bucket compared in one task."""
MAX_BROADCAST = 50_000
ROWS_OF_A_TASK = 500_000
"""Of (band, document)."""

_RNG = np.random.default_rng(20240)
_SEEDS = _RNG.integers(0, 2**32, (SAMPLES, 1), dtype=np.uint32)
_ODD = _RNG.integers(0, 2**31, (SAMPLES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FACTORS = [np.uint64(int(x) | 1) for x in _RNG.integers(2**60, 2**63, 8)]
_SLOT = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words."""
    words = text.lower().split()
    if len(_words) > 100_000:
        _words.clear()
    known, digest, hashes = _words, xxhash.xxh3_64_intdigest, []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        hashes.append(h)
    if not hashes:
        return np.empty(0, np.uint64)
    h = np.array(hashes, np.uint64)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _FACTORS[0] + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        x = (low[None, at : at + 1024] ^ _SEEDS) * _ODD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> bytes:
    slots = _mix(samples.astype(np.uint64) << np.uint64(32) | _SLOT.astype(np.uint64)) % np.uint64(BITS)
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=BITS) & 1).tobytes()


def _largest_count() -> int:
    """XOR population count at which the estimated similarity is ``LEAST``."""
    differing = 2 * SAMPLES * (1 - LEAST)
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** differing))


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            counts, keys, bands, odds = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingle_set(text, size)
                counts.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), odds.append(None)
                    continue
                samples = min_hashes(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                grouped = samples.reshape(BANDS, ROWS).astype(np.uint64)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    key = _mix(key * _FACTORS[k + 1] + grouped[:, k])
                bands.append(key.view(np.int64))
                odds.append(odd_sketch(samples))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odds, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "bands", "odd"],
            )
        release_memory()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Each group of two or more rows of a table sorted by its first ``n_keys`` columns."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        table = table.combine_chunks()
        keys = np.stack([table.column(k).to_numpy() for k in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = np.concatenate([[0], cuts])
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                yield table.slice(a, b - a)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(table.num_rows, -1)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a bucket its most similar earlier one (a, b), and (a, a) for each that has a candidate."""
    limit = _largest_count()
    out: set[tuple[int, int]] = set()
    for table in _grouped(batches, 2):
        ids, x = table.column("rep").to_numpy(), _sketches(table)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        marked = np.zeros(len(ids), bool)
        for at in range(0, len(ids), 256):
            own = np.arange(at, min(at + 256, len(ids)))
            counts = np.bitwise_count(x[own][:, None, :] ^ x[None, : own[-1] + 1, :]).sum(axis=2, dtype=np.int64)
            counts[np.arange(own[-1] + 1)[None, :] >= own[:, None]] = BITS
            near = counts <= limit
            marked[own] |= near.any(axis=1)
            marked[: own[-1] + 1] |= near.any(axis=0)
            best = counts.argmin(axis=1)
            for k in np.flatnonzero(near.any(axis=1)):
                if ids[own[k]] != ids[best[k]]:
                    out.add((int(ids[own[k]]), int(ids[best[k]])))
        out.update((int(i), int(i)) for i in ids[marked])
        if len(out) > 200_000:
            yield _edge_batch(out)
            out.clear()
    yield _edge_batch(out)


def _edge_batch(out: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def _cross_pairs(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each outsider row of a bucket the rows that it is to be compared with.

    These belong to other components, have an estimate of ``LEAST`` or more and share no earlier band with it, so
    that each pair is met in one bucket only.
    """
    limit = _largest_count()
    ids, x, component = table.column("rep").to_numpy(), _sketches(table), table.column("component").to_numpy()
    k = table.column("k")[0].as_py()
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
    role, outsider = table.column("role").to_numpy(), table.column("outsider").to_numpy(zero_copy_only=False)
    own = np.flatnonzero(role == 0)
    for row in np.flatnonzero(role == 1):
        near = own[np.bitwise_count(x[own] ^ x[row]).sum(axis=1, dtype=np.int64) <= limit]
        near = near[(component[near] != component[row]) & (~outsider[near] | (ids[near] > ids[row]))]
        if len(near):
            near = near[(bands[near] == bands[row]).argmax(axis=1) == k]
        if len(near):
            yield row, near


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket that take part in a comparison."""
    for table in _grouped(batches, 2):
        wanted = np.zeros(table.num_rows, bool)
        for row, near in _cross_pairs(table):
            wanted[row] = True
            wanted[near] = True
        if wanted.any():
            yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()


def _across(size: int, threshold: float):
    """Confirmed links between components, at most one for each two components of a bucket part."""
    hundredths = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for table in _grouped(batches, 2):
            ids, component = table.column("rep").to_numpy(), table.column("component").to_numpy()
            data, sets = table.column("data"), {}
            parent: dict[int, int] = {}
            out: set[tuple[int, int]] = set()

            def root(c: int, parent=parent) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            def shingles(row: int, sets=sets, data=data) -> np.ndarray:
                if row not in sets:
                    sets[row] = shingle_set(unpress(data[row].as_py()), size)
                return sets[row]

            for row, near in _cross_pairs(table):
                for other in near.tolist():
                    c, d = root(int(component[row])), root(int(component[other]))
                    if c != d and _linked(shingles(int(row)), shingles(other), hundredths):
                        parent[max(c, d)] = min(c, d)
                        out.add((int(ids[row]), int(ids[other])))
            if out:
                yield _edge_batch(out)
        release_memory()

    return run


def _linked(a: np.ndarray, b: np.ndarray, hundredths: int) -> bool:
    small, large = sorted((a, b), key=len)
    if len(large) * hundredths > len(small) * 100:
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= hundredths * (len(a) + len(b) - both)


def _confirm(size: int, threshold: float):
    hundredths = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                linked.append(_linked(shingle_set(unpress(x), size), shingle_set(unpress(y), size), hundredths))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())], ["a", "b", "linked"])
        release_memory()

    return run


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in in_slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(t) for t in texts(batch.column(1))], pa.binary())], ["doc_id", "data"])


def _small(df: DataFrame) -> DataFrame:
    """A persisted table, marked for broadcast only if it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sketches = persist(docs.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, set_key binary, bands array<long>, odd binary"))
    taking = sketches.filter("set_key is not null and doc_id is not null")
    reps = persist(taking.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("odd").alias("odd")))
    n = tasks(reps.count() * BANDS, ROWS_OF_A_TASK)

    # round one: the nearest earlier document of each bucket, large buckets in parts
    rows = reps.select(F.explode("bands").alias("band"), "rep", "odd")
    large = persist(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).filter(F.col("n") > PART).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    if large.isEmpty():
        parts = rows.withColumn("part", F.lit(0))
    else:
        firsts = large.join(reps.select("rep", "odd"), F.col("first") == F.col("rep")).select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "odd")
        rows = rows.join(_small(large.select("band", "parts", "first")), "band", "left").filter("first is null or first <> rep")
        rows = rows.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int"))
        parts = rows.select("band", "part", "rep", "odd").unionByName(firsts.select("band", "part", "rep", "odd"))
    parts = parts.select("band", F.col("part").cast("long").alias("part"), "rep", "odd")
    found = parts.repartition(n, "band", "part").sortWithinPartitions("band", "part").mapInArrow(_nearest, "a long, b long")
    found = persist(found.distinct())
    vertices = found.select(F.col("a").alias("doc_id")).unionByName(found.select(F.col("b").alias("doc_id")))
    if not large.isEmpty():
        hot = reps.select("rep", F.explode("bands").alias("band")).join(_small(large.select("band")), "band", "left_semi")
        vertices = vertices.unionByName(hot.select(F.col("rep").alias("doc_id")))
    vertices = persist(vertices.distinct())
    wanted = docs.filter("doc_id is not null").mapInArrow(_press, "doc_id long, data binary").join(vertices.hint("shuffle_hash"), "doc_id", "left_semi")
    data = persist(wanted.dropDuplicates(["doc_id", "data"]))

    def confirm(pairs: DataFrame) -> DataFrame:
        near = pairs.join(data.withColumnRenamed("data", "x").hint("merge"), F.col("a") == F.col("doc_id")).drop("doc_id")
        both = near.join(data.withColumnRenamed("data", "y").hint("merge"), F.col("b") == F.col("doc_id")).select("a", "b", "x", "y")
        return both.mapInArrow(_confirm(shingle, threshold), "a long, b long, linked boolean").filter("linked").select("a", "b")

    of_class = connected_components(confirm(found.filter("a <> b")).unionByName(_same_document(taking, reps)))
    near_rows = reps.join(vertices, F.col("rep") == F.col("doc_id"), "left_semi").select("rep", "bands", "odd")
    # round two: buckets that hold several components
    placed = near_rows.join(of_class, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    placed = persist(placed.select("rep", "odd", "bands", "component"))
    narrow = placed.select("rep", "component", F.posexplode("bands").alias("k", "band"))
    counts = narrow.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    active = counts.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("c"))
    parts_of = [F.ceil(c / PART).cast("int").alias(name) for c, name in ((F.col("n"), "parts"), (F.col("n") - F.col("most"), "out_parts"))]
    active = persist(active.filter("c > 1").select("band", "largest", *parts_of))
    mixed = narrow.join(_small(active), "band").withColumn("outsider", F.col("component") != F.col("largest"))
    part, out_part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.pmod(F.hash("rep"), F.col("out_parts")).cast("int")
    own = mixed.withColumn("role", F.lit(0)).withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("out_parts") - 1), lambda j: part * F.col("out_parts") + j)))
    outside = mixed.filter("outsider").withColumn("role", F.lit(1))
    outside = outside.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i * F.col("out_parts") + out_part)))
    columns = ["band", "part", "rep", "k", "outsider", "role"]
    mixed = own.select(*columns).unionByName(outside.select(*columns)).withColumn("part", F.col("part").cast("long"))
    mixed = mixed.join(placed, "rep").select(*columns, "component", "odd", "bands")
    schema = mixed.schema
    partners = persist(mixed.repartition(n, "band", "part").sortWithinPartitions("band", "part").mapInArrow(_partners, schema))
    with_data = partners.join(data.hint("merge"), F.col("rep") == F.col("doc_id")).drop("doc_id")
    fresh = with_data.repartition(n, "band", "part").sortWithinPartitions("band", "part").mapInArrow(_across(shingle, threshold), "a long, b long")
    fresh = persist(fresh.distinct())
    if not fresh.isEmpty():
        label, links = of_class.select("node", "component"), fresh
        for end in ("a", "b"):
            links = links.join(label.select(F.col("node").alias(end), F.col("component").alias("c_" + end)), end, "left").withColumn("c_" + end, F.coalesce("c_" + end, end))
        merged = persist(connected_components(links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))))
        to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
        alone = merged.join(label, "node", "left_anti").select("node", "component")
        of_class = persist(label.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(alone).distinct())
    component = reps.select("set_key", "rep").join(of_class, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    component = persist(component)
    forget(reps, large, found, vertices, data, placed, active, partners, fresh)
    out = sketches.select("doc_id", "n_shingles", "set_key").join(component.hint("merge"), "set_key", "left")
    # a row without shingles goes with the other rows of its id
    empty = sketches.filter("set_key is null and doc_id is not null").select("doc_id").distinct()
    others = taking.join(empty.hint("merge"), "doc_id", "left_semi").join(component, "set_key").groupBy("doc_id").agg(F.min("component").alias("other"))
    others = others.withColumnRenamed("doc_id", "_id")
    out = out.join(others, (F.col("doc_id") == F.col("_id")) & F.col("set_key").isNull(), "left")
    component_id = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "other")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def _same_document(taking: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of the texts of one id."""
    several = taking.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x <> y").select("doc_id")
    texts_ = taking.select("doc_id", "set_key").join(several.hint("merge"), "doc_id", "left_semi").join(reps.select("set_key", "rep"), "set_key")
    first = texts_.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return texts_.join(first, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.  Rows with a null id stay."""
    drop = near_duplicates(docs, shingle, threshold).filter("not kept").select("doc_id").distinct()
    # the ids are hashed and the texts stream past them, unsorted; the plan does not depend on sizes
    return docs.join(persist(drop).hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
