"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents are encoded, given an end id and cut into pieces of at most ``capacity`` tokens.  A piece goes into the open
bin of the gap g for which the sum of the squared numbers of open bins per residual gap becomes smallest: it changes
by ``2 (N[g - s] - N[g]) + 2``, 1 less if the bin is filled; ties go to the smallest gap.  Only where no open bin
holds the piece is a new one begun.  Each shard is packed twice and the better result taken: longest pieces first, and
with the pieces of a tenth of the capacity or more in a seeded random order before the smaller ones, longest first.
(The first is better for pieces around half the capacity, the second for those just under a third.)

Shards are of about ``SHARD`` pieces and drawn by a hash, so each has the length distribution of the whole and one
task packs it; their number grows with the input.  Each shard wastes a few sequences at most, one in thousands.
Only lengths and digests are shuffled.  Encoded pieces are written to the shared scratch folder once.

Edge cases: null and empty texts are one piece that holds the end id; a text of any length is encoded whole and
cut into as many pieces as it needs; repeated rows are packed each; an empty
table gives an empty result; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.llm.common import bucket_of, in_slices, persist, release_memory
from hornfels.llm.tokens import default_path, encoder, groups

CAPACITY = 4096
END_ID = 1
SHARD = 40_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with ``with_ids`` also its ids (binary, little-endian unsigned 32-bit)."""
    path = path or default_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    step = capacity * 4
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, True).encode
        for batch in in_slices(batches):
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts):
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], encode(texts[a:b])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        release_memory()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, _PIECES + ", ids binary" * with_ids)


def _place(lengths: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins = np.zeros(capacity + 1, np.int64)  # number of open bins by gap; gaps 0 and capacity do not count
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for item in order.tolist():
        s = int(lengths[item])
        gap = capacity
        if s < capacity:
            there = open_bins[s:capacity]
            change = 2 * (open_bins[: capacity - s] - there)
            change[0] -= 1  # a filled bin leaves the sum
            change[there == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if there[k]:
                gap = s + k
        if gap < capacity:
            b = by_gap[gap].pop()
            open_bins[gap] -= 1
        else:
            b, made = made, made + 1
        bins[item], offsets[item] = b, capacity - gap
        if gap > s:
            by_gap[gap - s].append(b)
            open_bins[gap - s] += 1
    return bins, offsets, made


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, by the sum-of-squares rule, in the order that needs fewer bins."""
    order = np.argsort(-lengths, kind="stable")
    out = _place(lengths, order, capacity)
    if out[2] > -(-int(lengths.sum()) // capacity):  # else no order can do better
        large = int((lengths * 10 >= capacity).sum())
        order[:large] = np.random.default_rng(7).permutation(order[:large])
        out = min(out, _place(lengths, order, capacity), key=lambda o: o[2])
    return out[:2]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (a persisted table with a column length) with sequence_id and offset."""
    n = parts.filter(F.col("length") < capacity).count()
    shards = -(-n // SHARD) or 1
    full = parts.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = parts.filter(F.col("length") < capacity)
    short = short.withColumn("_shard", bucket_of(F.struct(F.col("doc_id"), F.col("piece")), shards))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"

    def one(table: pa.Table) -> pa.Table:
        shard = table.column("_shard")[0].as_py()
        table = table.drop_columns(["_shard"]).sort_by([(c, "ascending") for c in ("length", "doc_id", "piece")])
        bins, offsets = pack_lengths(table.column("length").to_numpy(), capacity)
        return table.append_column("sequence_id", pa.array((shard << 32) + bins)).append_column("offset", pa.array(offsets))

    return short.groupBy("_shard").applyInArrow(one, schema).unionByName(full)


def best_fit_pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(persist(pieces(docs, path, capacity, end_id)), capacity)
