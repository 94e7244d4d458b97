"""LM scoring by deleted interpolation.

The model mixes maximum-likelihood estimates: ``P(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1)``, where
the weights depend on the bucket of the context's frequency c(v) (by powers of two).  They are learned by
expectation-maximisation on counts held out of the training documents: the documents of one fold are deleted from
the counts and predicted by what is left.  The EM needs the ratios of the three estimates only, so it runs on a
histogram of them over all tokens of the fold, which has a bounded number of cells.

Counts of words and word pairs grow with the corpus and are never gathered in one place.  Texts are encoded in
blocks of about ``BLOCK`` tokens.  Each block asks for the counts of its distinct words and pairs (64-bit hashes,
sorted, in packed arrays); requests are dealt by ranges of the hash, summed, and answered in the order asked.  A
word that holds a large part of all tokens is one entry of each block, so no task is skewed.  The answers return to
their block, which computes the scores of its documents.  Requests are shuffled once and never stored besides: the
blocks take the same shuffle, and the table of blocks and answers is what the later steps read.

Edge cases: a null or empty text is the end token alone; a very long text is counted and scored whole, in one block; a null id counts as the empty string for its fold; repeated
rows count and are scored each; without training tokens base_score is that of c = N = V = 0 and the model is
uniform; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.llm.common import free_shuffles, persist, release_memory

BLOCK = 600_000
HELD, FOLD, REST = 0, 1, 2
"""Held-out documents, the deleted fold of the training documents, and the others."""
CHARS_PER_BUCKET = 8_000_000
EM_STEPS = 60
_BUCKETS = 48
_STEPS = 4  # cells of the histogram for each doubling of a ratio
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """56-bit hashes: shorter gaps to pack, and a collision for one pair in some hundred thousand at 10**12 pairs."""
    return _mix(_mix(before) + word * np.uint64(0xA0761D6478BD642F)) >> np.uint64(8)


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: the upper bytes of small numbers cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def kind_of(doc_id) -> int:
    r = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10
    return HELD if r == 0 else FOLD if r == 1 else REST


class _Block:
    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.doc_ids: list = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: bytes) -> None:
        words, get = text.lower().split(), self.words.setdefault
        own = self.words
        ids = np.empty(len(words) + 1, np.uint32)
        ids[:-1] = [get(w, len(own)) for w in words]
        ids[-1] = 2**32 - 1
        self.doc_ids.append(doc_id)
        self.ids.append(ids)
        self.size += len(ids)

    def rows(self, block: int, kind: int, buckets: int) -> list[tuple]:
        """The block itself and its requests for words (1) and pairs (2), by bucket."""
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words] + [int(_END)], np.uint64)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(hashes), np.uint32)
        rank[order] = np.arange(len(hashes), dtype=np.uint32)
        flat = np.concatenate(self.ids)
        flat[flat == 2**32 - 1] = len(hashes) - 1
        flat = rank[flat]
        hashes = hashes[order]
        lengths = [len(i) for i in self.ids]
        out = [(block, kind, 0, -1, self.doc_ids, lengths, pack(flat), _pack_sorted(hashes))]
        pairs, counts = np.unique(_pairs_of(flat, hashes, lengths), return_counts=True)
        for what, bits, keys, n in ((1, 64, hashes, np.bincount(flat, minlength=len(hashes))), (2, 56, pairs, counts)):
            cuts = _cuts(keys, buckets, bits)
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    part = slice(cuts[b], cuts[b + 1])
                    out.append((block, kind, what, b, None, None, _pack_sorted(keys[part]), pack(n[part].astype(np.uint32))))
        return out


def _pairs_of(flat: np.ndarray, hashes: np.ndarray, lengths: list[int]) -> np.ndarray:
    word = hashes[flat]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum([0, *lengths[:-1]])] = _START
    return _pair_keys(before, word)


def _cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket, a range of the hash, begins in sorted keys."""
    bounds = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


_ROWS = "block long, kind int, what int, bucket int, doc_ids array<long>, lengths array<int>, a binary, b binary"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _encode(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        blocks = [_Block(), _Block(), _Block()]

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal made
            rows = blocks[kind].rows(base + made, kind, buckets)
            made += 1
            blocks[kind] = _Block()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                kind = kind_of(doc_id)
                blocks[kind].add(doc_id, text.as_py() or b"")
                if blocks[kind].size >= BLOCK:
                    yield flush(kind)
        for kind in (HELD, FOLD, REST):
            if blocks[kind].size:
                yield flush(kind)
        release_memory()

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each value of the first column in sorted input."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0][key] != row[key]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the requests of each (bucket, what) and answers each block; block -1 carries the number of distinct words.

    The blocks themselves (what 0, each in a place of its own) pass through.
    """
    for rows in _runs(batches, "place"):
        what, bucket = rows[0]["what"], rows[0]["bucket"]
        if what == 0:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(_NAMES, _TYPES)], _NAMES)
            continue
        keys = [_unpack_sorted(r["a"]) for r in rows]
        counts = [unpack(r["b"], np.uint32) for r in rows]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([0, *map(len, keys)])
        train, fold = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        for r, n, a, b in zip(rows, counts, ends[:-1], ends[1:]):
            if r["kind"] != HELD:
                train[where[a:b]] += n
            if r["kind"] == FOLD:
                fold[where[a:b]] += n
        out = [(r["block"], r["kind"], what, bucket, None, None, pack(train[where[a:b]]), pack(fold[where[a:b]]) if r["kind"] == FOLD else b"") for r, a, b in zip(rows, ends[:-1], ends[1:])]
        if what == 1:
            out.append((-1, -1, what, bucket, [int((train > 0).sum())], None, b"", b""))
        del keys, counts, every, where, train, fold
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)


class _Counts:
    """The tokens of one block with the counts c(w), c(v, w) and c(v) of each."""

    def __init__(self, rows: list[dict]):
        head = next(r for r in rows if r["what"] == 0)
        self.doc_ids, self.kind = head["doc_ids"], head["kind"]
        self.lengths = np.array(head["lengths"], np.int64)
        self.flat, hashes = unpack(head["a"], np.uint32), _unpack_sorted(head["b"])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.answers = {what: sorted((r for r in rows if r["what"] == what), key=lambda r: r["bucket"]) for what in (1, 2)}
        self.pairs = np.unique(_pairs_of(self.flat, hashes, head["lengths"]), return_inverse=True)[1]
        self.end = int(np.searchsorted(hashes, _END))

    def counts(self, deleted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def read(what: int) -> np.ndarray:
            out = np.concatenate([unpack(r["a"], np.int64) for r in self.answers[what]])
            if deleted:
                out = out - np.concatenate([unpack(r["b"], np.int64) for r in self.answers[what]])
            return out

        words = read(1)
        word = words[self.flat]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[self.starts] = words[self.end]  # as many starts as ends
        return word, read(2)[self.pairs], context


def estimates(word: np.ndarray, pair: np.ndarray, context: np.ndarray, n: int, v: int) -> tuple:
    """Bucket of the context and the three estimates, without and with weights yet to come."""
    bucket = np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), _BUCKETS - 1), 0)
    return bucket, pair / np.maximum(context, 1), word / max(n, 1), 1.0 / (v + 1)


def _cells(n: int, v: int):
    """For each block of the deleted fold, how many tokens fall in each cell of (bucket, P2 / P0, P1 / P0)."""

    def cell(ratio: np.ndarray) -> np.ndarray:
        return np.where(ratio > 0, np.round(np.log2(np.maximum(ratio, 1e-300)) * _STEPS).astype(np.int64) + 200, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "block"):
            bucket, p2, p1, p0 = estimates(*_Counts(rows).counts(True), n, v)
            cells, counts = np.unique(np.stack([bucket, cell(p2 / p0), cell(p1 / p0)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cells], pa.array(counts, pa.int64())], ["bucket", "r2", "r1", "n"])

    return run


def learn_weights(cells: list[tuple[int, int, int, int]], steps: int = EM_STEPS) -> np.ndarray:
    """Weights (l0, l1, l2) of each bucket by EM from rows (bucket, cell of P2 / P0, cell of P1 / P0, tokens)."""
    out = np.tile([0.1, 0.6, 0.3], (_BUCKETS, 1))
    out[0] = [0.2, 0.8, 0.0]
    table = np.array(cells, np.int64).reshape(-1, 4)
    for b in range(_BUCKETS):
        own = table[table[:, 0] == b]
        if not len(own):
            continue
        ratios = np.ones((len(own), 3))
        for column, cell in ((1, own[:, 2]), (2, own[:, 1])):
            ratios[:, column] = np.where(cell >= 0, 2.0 ** ((cell - 200) / _STEPS), 0.0)
        prior = np.array([0.5, 0.5, 0.5 if b else 0.0])
        weights = out[b]
        for _ in range(steps):
            joint = ratios * weights
            share = own[:, 3:] * joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
            weights = share.sum(axis=0) + prior
            weights = weights / weights.sum()
        out[b] = weights
    return out


def _score(n: int, v: int, weights: np.ndarray):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "block"):
            block = _Counts(rows)
            word, pair, context = block.counts(False)
            bucket, p2, p1, p0 = estimates(word, pair, context, n, v)
            w = weights[bucket]
            p = w[:, 2] * p2 + w[:, 1] * p1 + w[:, 0] * p0 if n else np.ones(len(word))
            known, base, score = (np.add.reduceat(x, block.starts) for x in ((word > 0).astype(np.int64), np.log10((word + 0.1) / (n + 0.1 * (v + 1))), np.log10(p)))
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array([block.kind == HELD] * len(known)), pa.array(block.lengths), pa.array(known), pa.array(base), pa.array(score)], names)

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(12, -(-chars // CHARS_PER_BUCKET))
    made = docs.mapInArrow(_encode(buckets), _ROWS)
    bucket = F.when(F.col("what") == 0, F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    place = F.when(F.col("what") == 0, F.concat_ws("/", "what", "block")).otherwise(F.concat_ws("/", "what", "bucket"))
    dealt = made.select(place.alias("place"), "block", "kind", "what", bucket.alias("bucket"), "doc_ids", "lengths", "a", "b")
    dealt = dealt.repartition(max(tasks, buckets), "what", "bucket").sortWithinPartitions("place")
    answers = persist(dealt.mapInArrow(_answer, _ROWS))
    v = answers.filter("block = -1").agg(F.sum(F.col("doc_ids")[0])).first()[0] or 0
    heads = answers.filter("what = 0")
    sizes = {r[0]: r[1] for r in heads.groupBy("kind").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).collect()}
    fold, n = sizes.get(FOLD, 0), sizes.get(FOLD, 0) + sizes.get(REST, 0)

    def blocks(condition: str) -> DataFrame:
        rows = answers.filter("block <> -1").filter(condition)
        return rows.repartition(tasks, "block").sortWithinPartitions("block")

    cells = blocks(f"kind = {FOLD}").mapInArrow(_cells(n - fold, v), "bucket long, r2 long, r1 long, n long").groupBy("bucket", "r2", "r1").agg(F.sum("n"))
    weights = learn_weights([tuple(r) for r in cells.collect()])  # a bounded number of cells
    free_shuffles(spark)  # the requests are long answered: their room is wanted for the scoring
    out = blocks("true").mapInArrow(_score(n, v, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
