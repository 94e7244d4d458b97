"""Document fingerprints by I-Match.

Terms (runs of letters and digits, A-Z lower-cased) are counted by the documents they occur in.  The lexicon holds
the terms within a band of inverse document frequency, given as shares of all documents; the lower share bounds its
size (terms with a share of at least ``low`` number at most the mean of distinct terms a document, divided by
``low``, however large the corpus is), so tasks may all hold it.  Randomised subsets of the lexicon keep each term
with a rate of their own: halves of the lexicon agree only for texts that are nearly the same, small subsets still where
half of a text has changed.  For each subset the distinct terms of a document that are in it are sorted and hashed.
The fingerprint is the row of these hashes, "0000" where a document has no term of the subset.

The likeness of two fingerprints is the share of equal hashes among the subsets of which either document has a
term.  Documents without any lexicon term are fingerprinted by a hash of all their terms, at every place, and are
like only documents with the very same one.

The edited text of a document takes its second half from the next document, in descending order of ids.  Documents
are dealt to ranges of ids; the first document of the following range is sent along with each range, so that one
sort by range is all that is needed and no task sees more than its range.

Edge cases: null text counts as empty; a very long text is fingerprinted whole; an empty document's fingerprint is that of no terms; a null id sorts last; of
rows with equal ids those with the shorter text come first; a single document is followed by itself; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.llm.common import tasks, texts

LOW, HIGH = 0.001, 0.2
RATES = ((4, 2), (16, 32), (24, 128), (24, 512))
"""Subsets and the inverse of their rate."""

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FLUSH = 400_000
DOCS_OF_A_RANGE = 2_500


def terms(text: bytes) -> set[bytes]:
    return set(text.translate(_TO_WORDS).split())


def _hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) - 2**63


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([_hash(t) for t in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])
        seen.clear()
        return out

    for batch in batches:
        for text in texts(batch.column(0)):
            seen.update(terms(text))
            if len(seen) > _FLUSH:
                yield flush()
    yield flush()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms whose share of documents lies in the band (and is at least two documents)."""
    n = docs.count()
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    rows = counts.filter((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n)).select("term").toPandas()
    return np.sort(rows["term"].to_numpy(np.int64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprinter:
    """Terms to fingerprint; membership of a term in the subsets is drawn once by a hash."""

    def __init__(self, lexicon_: np.ndarray):
        self.width = sum(n for n, _ in RATES)
        rates = np.concatenate([np.full(n, 2**64 // r, np.uint64) for n, r in RATES])
        terms_ = lexicon_.astype("<i8")
        draws = _mix(terms_.view("<u8")[:, None] ^ _mix(np.arange(1, self.width + 1, dtype=np.uint64))[None, :])
        subsets: list[list[int]] = [[] for _ in range(len(terms_))]
        for term, subset in zip(*[a.tolist() for a in np.nonzero(draws < rates[None, :])]):
            subsets[term].append(subset)
        self.entries = {h: (h.to_bytes(8, "little", signed=True), subsets[k]) for k, h in enumerate(terms_.tolist())}
        self.cache: dict[bytes, tuple | None] = {}

    def __call__(self, words: set[bytes]) -> list[str]:
        if len(self.cache) > _FLUSH:
            self.cache.clear()
        cache, members, found = self.cache, {}, False
        for w in words:
            try:
                entry = cache[w]
            except KeyError:
                entry = cache[w] = self.entries.get(_hash(w))
            if entry is not None:
                found = True
                for s in entry[1]:
                    members.setdefault(s, []).append(entry[0])
        if not found:
            whole = xxhash.xxh3_64_hexdigest(b" ".join(sorted(words)))
            return ["!" + whole[(k % 4) * 4 : (k % 4) * 4 + 3] for k in range(self.width)] if words else ["0000"] * self.width
        out = ["0000"] * self.width
        for s, hashes in members.items():
            hashes.sort()
            out[s] = "%04x" % (xxhash.xxh3_64_intdigest(b"".join(hashes), seed=s) % 65535 + 1)
        return out


def likeness(a: list[str], b: list[str]) -> float:
    """Two fingerprints without any hash are alike (1) if equal."""
    used = same = 0
    for x, y in zip(a, b):
        if x != "0000" or y != "0000":
            used += 1
            same += x == y
    return same / used if used else 1.0


@functools.lru_cache(maxsize=1)
def _fingerprinter(data: bytes) -> Fingerprinter:
    return Fingerprinter(np.frombuffer(data, "<i8"))


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data = pa.array([press(t) for t in texts(batch.column(2))], pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1)], data, *[batch.column(i) for i in (3, 4)]], ["doc_id", "bucket", "data", "is_next", "size"])


def _pairs(lexicon_: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, fingerprint = zstandard.ZstdDecompressor().decompress, _fingerprinter(lexicon_)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        last = None
        for batch in batches:
            rows = []
            for doc_id, bucket, data, is_next in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if last is not None and last[1] == bucket and last[4]:
                    continue  # further rows that tie as the next range's first
                raw = unpress(data)
                text = raw.decode()
                now = (doc_id, bucket, text, fingerprint(terms(raw)), is_next)
                if last is not None and last[1] == bucket:
                    before = last[2]
                    half = len(before) // 2
                    edited = (before[: len(before) - half] + text[:half]).encode()
                    changed = fingerprint(terms(edited))
                    rows.append((last[0], len(before), hashlib.sha256(edited).hexdigest(), "".join(last[3]), "".join(changed), likeness(last[3], changed), likeness(last[3], now[3])))
                last = now
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names)

    return run


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, bucket, data, is_next, size) sorted for :func:`_pairs`: each range of ids, then its next document."""
    spark = docs.sparkSession
    place = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_o", place)
    cuts = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = sorted({-c for c in cuts})
    if len(cuts) > 0:  # descending ids: ascending negatives; nulls come last
        cutter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_x", outputCol="_b", handleInvalid="keep")
        docs = cutter.transform(docs.withColumn("_x", -F.col("doc_id").cast("double"))).withColumn("bucket", F.col("_b").cast("int")).drop("_x", "_b")
    else:
        docs = docs.withColumn("bucket", F.col("doc_id").isNull().cast("int"))
    firsts = docs.groupBy("bucket").agg(F.max("_o").alias("first")).orderBy("bucket").collect()  # a row for each range
    sent = [(firsts[(k + 1) % len(firsts)]["first"], r["bucket"]) for k, r in enumerate(firsts)]
    to = spark.createDataFrame([(f, b, True) for f, b in sent], "_o long, bucket int, is_next boolean")
    own = docs.withColumn("is_next", F.lit(False))
    lent = docs.drop("bucket").join(F.broadcast(to), "_o")
    rows = own.unionByName(lent.select(*own.columns)).select("doc_id", "bucket", F.coalesce("text", F.lit("")).alias("text"), "is_next", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    rows = rows.mapInArrow(_compress, "doc_id long, bucket int, data binary, is_next boolean, size int")
    return rows.repartition(max(ranges, 1), "bucket").sortWithinPartitions("bucket", "is_next", F.col("doc_id").desc_nulls_last(), "size", "data")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ranges = ranges or tasks(docs.count(), DOCS_OF_A_RANGE)
    return with_next(docs, ranges).mapInArrow(_pairs(lexicon(docs, low, high).astype("<i8").tobytes()), SCHEMA)
