"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each document becomes a vector of transformed statistics of its whole text (logarithms, logits and roots of counts
and shares).  Class means and covariances come from sums that each task adds up over the labelled documents, so all
labels count and only one small row a task and class leaves the executors.  A class covariance is shrunk towards
the pooled one and that towards its diagonal: ``(1 - a) S_c + a ((1 - b) P + b diag P) + c I``.  A document's score
is the logistic function of the difference of the class log densities, each from a Mahalanobis distance through the
cached Cholesky factor, tempered for the correlation of the statistics, plus the difference of log priors.

The statistics are computed once, written to the shared scratch folder, and read for fitting and for scoring.

Edge cases: null and empty texts have the statistics of an empty text and are scored; very long texts are measured whole; labels that are null are
skipped; of several labels of a document each counts; without labelled documents of both classes every score is
0.5; repeated rows are scored each; a null id has no label and counts as held in by its remainder (the crc32 of the
empty string); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from hornfels.llm.common import in_slices, persist, release_memory, texts

TO_POOLED, TO_DIAGONAL, RIDGE, TEMPER = 0.15, 0.05, 1e-3, 0.5

_KIND = np.zeros(256, np.int64)  # 0 other letter or byte, 1 upper case, 2 lower case, 3 digit, 4 space, 5 line end, 6 plain punctuation, 7 symbol
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 4, 5
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _KIND[_c] = 6 if chr(_c) in ".,;:'\"?-()" else 7
_N = 18


def _logit(share: float) -> float:
    share = min(max(share, 0.0), 1.0)
    return float(np.log((share + 0.01) / (1.01 - share)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text."""
    size = max(1, len(text))
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8).astype(float) if text else np.zeros(8)
    letters = max(1.0, kinds[0] + kinds[1] + kinds[2])
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    top = counts.most_common(1)[0][1] if counts else 0
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    single = sum(1 for w in words if len(w) == 1)
    symbol = sum(1 for w in words if _KIND[w[-1]] == 7)
    parts = kinds[kinds > 0] / size
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        _logit(kinds[1] / letters),
        _logit(kinds[3] / size),
        _logit(kinds[6] / size),
        _logit(kinds[7] / size),
        _logit(kinds[4] / size),
        float(np.log((len(counts) + 1) / np.sqrt(n + 1))),
        _logit(len(counts) / n),
        _logit(top / n),
        _logit(repeats / n),
        _logit(len(set(lines)) / n_lines),
        float(np.log1p(n / n_lines)),
        _logit(single / n),
        _logit(symbol / n),
        float(-(parts * np.log(parts)).sum()),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        data = [np.array(statistics(t), "<f8").tobytes() for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(data, pa.binary())], ["doc_id", "x"])
    release_memory()


@F.arrow_udf(returnType=BinaryType())
def _statistics_of(column: pa.Array) -> pa.Array:
    return pa.array([np.array(statistics(t or b""), "<f8").tobytes() for t in column.cast(pa.binary()).to_pylist()], pa.binary())


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the packed statistics."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_statistics, "doc_id long, x binary")


def remainder(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f8").reshape(-1, _N)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                z = np.hstack([np.ones(((y == label).sum(), 1)), x[y == label]])
                sums[label] = sums.get(label, 0) + z.T @ z
    rows = [(k, v.ravel().tolist()) for k, v in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["label", "m"])


class Model:
    """Means, Cholesky factors and constants of the two classes."""

    def __init__(self, moments: dict[int, np.ndarray]):
        self.classes = []
        counts = {k: m[0, 0] for k, m in moments.items() if m[0, 0] > 0}
        if len(counts) < 2:
            return
        means = {k: moments[k][0, 1:] / counts[k] for k in counts}
        scatter = {k: moments[k][1:, 1:] - counts[k] * np.outer(means[k], means[k]) for k in counts}
        pooled = sum(scatter.values()) / sum(counts.values())
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
        for k in (0, 1):
            a = max(TO_POOLED, _N / (_N + counts[k]))
            cov = (1 - a) * scatter[k] / counts[k] + a * pooled + RIDGE * np.eye(_N)
            factor = np.linalg.cholesky(cov)
            inverse = np.linalg.inv(factor)
            self.classes.append((means[k], inverse, -float(np.log(np.diag(factor)).sum()), float(np.log(counts[k] / sum(counts.values())))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5)
        log = []
        for mean, inverse, constant, prior in self.classes:
            z = (x - mean) @ inverse.T
            log.append(TEMPER * (constant - 0.5 * (z * z).sum(axis=1)) + prior)
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


@functools.lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    return pickle.loads(data)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Sums over all labelled documents of ``labels`` (doc_id, quality)."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1))
    rows = stats.join(labels, "doc_id").select("x", "quality").mapInArrow(_moments, "label int, m array<double>")
    sums = rows.select("label", F.posexplode("m").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v")).collect()  # 2 x 19 x 19 rows
    moments = {label: np.zeros((_N + 1) ** 2) for label in (0, 1)}
    for r in sums:
        moments[r["label"]][r["k"]] = r["v"]
    return Model({k: m.reshape(_N + 1, _N + 1) for k, m in moments.items()})


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    data = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(data)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f8").reshape(-1, _N)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(x))], ["doc_id", "score"])

    out = stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels of documents whose crc32 remainder by 3 is not 1, and score every document."""
    stats = persist(document_statistics(docs))
    return score(stats, fit(stats.filter(remainder(3) != 1), labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with the columns of ``docs``.

    Only texts go to Python, once, and only statistics after that; the other columns stay in the JVM.
    """
    column = next(c for c in ("_x", "_x_", "_x__") if c not in docs.columns)
    measured = persist(docs.withColumn(column, _statistics_of(docs["text"].cast("string"))))
    stats = measured.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("x"))
    data = pickle.dumps(fit(stats.filter(remainder(3) != 1), labels))

    @F.arrow_udf(returnType=BooleanType())
    def good(x: pa.Array) -> pa.Array:
        rows = np.frombuffer(b"".join(x.to_pylist()), "<f8").reshape(-1, _N)
        return pa.array(_model(data).scores(rows) >= 0.5)

    return measured.filter(good(column)).select(*docs.columns)
