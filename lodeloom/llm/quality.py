"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (shares of character
classes, lengths, repetition). Class means and covariances come from exact sums
over all labelled learning rows; each covariance is shrunk towards the pooled
one and its diagonal. A score is the difference of the two log densities, by
Mahalanobis distances with Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from . import words as w
from .store import Scratch, fresh

NAMES = [
    "words", "word_length", "upper", "digits", "symbols", "stops", "other_marks", "pipes", "distinct_words", "repeated_lines", "repeated_runs",
    "line_words", "end_symbols",
]
#: Weight of the pooled covariance, and of its diagonal, in each class's own.
SHRINK, DIAGONAL = 0.2, 0.1
SQUARE = 1e-3  # added to variances: no statistic is constant to the model


def _classes() -> dict[str, np.ndarray]:
    out = {}
    for name, chars in {
        "upper": bytes(range(65, 91)), "digits": b"0123456789", "symbols": b"#*$%&<>=@^~_{}[]\\+", "stops": b".,;:", "other_marks": b"!?\"'()/-`",
        "pipes": b"|", "lines": b"\n",
    }.items():
        t = np.zeros(256, dtype=np.int64)
        t[list(chars)] = 1
        out[name] = t
    return out


_CLASS = _classes()


def _line_repeats(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty lines of each text, and how many equal an earlier one."""
    flat = np.where(data == 10, np.uint8(32), np.where(w.IS_SPACE[data], np.uint8(95), data))
    lines = w.Words(flat, offsets, lower=False)
    _, at = w.distinct(lines.h, lines.at)
    return lines.counts, lines.counts - np.diff(at)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(offsets) - 1
    length = np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(NAMES)))
    words = w.Words(data, offsets)
    count = words.counts
    safe = np.maximum(count, 1)
    _, at = w.distinct(words.h, words.at)
    runs, runs_at = w.shingles(words.h, words.at, 3)
    _, distinct_runs = w.distinct(runs, runs_at)
    lines, repeated = _line_repeats(data, offsets)
    share = {k: w.group_sum(t[data], offsets) / length for k, t in _CLASS.items()}
    last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    ends = w.group_sum(_CLASS["symbols"][last] + _CLASS["pipes"][last], words.at) / safe
    chars = w.group_sum(words.end - words.start, words.at)
    value = {
        "words": np.log1p(count),
        "word_length": np.log1p(chars / safe),
        "distinct_words": np.diff(at) / safe * np.log1p(count),
        "repeated_lines": np.sqrt(repeated / (lines + 4)),
        "repeated_runs": np.sqrt((np.diff(runs_at) - np.diff(distinct_runs)) / (np.diff(runs_at) + 40)),
        "line_words": np.log1p(count / np.maximum(lines, 1)),
        "end_symbols": np.sqrt(ends),
    } | {k: np.sqrt(share[k]) for k in ("upper", "digits", "symbols", "stops", "other_marks", "pipes")}
    for k, name in enumerate(NAMES):
        out[:, k] = value[name]
    return out


def _rows(texts: pa.Array) -> np.ndarray:
    data, offsets = w.raw(texts)
    parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in w.slices(offsets)]
    return (np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))).astype(np.float32)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))


def _with_statistics(column: str):
    """Rows as they are and their statistics as one more column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(column, _lists(_rows(batch.column("text"))))

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(_rows(batch.column("text")))], names=["doc_id", "stats"])


def document_statistics(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, stats``: the statistics of each row, written once; what follows moves these few numbers and no text."""
    rows = docs.select("doc_id", "text").mapInArrow(_vectors, "doc_id long, stats array<float>")
    return scratch.keep(rows, "statistics")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES)).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each label: rows, sums and sums of products. A few numbers for each task."""
    d = len(NAMES)
    sums = {}
    for batch in batches:
        x, y = _matrix(batch.column("stats")), batch.column("label").to_numpy(zero_copy_only=False)
        for label in np.unique(y):
            own = x[y == label]
            n, s, p = sums.get(label, (0, np.zeros(d), np.zeros((d, d))))
            sums[label] = (n + len(own), s + own.sum(axis=0), p + own.T @ own)
    rows = [(int(k), float(n), s.tolist() + p.ravel().tolist()) for k, (n, s, p) in sums.items()]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.int32(), pa.float64(), pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["label", "n", "sums"])


@dataclass
class Model:
    """Means, inverse Cholesky factors, half log determinants and log priors of labels 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        log = np.empty((2, len(x)))
        for k in range(2):
            z = (x - self.means[k]) @ self.factors[k].T
            log[k] = self.log_priors[k] - self.log_dets[k] - 0.5 * (z * z).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray]]) -> Model:
    """From rows, sums and sums of products of each label; a label without rows is as the other, half as likely as one row."""
    d = len(NAMES)
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    s = {k: sums[k][1][:d] if k in sums else np.zeros(d) for k in (0, 1)}
    p = {k: sums[k][1][d:].reshape(d, d) if k in sums else np.zeros((d, d)) for k in (0, 1)}
    total = max(n[0] + n[1], 1.0)
    overall = (s[0] + s[1]) / total
    mean = {k: s[k] / n[k] if n[k] else overall for k in (0, 1)}
    within = sum(p[k] - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)) / total
    pooled = within + SQUARE * np.eye(d)
    factors, dets = [], []
    for k in (0, 1):
        own = (p[k] - n[k] * np.outer(mean[k], mean[k])) / n[k] if n[k] else pooled
        weight = min(1.0, SHRINK + (1 - SHRINK) * d / (n[k] + d))  # few rows: nearer to the pooled covariance
        cov = (1 - weight) * own + weight * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + SQUARE * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.solve(lower, np.eye(d)))
        dets.append(np.log(np.diag(lower)).sum())
    priors = np.log([(n[k] + 0.5) / (total + 1) for k in (0, 1)])
    return Model(np.array([mean[0], mean[1]]), np.array(factors), np.array(dets), priors)


def learn(known: DataFrame, labels: DataFrame) -> Model:
    """Model of ``labels(doc_id, label)`` over ``known(doc_id, stats)``: sums over all rows, no sample.

    Rows with a null id or label, and labels other than 0 and 1, teach nothing.
    """
    rows = known.join(labels.filter("label in (0, 1)").select("doc_id", F.col("label").cast("int")), "doc_id")
    parts = rows.select("stats", "label").mapInArrow(_moments, "label int, n double, sums array<double>")
    width = len(NAMES) * (len(NAMES) + 1)
    added = parts.groupBy("label").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)))
    return fit({r["label"]: (r["n"], np.array(r[2:], dtype=float)) for r in added.collect()})  # two rows


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that teach nothing: crc32 of the id as text leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)`` teaches where held_out is false. A null text is
    an empty one and gets a score too. Without any labels every score is 0.5.
    Repeated rows are scored each; other columns are ignored. Empty table: no
    rows.
    """
    stats = document_statistics(docs, Scratch(spark, "quality"))
    model = learn(stats, labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out()))
    out = stats.mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a score of at least 0.5, all columns as they are, whatever their names (see ``quality_scores``).

    Null texts count as empty ones, repeated rows stay or go each, and an empty
    table stays empty; without labels every row scores 0.5 and stays. Texts are
    read once: they are written beside their statistics.
    """
    stats = fresh("stats", docs.columns)
    schema = StructType([*docs.schema.fields, StructField(stats, ArrayType(FloatType()))])
    rows = Scratch(spark, "quality").keep(docs.mapInArrow(_with_statistics(stats), schema), "statistics")
    known = rows.select("doc_id", F.col(stats).alias("stats"))
    model = learn(known, labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out()))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(columns).filter(pa.array(model.score(_matrix(batch.column(stats))) >= 0.5))

    return rows.mapInArrow(run, docs.schema)
