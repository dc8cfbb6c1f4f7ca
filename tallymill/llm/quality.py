"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics: logarithms of counts and
shares, angles of proportions. Each class is a Gaussian whose covariance is
shrunk towards a multiple of the identity on the scale of all labelled texts.
The score is the logistic function of the difference of log densities, with
Mahalanobis distances from Cholesky factors that are computed once. The
difference counts less for a text of few words, whose shares are noise.

The model is fitted from the sums, products and counts of each class, added up
by Spark over all labelled rows: a fixed number of numbers reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.key_filter import KeyFilter, keys_of
from tallymill.llm.text_hashes import chunks, utf8, word_hashes, word_spans
from tallymill.session import checkpoint

#: Weight of the multiple of the identity in a class covariance.
SHRINKAGE = 0.1
#: Words at which a text's own evidence counts half, so that a few words decide little.
EVIDENCE = 50
#: Score from which a text is predicted to be good.
THRESHOLD = 0.3

#: Bits of the filter for labelled documents; its size is fixed.
FILTER_BITS = 1 << 22

NAMES = (
    "words", "distinct", "commonest", "stutter", "repeats", "word_bytes", "short_words",
    "upper", "digits", "symbols", "bars", "stops", "line_words",
)

_KIND = np.zeros((256, 6), np.int64)
_KIND[65:91, 0] = 1  # upper case
_KIND[97:123, 1] = 1  # lower case
_KIND[48:58, 2] = 1  # digits
for _c in b"!\"#$%&()*+/:;<=>?@[\\]^_`{}~":
    _KIND[_c, 3] = 1  # symbols
_KIND[ord("|"), 4] = 1
for _c in b".,":
    _KIND[_c, 5] = 1


def _angle(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text; an empty text has finite ones too."""
    n_rows = len(offsets) - 1
    hashes, rows = word_hashes(data, offsets)
    starts, ends, _ = word_spans(data, offsets)
    n = np.diff(rows).astype(float)
    row = np.repeat(np.arange(n_rows), np.diff(rows))

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values, n_rows)

    # a window of texts is summed at its ends; empty texts have none
    kinds = np.zeros((n_rows, _KIND.shape[1]))
    for k in range(_KIND.shape[1]):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_KIND[data, k], out=total[1:])
        kinds[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    lines = (lines[offsets[1:]] - lines[offsets[:-1]]) + 1.0

    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    heads = np.flatnonzero(fresh)
    often = np.diff(np.append(heads, len(h)))
    distinct = np.bincount(r[heads], minlength=n_rows).astype(float)
    commonest = np.zeros(n_rows)
    np.maximum.at(commonest, r[heads], often)
    stutter = np.zeros(len(hashes))
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    width = (ends - starts).astype(float)
    letters = kinds[:, 0] + kinds[:, 1]
    size = np.diff(offsets).astype(float)
    return np.column_stack(
        [
            np.log1p(n),
            np.log((distinct + 1) / (n + 1)),
            np.log((commonest + 1) / (n + 2)),
            _angle(per_row(stutter), n),
            _angle(n - distinct, n),
            np.log1p(per_row(width) / np.maximum(n, 1)),
            _angle(per_row((width <= 3).astype(float)), n),
            _angle(kinds[:, 0], letters),
            _angle(kinds[:, 2], size),
            _angle(kinds[:, 3], size),
            _angle(kinds[:, 4], size),
            _angle(kinds[:, 5], size),
            np.log((n + 1) / lines),
        ]
    )


def _statistics(batches, wanted: KeyFilter | None = None):
    for batch in batches:
        if wanted is not None:
            batch = batch.filter(pa.array(wanted.may_hold(keys_of(batch.column("doc_id")))))
        data, offsets = utf8(batch.column("text"))
        for first, last in chunks(offsets):
            part = statistics(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            places = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
            others = [batch.column(c).slice(first, last - first) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.ListArray.from_arrays(places, pa.array(part.reshape(-1)))],
                names=[*(c for c in batch.schema.names if c != "text"), "stats"],
            )


def with_statistics(docs: DataFrame, wanted: KeyFilter | None = None) -> DataFrame:
    """``doc_id`` and ``stats``, the transformed statistics of the whole text.

    Rows that ``wanted`` rules out are left out in the same pass: a second Python
    worker for each task would only hold memory.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: _statistics(batches, wanted), "doc_id long, stats array<double>"
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; one without id always is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _moments(batches):
    sums = {}
    for batch in batches:
        stats = batch.column("stats")
        x = stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), -1)
        y = batch.column("label").to_numpy(zero_copy_only=False)
        for label in (0, 1):
            part = x[y == label]
            sums[label] = sums.get(label, 0) + np.concatenate([[len(part)], part.sum(0), (part.T @ part).reshape(-1)])
    for label, values in sums.items():
        yield pa.RecordBatch.from_pydict(
            {"label": pa.array([label] * len(values), pa.int32()), "at": pa.array(np.arange(len(values), dtype=np.int32)), "value": pa.array(values)}
        )


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants of both classes."""

    means: list[np.ndarray]
    whiten: list[np.ndarray]
    log_dets: list[float]
    prior: float
    scale: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        density = [
            -0.5 * ((((x - mean) / self.scale) @ whiten.T) ** 2).sum(1) - log_det
            for mean, whiten, log_det in zip(self.means, self.whiten, self.log_dets)
        ]
        words = np.expm1(x[:, 0])
        odds = (density[1] - density[0]) * words / (words + EVIDENCE) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """A model of ``labelled (stats, label)`` with labels 0 and 1.

    Where a class has fewer than two rows, every score is the share of label 1,
    or 0.5 without rows.
    """
    sums = labelled.mapInArrow(_moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    d = len(NAMES)
    values = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():
        values[r.label, r["at"]] = r["value"]
    counts = values[:, 0]
    if min(counts) < 2:
        return Model([], [], [], float(counts[1] / counts.sum()) if counts.sum() else 0.5, np.ones(d))

    def moments(v):
        mean = v[1 : d + 1] / v[0]
        return mean, v[d + 1 :].reshape(d, d) / v[0] - np.outer(mean, mean)

    scale = np.sqrt(np.maximum(np.diag(moments(values.sum(0))[1]), 1e-6))
    means, whiten, log_dets = [], [], []
    for v in values:
        mean, covariance = moments(v)
        covariance = covariance / np.outer(scale, scale)
        target = np.eye(d) * max(np.trace(covariance) / d, 0.05)
        factor = np.linalg.cholesky((1 - shrinkage) * covariance + shrinkage * target)
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        log_dets.append(float(np.log(np.diag(factor)).sum()))
    return Model(means, whiten, log_dets, float(counts[1] / counts.sum()), scale)


def _scorer(model: Model):
    def score(batches):
        for batch in batches:
            stats = batch.column("stats")
            x = stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    return score


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs (doc_id, text, ...)`` by ``labels (doc_id, quality)``.

    Returns ``doc_id, held_out, score, predicted``, a row for each row of
    ``docs``. Only rows whose crc32(doc_id) is no multiple of 5 are learnt from,
    and nothing but the text enters a score, so equal texts score alike. A null
    text is empty. Labels other than 0 and 1 are passed over; a document
    labelled twice counts twice. Empty tables are allowed.
    """
    stats = checkpoint(with_statistics(docs))
    model = model_of(stats, labels)
    scored = stats.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def model_of(stats: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")
    )
    learnt = stats.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("stats", "label")
    return fit(learnt)


def _keeper(model: Model):
    def keep(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in chunks(offsets):
                x = statistics(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                yield batch.slice(first, last - first).filter(pa.array(model.scores(x) >= THRESHOLD))

    return keep


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with all their columns.

    The statistics of labelled texts are computed for the model, then all texts
    are judged in one pass that moves nothing between tasks.
    """
    known = checkpoint(labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("key")).distinct())
    model = model_of(checkpoint(with_statistics(docs, KeyFilter(known, FILTER_BITS))), labels)
    return docs.mapInArrow(_keeper(model), docs.schema)
