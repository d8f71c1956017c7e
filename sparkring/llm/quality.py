"""Document quality by regularised quadratic discriminant analysis over transformed text statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables, words

FEATURES = (
    "log_words", "log_word_length", "upper", "symbols", "marks", "digits", "odd_words", "repeats", "distinct", "top_word",
    "log_line", "ended_lines", "repeated_lines", "long_words",
)
D = len(FEATURES)
#: Shares count with so much neutral text added, so that a few words do not make extremes.
FEW_CHARS, FEW_WORDS = 60, 12

_UPPER, _LETTER, _DIGIT, _MARK, _PLAIN = (np.zeros(256, dtype=np.int32) for _ in range(5))
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[0xC3] = 1  # most accented Latin letters begin with this byte
_DIGIT[48:58] = 1
_MARK[[ord("!"), ord("?")]] = 1
_PLAIN[:128] = 1
_PLAIN[[*range(65, 91), *range(97, 123), *range(48, 58), *b" \t\n\r.,;:'\"-()!?"]] = 0


def _sums(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[end] - total[begin]


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document, its distinct values and the most rows of one of them."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(doc)))
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, doc[at], runs)
    return np.bincount(doc[at], minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """The features of each text, one row each; null counts as empty, and an empty text has zeros."""
    out = [np.zeros((0, D))]
    for w in words.split(column):
        n = len(w.first) - 1
        count = w.counts()
        doc = np.repeat(np.arange(n), count)
        some = np.maximum(count, 1)
        data, begin, end = w.data, w.bounds[:-1], w.bounds[1:]
        share = lambda table: _sums(table[data], begin, end) / (end - begin + FEW_CHARS)
        letters = _sums(_LETTER[data], begin, end)
        length = w.end - w.start
        clean = np.append(0, np.cumsum(_PLAIN[data], dtype=np.int64))
        odd = clean[w.end] > clean[w.start]
        same = np.zeros(len(doc), dtype=bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        per = lambda flags: np.bincount(doc, weights=flags, minlength=n) / (count + FEW_WORDS)
        kinds, most = _distinct(doc, w.hash, n)
        # Lines: hashed by the words in them.
        breaks = np.append(0, np.cumsum(data == 10))
        line = breaks[w.start] if len(doc) else np.zeros(0, np.int64)
        begins = np.ones(len(doc), dtype=bool)
        begins[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(begins)
        line_doc = doc[at]
        lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
        if len(at):
            hashed = np.add.reduceat(words.mix(w.hash + np.arange(len(doc)).astype(np.uint64) - np.repeat(at, np.diff(np.append(at, len(doc)))).astype(np.uint64)), at)
            stops = np.isin(data[w.end[np.append(at[1:], len(doc)) - 1] - 1], np.frombuffer(b".!?", np.uint8))
        else:
            hashed, stops = np.zeros(0, np.uint64), np.zeros(0, bool)
        line_kinds, _ = _distinct(line_doc, hashed, n)
        has = count > 0
        rows = np.stack(
            [
                np.log1p(count),
                np.log1p(np.bincount(doc, weights=length, minlength=n) / some),
                np.sqrt((_sums(_UPPER[data], begin, end) + 0.03 * FEW_CHARS) / (letters + FEW_CHARS)),
                np.sqrt(share(_PLAIN)),
                np.sqrt(share(_MARK)),
                np.sqrt(share(_DIGIT)),
                np.sqrt(per(odd)),
                np.sqrt(per(same)),
                np.log((kinds + FEW_WORDS) / (count + FEW_WORDS)),
                np.sqrt((most + 0.05 * FEW_WORDS) / (count + FEW_WORDS)),
                np.log1p(count / lines),
                np.sqrt((np.bincount(line_doc, weights=stops, minlength=n) + 2) / (lines + 2)),
                np.sqrt(1 - np.where(has, line_kinds / lines, 1)),
                np.sqrt(per(length > 20)),
            ],
            axis=1,
        )
        out.append(rows)
    return np.concatenate(out)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = statistics(batch.column(1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), D).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "features"])


def features(docs: DataFrame) -> DataFrame:
    return tables.texts(docs).mapInArrow(_features, "doc_id long, features array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {k: np.zeros(1 + D + D * D) for k in (0, 1)}
    for batch in batches:
        x, label = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        for k in total:
            own = x[label == k]
            total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["label", "moments"])


class Discriminant:
    """Class means, inverse Cholesky factors of the shrunken covariances, and the log prior odds."""

    def __init__(self, moments: dict[int, np.ndarray], pooled: float = 0.2, ridge: float = 0.02):
        self.ready = all(k in moments and moments[k][0] >= 2 for k in (0, 1))
        if not self.ready:
            return
        count, mean, scatter = {}, {}, {}
        for k, m in moments.items():
            count[k], mean[k] = m[0], m[1 : 1 + D] / m[0]
            scatter[k] = m[1 + D :].reshape(D, D) - m[0] * np.outer(mean[k], mean[k])
        total = sum(scatter.values()) / sum(count.values())
        scale = np.sqrt(np.maximum(np.diag(total), 1e-8))
        self.parts = {}
        for k in count:
            own = (1 - pooled) * scatter[k] / count[k] + pooled * total
            own = own / np.outer(scale, scale)
            own = (1 - ridge) * own + ridge * max(np.trace(own) / D, 1e-3) * np.eye(D)
            factor = np.linalg.cholesky(own)
            self.parts[k] = mean[k], np.linalg.inv(factor) / scale, float(np.log(np.diag(factor)).sum())
        self.prior = float(np.log(count[1] / count[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of the two Mahalanobis log densities."""
        if not self.ready:
            return np.full(len(x), 0.5)
        density = {}
        for k, (mean, factor, log_det) in self.parts.items():
            z = (x - mean) @ factor.T
            density[k] = -0.5 * np.einsum("ij,ij->i", z, z) - log_det
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


def train(rows: DataFrame, labels: DataFrame, use: Column) -> Discriminant:
    """Moments of the labelled rows where `use` (of doc_id) holds; only sums leave the tasks.  Labels other than 0 and 1,
    and null ones, are left out; a doc_id labelled more than once counts once for each label row."""
    known = labels.where(use).select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    sums = rows.join(known, "doc_id").select("features", "label").mapInArrow(_moments, "label int, moments array<double>")
    sums = sums.select("label", F.posexplode("moments").alias("at", "value")).groupBy("label", "at").agg(F.sum("value").alias("value"))
    out = {k: np.zeros(1 + D + D * D) for k in (0, 1)}
    for r in sums.collect():  # 2 x (1 + D + D * D) rows
        out[r["label"]][r["at"]] = r["value"]
    return Discriminant(out)


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            score = own.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """doc_id and score of every document: the probability that it is labelled 1.

    Null and empty texts have zero statistics and are scored from those.  Where a class has fewer than two labelled
    rows, every score is 0.5.  Repeated doc_ids keep their rows, and each copy of a labelled one counts in training;
    a null doc_id has no label.  Very long texts are read whole, one at a time; an empty table gives no rows.  Columns other than doc_id, text and quality are not read.  The statistics are written
    once; training and scoring read them from there.
    """
    work = tables.Workspace(docs.sparkSession, "quality")
    rows = work.put(features(docs), "features")
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels, use))
    return rows.mapInArrow(_score(model), "doc_id long, score double")
