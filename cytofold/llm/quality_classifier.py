"""Quality classifier: regularised quadratic discriminant over document statistics.

Class means and covariances come from sums that add up over partitions, so all
labelled rows count. A covariance is shrunk towards the pooled one and towards a
multiple of the identity; its Cholesky factor and that factor's inverse are made
once and scores are the difference of the classes' log densities (Mahalanobis
distances by products with the inverse factor) plus the log prior ratio, as a
probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.arrays import LOWER, MIX, blocks, hash_spans, mix, spans
from cytofold.llm.common import fold, materialise

UPPER, LETTERS, DIGITS, MARKS, SYMBOLS = (np.zeros(256, dtype=bool) for _ in range(5))
UPPER[65:91] = True
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
DIGITS[48:58] = True
MARKS[[ord(c) for c in ".,;:?"]] = True
SYMBOLS[[ord(c) for c in "#*$%&|<>!@~^_=+{}[]/\\"]] = True
STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "digits", "marks", "symbols",
    "distinct_words", "same_as_last", "repeated_windows", "words_per_line", "distinct_lines", "end_marks",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text of a block; all are finite, for the empty text too."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row_of_byte = np.repeat(np.arange(n), size)
    share = lambda part, whole: np.sqrt(part / np.maximum(whole, 1))
    count = lambda mask: np.bincount(row_of_byte[mask], minlength=n)[:n].astype(float)
    starts, ends = spans(data, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(row, minlength=n).astype(float)
    length = (ends - starts).astype(float)
    total = np.bincount(row, length, minlength=n)
    mean = total / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length * length, minlength=n) / np.maximum(words, 1) - mean * mean, 0))
    hashes = hash_spans(LOWER[data], starts, ends)

    def distinct(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        _, first = np.unique(mix(values ^ mix(rows.astype(np.uint64) + MIX[60])), return_index=True)
        return np.bincount(rows[first], minlength=n).astype(float)

    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))
    m = max(0, len(hashes) - 4)
    window = np.zeros(m, dtype=np.uint64)
    for k in range(5 if m else 0):
        window += mix(hashes[k : m + k] + MIX[k]) * MIX[70 + k]
    whole = row[4:] == row[:m]
    windows = np.bincount(row[:m][whole], minlength=n).astype(float)
    lines, line_row = _lines(data, offsets)
    line_count = np.bincount(line_row, minlength=n).astype(float)
    ended = np.bincount(row[MARKS[data[ends - 1]] | (data[ends - 1] == ord("!"))], minlength=n).astype(float) if len(ends) else np.zeros(n)
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), share(count(UPPER[data]), total), share(count(DIGITS[data]), total),
        share(count(MARKS[data]), words), share(count(SYMBOLS[data]), words), share(distinct(hashes, row), words),
        share(np.bincount(row[same], minlength=n), words), share(windows - distinct(window[whole], row[:m][whole]), windows),
        np.log1p(words / np.maximum(line_count, 1)), share(distinct(lines, line_row), line_count), share(ended, words),
    ])


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that aren't empty, and their rows."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.zeros(len(data), dtype=bool)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    cut[1:] |= data[:-1] == 10
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10)
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return hash_spans(data, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) for every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in blocks(batch.column(1)):
                rows = statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), lists], names=["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(measure, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors and their inverses, and log prior ratio of the two classes."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_prior: float

    def __post_init__(self):
        self.inverses = tuple(np.linalg.inv(f) for f in self.factors)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        log = []
        for mean, factor, inverse in zip(self.means, self.factors, self.inverses, strict=True):
            apart = (rows - mean) @ inverse.T
            log.append(-0.5 * (apart * apart).sum(axis=1) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.log_prior, -500, 500)))


def fit(labelled: DataFrame, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant | None:
    """Fit on (label 0 or 1, stats); None unless both classes have two rows or more.

    ``pooled`` is the weight of the pooled covariance, ``ridge`` that of the mean
    variance times the identity.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for label, group in batch.groupby("label"):
                x = np.column_stack([np.ones(len(group)), np.stack(group["stats"].to_numpy())])
                total[label] = total.get(label, 0) + x.T @ x
        if total:
            yield pd.DataFrame({"label": list(total), "moments": [m.ravel().tolist() for m in total.values()]})

    # One small row for each class and partition; added up by Spark, position by position.
    partial = labelled.mapInPandas(sums, "label int, moments array<double>").select("label", F.posexplode("moments"))
    cells = partial.groupBy("label", "pos").agg(F.sum("col").alias("v")).orderBy("label", "pos").collect()
    k = len(STATISTICS) + 1
    moments = {label: np.array([c["v"] for c in cells if c["label"] == label]).reshape(k, k) for label in {c["label"] for c in cells}}
    if set(moments) != {0, 1} or min(m[0, 0] for m in moments.values()) < 2:
        return None
    means = {c: m[0, 1:] / m[0, 0] for c, m in moments.items()}
    spread = {c: m[1:, 1:] / m[0, 0] - np.outer(means[c], means[c]) for c, m in moments.items()}
    n = {c: m[0, 0] for c, m in moments.items()}
    both = (n[0] * spread[0] + n[1] * spread[1]) / (n[0] + n[1])
    scale = np.diag(np.maximum(np.diag(both), 1e-6))
    shrunk = {c: (1 - pooled - ridge) * s + pooled * both + ridge * scale for c, s in spread.items()}
    factors = {c: np.linalg.cholesky(s) for c, s in shrunk.items()}
    return Discriminant((means[0], means[1]), (factors[0], factors[1]), float(np.log(n[1] / n[0])))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 2, folds: int = 4, cut: float = 0.7
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labelled documents outside fold ``held_out`` (crc32 of the id as
    text, modulo ``folds``); labels other than 0 and 1 are ignored, repeated ones
    count as often as they come. Null text counts as empty; empty texts are
    scored like any other. Without two labelled rows of each class the score is
    0.5. An empty table gives an empty result.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "statistics")
    fold_of = fold(F.col("doc_id"), folds)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    model = fit(stats.where(fold_of != held_out).join(marks, "doc_id").select("label", "stats"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS))
            found = model.score(rows) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", (fold_of == held_out).alias("held_out"), "stats").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
