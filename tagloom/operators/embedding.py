"""An embedder learned from the documents: truncated SVD of their weighted terms, by subspace iteration over the cluster.

A pass multiplies every batch with the axes so far and sums what comes back, features x axes numbers whatever the
number of documents; tasks send these sums by ranges of features, and only the total reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import LearnedTerms, term_counts, weighted
from .kept import kept

FEATURES = 4096
EXTRA = 8  # axes beside the wanted ones, which make the wanted ones come sooner
RANGE = 256  # features that a row of sums tells
BATCH = 256


def _counted(features: int):
    """Features and counts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(0).to_pylist()
            for at in range(0, len(texts), BATCH):
                counts = term_counts(texts[at : at + BATCH], features)
                row, code = np.nonzero(counts)
                offsets = pa.array(np.searchsorted(row, np.arange(len(counts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (code, counts[row, code])]
                yield pa.RecordBatch.from_arrays(lists, names=["codes", "counts"])

    return run


def _dense(batch: pa.RecordBatch, features: int) -> np.ndarray:
    sizes = np.diff(np.asarray(batch.column(0).offsets))
    out = np.zeros((batch.num_rows, features))
    out[np.repeat(np.arange(batch.num_rows), sizes), np.asarray(batch.column(0).flatten())] = np.asarray(batch.column(1).flatten())
    return out


def _sums(features: int, width: int, of):
    """Sums of ``of(counts)`` (features x width) over a task's batches, a row for every range of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features, width))
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                total += of(_dense(whole.slice(at, BATCH), features))
        starts = range(0, features, RANGE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(starts), pa.int32()), pa.array([total[a : a + RANGE].ravel() for a in starts], pa.list_(pa.float64()))], names=["start", "sums"]
        )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range, of the sums of all tasks."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for start, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.asarray(sums.values)
            totals[start] = totals[start] + own if start in totals else own.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], names=["start", "sums"])


def _total(counts: DataFrame, features: int, width: int, of) -> np.ndarray:
    schema = "start int, sums array<double>"
    parts = counts.mapInArrow(_sums(features, width, of), schema).repartition("start").mapInArrow(_added, schema)
    out = np.zeros((features, width))
    for r in parts.collect():  # features x width numbers
        out[r.start : r.start + RANGE] = np.array(r.sums).reshape(-1, width)
    return out


def fit_terms(docs: DataFrame, text_col: str, dim: int = 64, features: int = FEATURES, passes: int = 4, seed: int = 1) -> LearnedTerms:
    """The ``dim`` axes along which the documents' weighted terms differ most; null texts don't count.

    Without any text the axes are the random ones that a fit begins with.
    """
    some = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    counts = kept(some.mapInArrow(_counted(features), "codes array<int>, counts array<int>"))
    n = counts.count()
    found = _total(counts, features, 1, lambda c: (c > 0).sum(0)[:, None])[:, 0]
    idf = np.log((1 + n) / (1 + found)) + 1
    width = min(dim + EXTRA, features)
    axes, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))
    values = np.arange(width, 0, -1.0)
    for _ in range(passes if n else 0):

        def back(c: np.ndarray, axes: np.ndarray = axes) -> np.ndarray:
            x = weighted(c, idf)
            return x.T @ (x @ axes)

        product = _total(counts, features, width, back)
        # the best axes within the space so far, then the next space
        values, turn = np.linalg.eigh(axes.T @ product)
        last = axes @ turn[:, ::-1]
        axes, _ = np.linalg.qr(product @ turn[:, ::-1])
    if n:
        axes = last
    return LearnedTerms(axes[:, : min(dim, width)], idf)
