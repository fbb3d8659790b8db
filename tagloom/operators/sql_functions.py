"""The learning loop in SQL: audit sampling per row, evaluation and training per group of a table argument.

``register_learning(spark)`` names

* ``audit_unit(id)`` and ``audit_sampled(id, rate)``,
* ``evaluate_tag(TABLE(SELECT tag_id, score, is_pos …) PARTITION BY (tag_id), target_precision, target_recall)``: one row a tag,
* ``fit_tag(TABLE(SELECT tag_id, y, vector …) PARTITION BY (tag_id))``: one row a tag that has enough samples of both classes.

An evaluation keeps a histogram of a tag's scores, whatever their number. A fit holds the samples of one tag, up to
``MAX_ROWS``; larger tags are for ``train_classifiers``, which spreads them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf

from ..functions import sampling, vectors
from .evaluation import MIN_EVALUATED, MIN_POSITIVES
from .scoring import fit

MAX_ROWS = 200_000
STEPS = np.arange(101, dtype=np.float32) * np.float32(0.01)


def unit(ids: np.ndarray) -> np.ndarray:
    """The sampling hash of documents mapped to [0, 1], in single precision."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(sampling.MULTIPLIER) + np.uint64(sampling.OFFSET)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(sampling.FINAL)
    return (x >> np.uint64(32)).astype(np.float32) / np.float32(4294967295)


def _units(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of the ids, and which ids are null."""
    return unit(np.asarray(ids.fill_null(0))), np.asarray(ids.is_null())


@arrow_udf(T.FloatType())
def audit_unit(ids: pa.Array) -> pa.Array:
    units, none = _units(ids)
    return pa.array(units, pa.float32(), mask=none)


@arrow_udf(T.BooleanType())
def audit_sampled(ids: pa.Array, rates: pa.Array) -> pa.Array:
    units, none = _units(ids)
    return pa.array(units < np.asarray(rates, np.float32), pa.bool_(), mask=none)


@udtf(
    returnType="tag_id bigint, precision double, recall double, n bigint, n_pos bigint, threshold float, neg_threshold float, eligible boolean"
)
class EvaluateTag:
    """Precision and recall at one half, both thresholds and the eligibility of one tag."""

    def __init__(self):
        self.tag, self.n, self.n_pos = None, 0, 0
        # positives and others by the highest step that their score reaches; the last place is for none
        self.counts = np.zeros((2, len(STEPS) + 1), np.int64)
        self.half = np.zeros(2, np.int64)
        self.targets = (0.95, 0.95)

    def eval(self, row: Row, target_precision: float, target_recall: float):
        self.tag, self.targets = row["tag_id"], (float(target_precision), float(target_recall))
        self.n += 1
        if row["is_pos"] is None:
            return
        kind = 0 if row["is_pos"] else 1
        self.n_pos += kind == 0
        if row["score"] is not None:
            score = np.float32(row["score"])
            at = len(STEPS) - 1 if np.isnan(score) else int(np.searchsorted(STEPS, score, "right")) - 1
            self.counts[kind, at] += 1
            self.half[kind] += bool(np.isnan(score) or score >= np.float32(0.5))

    def terminate(self):
        if not self.n:
            return
        tp, fp = self.counts[:, :-1][:, ::-1].cumsum(1)[:, ::-1]
        with np.errstate(invalid="ignore", divide="ignore"):
            precise = np.flatnonzero((tp + fp > 0) & (tp / (tp + fp) >= self.targets[0]))
            recalled = np.flatnonzero(tp / self.n_pos >= self.targets[1]) if self.n_pos else []
        threshold = float(STEPS[precise[0]]) if len(precise) else None
        yield (
            int(self.tag), float(self.half[0] / self.half.sum()) if self.half.sum() else None, float(self.half[0] / self.n_pos) if self.n_pos else None, self.n, self.n_pos,
            threshold, float(STEPS[recalled[-1]]) if len(recalled) else None, self.n_pos >= MIN_POSITIVES and self.n >= MIN_EVALUATED and threshold is not None,
        )


@udtf(returnType="tag_id bigint, weights array<double>, bias double, n_pos bigint, n_neg bigint")
class FitTag:
    """The classifier of one tag."""

    def __init__(self):
        self.tag, self.x, self.y = None, [], []

    def eval(self, row: Row):
        self.tag = row["tag_id"]
        if len(self.y) == MAX_ROWS:
            raise ValueError(f"tag {self.tag} has more than {MAX_ROWS} samples: train it with train_classifiers")
        self.x.append(np.asarray(row["vector"], np.float64))
        self.y.append(float(row["y"]))

    def terminate(self):
        if not self.y:
            return
        y = np.array(self.y)
        found = fit(np.stack(self.x), y)
        if found is not None:
            yield int(self.tag), found[0].tolist(), float(found[1]), int(y.sum()), int(len(y) - y.sum())


def register_learning(spark: SparkSession) -> None:
    """All SQL names of the engine, those of texts and vectors too."""
    vectors.register(spark)
    spark.udf.register("audit_unit", audit_unit)
    spark.udf.register("audit_sampled", audit_sampled)
    spark.udtf.register("evaluate_tag", EvaluateTag)
    spark.udtf.register("fit_tag", FitTag)
