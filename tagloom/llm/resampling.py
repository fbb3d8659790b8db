"""Importance resampling of documents with hashed n-gram models (Xie et al., 2023, DSIR).

Words and word pairs of a text are hashed into ``BUCKETS`` buckets. Two bags of hashed
n-grams are summed over the corpus in Spark: of the target (documents labelled as of
good quality and not toxic, about ``max_target`` of them at most, chosen by a hash) and of all texts. A document's log weight is the sum over
its n-grams of the log ratio of the two models, each a unigram model over buckets.
``smoothing`` counts are added to a bucket's target count and to what the raw model expects
there, so that what is rare in the target tells little (else the labelled documents would
be preferred for their own rare words). ``k`` documents are then drawn without replacement in proportion to
the weights: the ``k`` greatest of log weight plus Gumbel noise. The noise comes from a
hash of the document, so a repeated job draws the same sample.

The top k are found without sorting or gathering rows: counts of keys in 4096
ranges, refined inside the one range that holds the k-th key, until it is a
single key; each step is a grouped count of at most 4096 rows.

``k`` is ``keep`` times the number of rows, or, if ``keep`` is None, the share of target
documents among the labelled ones.

Edge cases: a null or empty text has log weight 0. Rows with the same key (repeated
rows) are taken or left together, and kept where they straddle the limit, so ties may
make the sample a little larger. A very long text is read whole. Null ids are never labelled; without target documents all weights are 0 and noise
alone draws. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick
from .text_arrays import ngrams, text_chunks, words

BUCKETS = 1 << 16
SMOOTHING = 5.0
MAX_TARGET = 200_000
_LABELS = {"doc_id": "bigint", "quality": "int", "toxic": "int"}


def _buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of texts, text index and bucket of every word and word pair."""
    for chunk in text_chunks(column):
        w = words(chunk, lower=True, bare=True)
        text, bucket = [], []
        for n in (1, 2):
            at, h = ngrams(w, range(n))
            text.append(w.text[at])
            bucket.append((h >> np.uint64(48)).astype(np.int64))
        yield chunk.first, len(chunk), np.concatenate(text), np.concatenate(bucket)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, n_target, n_raw of a task's texts: at most BUCKETS rows."""
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for batch in batches:
        good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for first, n, text, bucket in _buckets(batch.column(0)):
            raw += np.bincount(bucket, minlength=BUCKETS)
            own = good[first : first + n][text]
            target += np.bincount(bucket[own], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some), pa.array(target[some].astype(np.int64)), pa.array(raw[some].astype(np.int64))], names=["bucket", "n_target", "n_raw"]
    )


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for first, n, text, bucket in _buckets(batch.column(1)):
                total[first : first + n] = np.bincount(text, ratio[bucket], minlength=n)
            # a uniform number from the row's hash, open at both ends
            u = (np.asarray(batch.column(2), np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total), pa.array(total - np.log(-np.log(u)))], names=["doc_id", "log_weight", "key"]
            )

    return run


def kth_greatest(keys: DataFrame, k: int, column: str = "key") -> float | None:
    """The k-th greatest value of a double column; None if there are fewer rows."""
    low, high, above = None, None, 0
    span = keys.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if k < 1 or span.n < k:
        return None
    low, high = span.a, span.b
    while low < high:
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            break
        part = F.least(F.lit(4095), F.floor((F.col(column) - low) / width)).cast("int")
        inside = keys.where(F.col(column).between(low, high)).groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")
        )
        for r in sorted(inside.collect(), key=lambda r: -r.part):
            if above + r.n >= k:
                low, high = r.a, r.b
                break
            above += r.n
    return low


def resample(
    docs: DataFrame, labels: DataFrame, keep: float | None = None, smoothing: float = SMOOTHING, max_target: int = MAX_TARGET
) -> DataFrame:
    """doc_id, log_weight, key, kept for every row; see the module."""
    ws = Workspace(docs.sparkSession, "resampling")
    rows = pick(docs, "doc_id", "text")
    marks = pick(labels, "doc_id", "quality", "toxic", types=_LABELS).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    good = marks.groupBy("doc_id").agg(F.bool_and((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    good = ws.keep(good, "good")
    # a bounded number of ids: texts meet them where they are read
    turn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double")
    chosen = good.where("good").select("doc_id", turn.alias("turn"))
    least = kth_greatest(chosen, max_target, "turn")
    if least is not None:
        chosen = chosen.where(F.col("turn") >= least)
    flagged = rows.join(F.broadcast(chosen.select("doc_id", F.lit(True).alias("target"))), "doc_id", "left")
    bags = (
        flagged.select("text", F.coalesce("target", F.lit(False)).alias("target"))
        .mapInArrow(_bags, "bucket bigint, n_target bigint, n_raw bigint")
        .groupBy("bucket")
        .agg(F.sum("n_target").alias("n_target"), F.sum("n_raw").alias("n_raw"))
        .toPandas()  # a row per bucket at most
    )
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = bags["bucket"].to_numpy(np.int64)
    target[at] = bags["n_target"].to_numpy(float)
    raw[at] = bags["n_raw"].to_numpy(float)
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log((target + smoothing) / (expected + smoothing)) if target.sum() else np.zeros(BUCKETS)
    scored = ws.keep(
        rows.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit("gumbel")).alias("u")).mapInArrow(
            _weigh(ratio), "doc_id bigint, log_weight double, key double"
        ),
        "scored",
    )
    if keep is None:
        share = good.agg(F.avg(F.col("good").cast("double")).alias("x")).first().x
        keep = 1.0 if share is None else share
    limit = kth_greatest(scored, round(keep * scored.count()))
    kept = F.lit(False) if limit is None else F.col("key") >= limit
    return ws.result(scored.withColumn("kept", kept))
