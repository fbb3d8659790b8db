"""Scores of documents for tags: zero-shot, nearest neighbours, logistic regression, and their blend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automation import doc_tag_grid, review_flags, with_decision
from .kept import kept
from .neighbours import _vectors, nearest_neighbours

MIN_PER_CLASS = 5
ITERATIONS = 500
RATE = 0.5
L2 = 1e-3
ZERO_SHOT_BELOW = 3
BLEND_HALF = 20
MAX_TAGS = 4096  # whose weights every task holds at a time
PRODUCTS = 1 << 19  # that a task holds at a time


def validated_pool(vectors: DataFrame, documents: DataFrame, model_id: str = "m1") -> DataFrame:
    """Vectors of validated documents of one model."""
    return vectors.where(F.col("model_id") == model_id).join(
        documents.where("review_state = 'validated'").select("doc_id"), "doc_id", "left_semi"
    )


def training_samples(labels: DataFrame, vectors: DataFrame, model_id: str = "m1") -> DataFrame:
    """doc_id, tag_id, y, vector of human labels; automatic ones never train."""
    own = vectors.where(F.col("model_id") == model_id).select("doc_id", "vector")
    return labels.where("source = 'human'").join(own, "doc_id").select(
        "doc_id", "tag_id", F.when(F.col("state") == "pos", 1.0).otherwise(0.0).alias("y"), "vector"
    )


def human_positives(labels: DataFrame) -> DataFrame:
    return labels.groupBy("tag_id").agg(F.count_if((F.col("source") == "human") & (F.col("state") == "pos")).alias("n_pos"))


def knn_scores(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tag_id, knn: weighted share of positives among labelled neighbours; null if their weight is 0.

    All tags at once: neighbours do not depend on the tag. Unlabelled neighbours do not count.
    """
    human = labels.where("source = 'human'").select(F.col("doc_id").alias("n_id"), "tag_id", (F.col("state") == "pos").alias("pos"))
    weight = F.greatest(F.col("sim"), F.lit(0.0))
    return (
        neighbours.join(human, "n_id")
        .groupBy(F.col("q_id").alias("doc_id"), "tag_id")
        .agg(F.try_divide(F.sum(F.when(F.col("pos"), weight).otherwise(0.0)), F.nullif(F.sum(weight), F.lit(0.0))).alias("knn"))
    )


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def tag_centroids(samples: DataFrame) -> DataFrame:
    """tag_id, vector: normalised mean of the positive samples, as a tag's own vector."""
    parts = samples.where("y = 1").select("tag_id", F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy("tag_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("tag_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(
        "tag_id", l2_normalise(F.col("v.m")).alias("vector")
    )


def _times(ids: np.ndarray, w: np.ndarray, b: np.ndarray):
    """Products of a batch of vectors with all of some tags' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PRODUCTS // max(1, len(ids)))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            z = _vectors(batch.column(1)) @ w.T + b if len(ids) else np.zeros((batch.num_rows, 0))
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(ids, batch.num_rows)), pa.array(z.ravel())], names=["doc_id", "tag_id", "z"]
            )

    return run


def products(vectors: DataFrame, tags: DataFrame, weights: str, bias: str | None = None) -> DataFrame:
    """doc_id, tag_id, z: dot product of every vector with every tag's weights, plus the tag's bias.

    One matrix product a batch for every ``MAX_TAGS`` tags, whose weights go to all tasks. ``tags`` is evaluated once, at the call.
    """
    own = tags.select(
        F.col("tag_id").cast("bigint").alias("tag_id"), F.col(weights).cast("array<double>").alias("w"), (F.col(bias) if bias else F.lit(0.0)).cast("double").alias("b")
    )
    some = vectors.where("vector IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "vector")
    tables = [own.limit(MAX_TAGS + 1).toArrow()]
    if tables[0].num_rows > MAX_TAGS:
        own = kept(own)
        cuts = -(-own.count() // MAX_TAGS)
        turn = F.pmod(F.xxhash64("tag_id"), F.lit(cuts))
        tables = [own.where(turn == i).toArrow() for i in range(cuts)]
    out = None
    for t in tables:
        t = t.combine_chunks()
        run = _times(np.asarray(t.column("tag_id")), _vectors(t.column("w")), np.asarray(t.column("b")))
        part = some.mapInArrow(run, "doc_id bigint, tag_id bigint, z double")
        out = part if out is None else out.unionByName(part)
    return out


def zero_shot_scores(vectors: DataFrame, tag_vectors: DataFrame, n_pos: DataFrame | None = None) -> DataFrame:
    """doc_id, tag_id, zero_shot: (cosine + 1) / 2 for tags with fewer than three human positives."""
    tags = tag_vectors.select("tag_id", F.col("vector").alias("tv"))
    if n_pos is not None:
        tags = tags.join(n_pos, "tag_id", "left").where(F.coalesce("n_pos", F.lit(0)) < ZERO_SHOT_BELOW).select("tag_id", "tv")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("z") + 1) / 2))
    return products(vectors, tags, "tv").select("doc_id", "tag_id", score.alias("zero_shot"))


def fit(x: np.ndarray, y: np.ndarray, l2: float = L2, iterations: int = ITERATIONS, rate: float = RATE) -> tuple[np.ndarray, float] | None:
    """Weighted logistic regression by full-batch steps from zero; None with too few of a class."""
    pos = int(y.sum())
    neg = len(y) - pos
    if min(pos, neg) < MIN_PER_CLASS:
        return None
    share = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg)) / len(y)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(iterations):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        w -= rate * (e @ x + 2 * l2 * w)
        b -= rate * e.sum()
    return w, b


_CLASSIFIERS = "tag_id bigint, weights array<double>, bias double, n_pos bigint, n_neg bigint"


def train_classifiers(samples: DataFrame, l2: float = L2, iterations: int = ITERATIONS, rate: float = RATE, max_rows: int = 100_000) -> DataFrame:
    """One classifier per tag with enough samples of both classes.

    Tags of up to ``max_rows`` samples fit in parallel, one task each. Larger tags take the same steps
    with gradients summed over the cluster (``train_large``), so no task holds more than ``max_rows`` samples.
    """
    sizes = samples.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    small = samples.join(sizes.where(F.col("n") <= max_rows).select("tag_id"), "tag_id", "left_semi")

    def one(key: tuple[pa.Scalar, ...], samples: pa.Table) -> pa.Table:
        y = np.asarray(samples.column("y"), np.float64)
        got = fit(_vectors(samples.column("vector")), y, l2, iterations, rate)
        row = {} if got is None else {"tag_id": key[0].as_py(), "weights": got[0].tolist(), "bias": float(got[1]), "n_pos": int(y.sum()), "n_neg": int(len(y) - y.sum())}
        types = {"tag_id": pa.int64(), "weights": pa.list_(pa.float64()), "bias": pa.float64(), "n_pos": pa.int64(), "n_neg": pa.int64()}
        return pa.Table.from_pylist([row] if row else [], pa.schema(types))

    fitted = small.select(F.col("tag_id").cast("bigint").alias("tag_id"), "y", "vector").groupBy("tag_id").applyInArrow(one, _CLASSIFIERS)
    large = samples.join(sizes.where(F.col("n") > max_rows).select("tag_id"), "tag_id", "left_semi")
    if large.isEmpty():
        return fitted
    return fitted.unionByName(train_large(large, l2, iterations, rate))


PACK_ROWS = 4096


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples of a task as blocks of one tag: tag_id, y and vectors as bytes."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def emit(tag: int) -> pa.RecordBatch:
        parts = held.pop(tag)
        y, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return pa.RecordBatch.from_arrays([pa.array([tag]), pa.array([y.tobytes()]), pa.array([np.ascontiguousarray(x).tobytes()])], names=["tag_id", "y", "x"])

    for batch in batches:
        tags, y, x = np.asarray(batch.column(0)), np.asarray(batch.column(1), np.float64), _vectors(batch.column(2))
        for tag in np.unique(tags).tolist():
            own = np.flatnonzero(tags == tag)
            for at in range(0, len(own), PACK_ROWS):
                part = own[at : at + PACK_ROWS]
                held.setdefault(tag, []).append((y[part], x[part]))
                if sum(len(p[0]) for p in held[tag]) >= PACK_ROWS:
                    yield emit(tag)
    for tag in list(held):
        yield emit(tag)


def _block_gradients(state: dict, counts: dict):
    """The gradients of a task's blocks, one row a tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for tag, y_bytes, x_bytes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                w, b = state[tag]
                y = np.frombuffer(y_bytes.as_buffer())
                x = np.frombuffer(x_bytes.as_buffer()).reshape(len(y), -1)
                pos, neg = counts[tag]
                e = (1 / (1 + np.exp(-(x @ w + b))) - y) * np.where(y > 0, 0.5 / pos, 0.5 / neg)
                sums[tag] = sums.get(tag, 0.0) + np.append(e @ x, e.sum())
        yield _gradient_rows(sums)

    return run


def _gradient_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["tag_id", "g"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for tag, g in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[tag] = sums.get(tag, 0.0) + np.asarray(g.values)
    yield _gradient_rows(sums)


def train_large(samples: DataFrame, l2: float = L2, iterations: int = ITERATIONS, rate: float = RATE) -> DataFrame:
    """Full-batch steps for tags of any size, the same as ``fit`` takes.

    Samples are packed once into blocks of a tag, kept in memory where they lie. A step is one job: a task multiplies its blocks,
    and sends one gradient a tag; these are summed per tag, and one row a tag is collected.
    """
    spark = samples.sparkSession
    sizes = samples.where("vector IS NOT NULL").groupBy("tag_id").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).collect()
    counts = {int(r.tag_id): (int(r.p), int(r.n - r.p)) for r in sizes if min(r.p, r.n - r.p) >= MIN_PER_CLASS}
    dims = {int(r.tag_id): r.d for r in sizes}
    state = {t: (np.zeros(dims[t]), 0.0) for t in counts}
    own = samples.where(F.col("tag_id").isin(*counts)).where("vector IS NOT NULL").select(F.col("tag_id").cast("bigint").alias("tag_id"), F.col("y").cast("double").alias("y"), "vector")
    packed = own.mapInArrow(_packed, "tag_id bigint, y binary, x binary").persist()
    schema = "tag_id bigint, g array<double>"
    try:
        for _ in range(iterations if counts else 0):
            parts = packed.mapInArrow(_block_gradients(state, counts), schema).repartition("tag_id").mapInArrow(_summed, schema)
            found = {r.tag_id: np.array(r.g) for r in parts.collect()}
            state = {t: (w - rate * (found[t][:-1] + 2 * l2 * w), b - rate * found[t][-1]) for t, (w, b) in state.items()}
    finally:
        packed.unpersist()
    return spark.createDataFrame([(t, w.tolist(), float(b), *counts[t]) for t, (w, b) in state.items()], _CLASSIFIERS)


def lr_scores(vectors: DataFrame, classifiers: DataFrame) -> DataFrame:
    """doc_id, tag_id, lr: sigmoid of the weighted sum."""
    return products(vectors, classifiers, "weights", "bias").select("doc_id", "tag_id", (1 / (1 + F.exp(-F.col("z")))).alias("lr"))


def blend(lr: Column, knn: Column, zero_shot: Column, n_pos: Column) -> tuple[Column, Column]:
    """Score and the name of its source; a missing part leaves the other, no part leaves null."""
    w = n_pos / (n_pos + BLEND_HALF)
    score = F.when(lr.isNotNull() & knn.isNotNull(), w * lr + (1 - w) * knn).otherwise(F.coalesce(lr, knn, zero_shot))
    source = (
        F.when(lr.isNotNull() & knn.isNotNull(), "blended").when(lr.isNotNull(), "lr").when(knn.isNotNull(), "knn").when(zero_shot.isNotNull(), "zero_shot")
    )
    return score, source


def model_version(model_id: Column, trained_at: Column) -> Column:
    """``model`` or ``model+lr@time``."""
    return F.when(trained_at.isNull(), model_id).otherwise(F.concat(model_id, F.lit("+lr@"), trained_at))


def with_suggested(scores: DataFrame, tags: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``suggested``: a positive label of any source, or a score at the threshold that is not zero-shot."""
    pos = labels.where("state = 'pos'").select("doc_id", "tag_id", F.lit(True).alias("has_pos")).distinct()
    own = tags.select("tag_id", F.col("threshold").alias("t"))
    at = F.col("score").cast("float") >= F.coalesce("t", F.lit(0.5).cast("float"))
    return (
        scores.join(own, "tag_id", "left")
        .join(pos, ["doc_id", "tag_id"], "left")
        .withColumn("suggested", F.coalesce("has_pos", F.lit(False)) | F.coalesce(at & (F.col("source") != "zero_shot"), F.lit(False)))
        .drop("t", "has_pos")
    )


def score_documents(
    queue: DataFrame, pool: DataFrame, tags: DataFrame, labels: DataFrame, classifiers: DataFrame, tag_vectors: DataFrame, k: int = 10
) -> DataFrame:
    """doc_id, tag_id, score, source for the queue's documents and all active tags; no vector, null score."""
    n_pos = human_positives(labels)
    knn = knn_scores(nearest_neighbours(queue, pool, k), labels)
    parts = (
        doc_tag_grid(queue, tags)
        .join(lr_scores(queue, classifiers), ["doc_id", "tag_id"], "left")
        .join(knn, ["doc_id", "tag_id"], "left")
        .join(zero_shot_scores(queue, tag_vectors, n_pos), ["doc_id", "tag_id"], "left")
        .join(n_pos, "tag_id", "left")
    )
    score, source = blend(F.col("lr"), F.col("knn"), F.col("zero_shot"), F.coalesce("n_pos", F.lit(0)))
    return parts.select("doc_id", "tag_id", score.alias("score"), source.alias("source"))


def score_rows(
    queue: DataFrame, pool: DataFrame, tags: DataFrame, labels: DataFrame, classifiers: DataFrame, tag_vectors: DataFrame, model_id: str = "m1", k: int = 10
) -> DataFrame:
    """doc_id, tag_id, score, source, model_version, suggested, automatic, uncertain of the queue and all active tags.

    ``tags`` has threshold, neg_threshold and auto_enabled; ``classifiers`` trained_at. A document without a vector has no
    score and the bare model as version.
    """
    scores = with_suggested(score_documents(queue, pool, tags, labels, classifiers, tag_vectors, k), tags, labels)
    trained = classifiers.select("tag_id", "trained_at")
    there = queue.where("vector IS NOT NULL").select("doc_id", F.lit(True).alias("there"))
    version = model_version(F.lit(model_id), F.when(F.col("there"), F.col("trained_at")))
    rows = scores.join(trained, "tag_id", "left").join(there, "doc_id", "left").withColumn("model_version", version)
    return review_flags(with_decision(rows, tags), labels).select(
        "doc_id", "tag_id", "score", "source", "model_version", "suggested", "automatic", "uncertain"
    )


def prequential_replay(vectors: DataFrame, labels: DataFrame, order_col: str, k: int = 10) -> DataFrame:
    """doc_id, tag_id, score: what the neighbours validated before each document said about it."""
    return knn_scores(nearest_neighbours(vectors, vectors, k, order_col), labels).select("doc_id", "tag_id", F.col("knn").alias("score"))


def tag_vectors_current(tags: DataFrame, tag_vectors: DataFrame, model_id: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing): tag_id and vector of the tags' present versions, and tag_id of those to be computed."""
    own = tag_vectors.where(F.col("model_id") == model_id).select("tag_id", F.col("tag_version").alias("version"), "vector")
    found = tags.select("tag_id", "version").join(own, ["tag_id", "version"]).select("tag_id", "vector")
    return found, tags.select("tag_id").join(found, "tag_id", "left_anti")
