"""Neighbours over cells against the plain ones, recall of the approximate mode, and what pruning saves."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.operators import cells, neighbours


def clustered(n: int, groups: int, dim: int = 12, seed: int = 2) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim)) * 2
    return (centres[r.integers(0, groups, n)] + 0.15 * r.normal(size=(n, dim))).astype(np.float32)


def frame(spark, x):
    rows = [(i, i % 97, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id bigint, turn bigint, vector array<float>").repartition(4)


def collected(df):
    return sorted((r.q_id, r["rank"], r.n_id, round(r.sim, 5)) for r in df.collect())


@pytest.mark.parametrize("order_col", [None, "turn"])
def test_exact_mode_equals_plain(spark, order_col):
    x = clustered(400, 9)
    x[50:60] = x[49]  # ties
    x[3] = 0
    df = frame(spark, x).unionByName(spark.createDataFrame([(999, 5, None)], "doc_id bigint, turn bigint, vector array<float>"))
    index = cells.cell_index(df, 14, order_col)
    want = collected(neighbours.nearest_neighbours(df, df, 6, order_col, skip_self=True))
    assert collected(cells.cell_neighbours(df, index, 6, order_col, skip_self=True)) == want
    # blocks of a few rows: cells and visitors in many blocks
    assert collected(cells.cell_neighbours(df, index, 6, order_col, skip_self=True, block=7)) == want


def test_bounds_hold():
    r = np.random.default_rng(0)
    for scale in (0.1, 3.0):
        x, q = r.normal(size=(60, 5)), r.normal(size=(40, 5))
        x[0], q[0] = 0, 0
        centre = x.mean(0) * scale
        cosine = x @ centre / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(centre), 1e-30)
        index = cells.CellIndex(
            None, np.array([0]), centre[None], np.array([np.linalg.norm(x - centre, axis=1).max()]), np.array([np.arccos(np.clip(cosine[1:], -1, 1)).max()]),
            np.array([np.linalg.norm(x, axis=1).max()]), np.array([60]), np.array([0]),
        )
        assert (index.bounds(q)[:, 0] >= (q @ x.T).max(1)).all()


def test_visits_grow_less_than_the_pool(spark):
    """Ten times the vectors: a query's visits, so the vectors that move, grow by far less than the blocks of the pool."""
    shares = []
    for n, groups in ((500, 20), (5000, 20)):
        x = clustered(n, groups)
        df = frame(spark, x)
        index = cells.cell_index(df)
        q = cells._typed(df, None)
        near = cells.cell_neighbours(df, index, 10, probes=1)
        floors = near.groupBy(F.col("q_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= 10, F.min("sim")).alias("floor"))
        visits = cells.first_visits(q, index, 10, 1).count() + cells.further_visits(q, floors, index, 10, 1).count()
        shares.append((visits / n, visits / n / len(index.ids)))
    assert shares[1][0] < 4 * shares[0][0] and shares[1][1] < 0.5


def test_few_vectors(spark):
    none = spark.createDataFrame([], "doc_id bigint, vector array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id bigint, vector array<float>")
    assert cells.cell_neighbours(one, cells.cell_index(none)).isEmpty()
    assert cells.cell_neighbours(none, cells.cell_index(one)).isEmpty()
    assert cells.cell_neighbours(one, cells.cell_index(one), skip_self=True).isEmpty()
    assert [(r.q_id, r.n_id, r["rank"]) for r in cells.cell_neighbours(one, cells.cell_index(one)).collect()] == [(1, 1, 1)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall(spark):
    """At least nine of ten neighbours at ten of the given vectors with eight probes."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    index = cells.cell_index(v)
    asked = v.where("doc_id % 50 = 0")
    want = {(r.q_id, r.n_id) for r in neighbours.similar_to(asked, v).collect()}
    got = {(r.q_id, r.n_id) for r in neighbours.similar_to(asked, v, index=index, probes=8).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {(r.q_id, r.n_id) for r in neighbours.similar_to(asked, v, index=index).collect()} == want


def test_what_a_task_holds_is_bounded():
    """Of pool vectors that tie, a query's best are sent on and no more; visits leave in batches of bounded bytes."""
    from tagloom.operators import neighbours

    n, k = 9000, 3
    q = pa.RecordBatch.from_arrays([pa.array([0] * 4), pa.array([0] * 4), pa.array([0] * 4), pa.array(range(4)), pa.array([9] * 4), pa.array([[1.0, 0.0]] * 4)], names=["qb", "nb", "side", "id", "turn", "vector"])
    v = pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array([0] * n), pa.array([1] * n), pa.array(range(n, 2 * n)), pa.array([0] * n), pa.array([[2.0, 1.0]] * n)], names=q.schema.names)
    taken = []
    whole = neighbours.np.nonzero
    try:
        neighbours.np.nonzero = lambda x: taken.append(int(x.sum())) or whole(x)
        (out,) = neighbours._top(k, False, False)(iter([q, v]))
    finally:
        neighbours.np.nonzero = whole
    assert out.column("n_id").to_pylist() == [*range(n, n + k)] * 4 and max(taken) <= 4 * k
    m = 3000
    one = np.ones(m)
    index = cells.CellIndex(None, np.arange(m), np.ones((m, 64)), one, one, one * 9, one.astype(int), one.astype(int) * 0)
    ask = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([1] * 40), pa.array([[1.0] * 64] * 40, pa.list_(pa.float32()))], names=["id", "turn", "vector"])
    sizes = [b.num_rows for b in cells._choose(index, 3, m, False, False)(iter([ask]))]
    assert sum(sizes) == 40 * m and max(sizes) * 64 <= cells.TABLE


def files(spark) -> dict[str, int]:
    """What Spark has on disk in its local and its shared folder."""
    found = {}
    for top in (spark.sparkContext.getConf().get("spark.local.dir"), spark.sparkContext.getCheckpointDir().removeprefix("file:")):
        for folder, _, names in os.walk(top):
            for name in names:
                path = os.path.join(folder, name)
                if name.startswith(("shuffle_", "part-")) and os.path.exists(path):
                    found[path] = os.path.getsize(path)
    return found


def test_disk_goes_with_the_vectors(spark):
    """Without clusters the bounds rule out little: what a search shuffles and writes is a few times the vectors, not the visits."""
    for n in (1000, 4000):
        df = frame(spark, np.random.default_rng(n).normal(size=(n, 32)).astype(np.float32)).withColumn("turn", F.col("doc_id"))
        index = cells.cell_index(df, order_col="turn")
        before = files(spark)
        found = cells.cell_neighbours(df, index, 5, "turn")
        assert found.count() == sum(min(i, 5) for i in range(n))
        assert sum(size for path, size in files(spark).items() if path not in before) < 5 * n * 32 * 4


@pytest.mark.parametrize("order_col", [None, "turn"])
def test_equal_vectors_tie(spark, order_col):
    """Copies all over the pool and in one crowd, turns against the ids: as a plain sum of every pair ranks them, to the last bit."""
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 64)).astype(np.float32)
    x[r.permutation(700)[:300]] = x[7]
    for i in range(40):
        x[r.integers(0, 700, 3)] = x[i]
    turn = r.integers(0, 90, 700)
    df = spark.createDataFrame([(i, int(t), v.tolist()) for i, (t, v) in enumerate(zip(turn, x, strict=True))], "doc_id bigint, turn bigint, vector array<float>").repartition(5)
    df = df.unionByName(spark.createDataFrame([(900, None, x[7].tolist())], df.schema)) if order_col else df
    want = []
    for i, v in enumerate(x.astype(float)):
        sims = np.add.accumulate(x.astype(float) * v, axis=1)[:, -1]
        can = np.flatnonzero((turn < turn[i]) if order_col else np.arange(700) != i)
        best = can[np.lexsort((can, -sims[can]))][:6]
        want += [(i, rank, int(j), float(sims[j])) for rank, j in enumerate(best, 1)]
    for block in (None, 50):
        got = cells.cell_neighbours(df, cells.cell_index(df, 9, order_col), 6, order_col, skip_self=True, block=block).collect()
        assert sorted((g.q_id, g["rank"], g.n_id, g.sim) for g in got) == want


def test_what_a_file_gives_of_copies():
    """Of equal vectors only those stay that some query can have among its k best."""
    v = np.array([[1.0, 2.0]] * 6 + [[3.0, 4.0]] * 2)
    cell, ids = np.array([0] * 8), np.array([9, 3, 5, 1, 7, 2, 10, 11])
    keep = cells._without_copies(cell, ids, np.array([1, 2, 3, 4, 5, 6, 1, 1]), v, 2)
    assert ids[keep].tolist() == [9, 3, 5, 1, 2, 10, 11]
    assert cells._without_copies(cell, np.arange(8), np.zeros(8, int), v, 2).tolist() == [True, True, *[False] * 4, True, True]
    assert cells._without_copies(np.arange(8), np.arange(8), np.zeros(8, int), v, 2).all()
