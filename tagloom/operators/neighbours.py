"""Exact nearest neighbours by dot product, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# a block of vectors in a task, and the table of products that it fills at a time
BLOCK_BYTES = 8 << 20
LEAST_ROWS = 1024
TILE = (256, 4096)


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _top(k: int, earlier: bool, skip_self: bool):
    def block(qid, qt, q, nid, nt, v) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        for i in range(0, len(qid) if len(nid) else 0, TILE[0]):
            ids, turns = qid[i : i + TILE[0], None], qt[i : i + TILE[0], None]
            rows, near, sims = [], [], []
            for j in range(0, len(nid), TILE[1]):
                own, own_turns = nid[None, j : j + TILE[1]], nt[None, j : j + TILE[1]]
                s = q[i : i + TILE[0]] @ v[j : j + TILE[1]].T
                if skip_self:
                    s[ids == own] = -np.inf
                if earlier:
                    s[own_turns >= turns] = -np.inf
                if s.shape[1] > k:
                    # the columns ascend by id: of those that tie with the k-th, k are enough
                    floor = np.partition(s, s.shape[1] - k, axis=1)[:, -k, None]
                    keep = s >= floor
                    crowded = np.flatnonzero(keep.sum(1) > k)
                    if len(crowded):
                        ties = s[crowded] == floor[crowded]
                        keep[crowded] &= ~ties | (ties.cumsum(1, dtype=np.int32) <= k)
                else:
                    keep = np.ones(s.shape, bool)
                r, c = np.nonzero(keep & (s > -np.inf))
                rows.append(r)
                near.append(own[0, c])
                sims.append(s[r, c])
            r, n, s = np.concatenate(rows), np.concatenate(near), np.concatenate(sims)
            # ties go to the lower id
            order = np.lexsort((n, -s, r))
            r, n, s = r[order], n[order], s[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            for column, x in zip(out, (ids[r[first], 0], n[first], s[first]), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["q_id", "n_id", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                side = np.asarray(t.column("side").combine_chunks())
                order = np.argsort(np.asarray(t.column("id").combine_chunks()), kind="stable")
                t, side = t.take(pa.array(order)), side[order]
                parts = []
                for s in (0, 1):
                    own = t.filter(pa.array(side == s))
                    parts += [np.asarray(own.column("id").combine_chunks()), np.asarray(own.column("turn").combine_chunks()), _vectors(own.column("vector"))]
                yield block(*parts)

        for batch in batches:
            qb, nb = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((qb[1:] != qb[:-1]) | (nb[1:] != nb[:-1])) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(qb)), strict=True):
                if b <= a:
                    continue
                now = (int(qb[a]), int(nb[a]))
                if now != key:
                    yield from flush()
                    key, held = now, []
                held.append(batch.slice(a, b - a))
        yield from flush()

    return run


def nearest_neighbours(
    queries: DataFrame, pool: DataFrame, k: int = 10, order_col: str | None = None, skip_self: bool = False, block: int | None = None
) -> DataFrame:
    """q_id, n_id, sim, rank: the ``k`` most similar pool vectors of each query; ties to the lower id.

    Both frames have doc_id and vector. Each side is cut into blocks as large as ``BLOCK_BYTES`` allow (or of
    about ``block`` rows), so a vector is copied once for each block of the other side, and their number goes with the
    data over the block size; a side of less is cut for the session's cores. A task multiplies one query block
    with one pool block and sends ``k`` rows a query on. With ``order_col`` only neighbours with a smaller value count
    (prequential replay): blocks are ranges of it then, and later pool blocks never meet earlier queries.
    """
    spark = queries.sparkSession
    turn = F.col(order_col).cast("bigint") if order_col else F.lit(0).cast("bigint")
    q = queries.select(F.col("doc_id").alias("id"), turn.alias("turn"), "vector").where("vector IS NOT NULL")
    n = pool.select(F.col("doc_id").alias("id"), turn.alias("turn"), "vector").where("vector IS NOT NULL")
    cores = spark.sparkContext.defaultParallelism
    # one row each: how many vectors there are, and how many fit into a block
    rows = F.lit(block) if block else F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.coalesce(F.max(F.size("vector")), F.lit(1)))))
    count = F.count(F.lit(1))
    whole = F.greatest(F.lit(1), F.ceil(count / rows)).cast("int")
    spread = whole if block else F.greatest(whole, F.least(F.lit(cores), F.ceil(count / LEAST_ROWS))).cast("int")
    if order_col:
        parts = n.agg(spread.alias("parts")).first().parts
        cuts = sorted(set(n.approxQuantile("turn", [i / parts for i in range(1, parts)], 0.001))) if parts > 1 else []
        own = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("turn")))
        left = q.select(own.alias("qb"), "id", "turn", "vector").select("qb", F.explode(F.sequence(F.lit(0), F.col("qb"))).alias("nb"), F.lit(0).alias("side"), "id", "turn", "vector")
        right = n.select(own.alias("nb"), "id", "turn", "vector").select(
            F.explode(F.sequence(F.col("nb"), F.lit(len(cuts)))).alias("qb"), "nb", F.lit(1).alias("side"), "id", "turn", "vector"
        )
        dealt = left.unionByName(right)
    else:
        blocks = q.agg(spread.alias("qn")).crossJoin(n.agg(whole.alias("nn")))

        def deal(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
            mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
            theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
            qb, nb = (mine, theirs) if side == 0 else (theirs, mine)
            return df.join(F.broadcast(blocks)).select(qb.alias("qb"), nb.alias("nb"), F.lit(side).alias("side"), "id", "turn", "vector")

        dealt = deal(q, "qn", "nn", 0).unionByName(deal(n, "nn", "qn", 1))
    pairs = dealt.repartition("qb", "nb").sortWithinPartitions("qb", "nb").mapInArrow(
        _top(k, order_col is not None, skip_self), "q_id bigint, n_id bigint, sim double"
    )
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "n_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_to(doc_ids: DataFrame, vectors: DataFrame, limit: int = 10, index=None, probes: int | None = None) -> DataFrame:
    """q_id, n_id, sim, rank: documents similar to the given ones, themselves left out; no vector, no rows.

    With an ``index`` of the vectors (``cells.cell_index``) only the cells that can matter are searched, or ``probes`` of them.
    """
    queries = vectors.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if index is not None:
        from .cells import cell_neighbours

        return cell_neighbours(queries, index, limit, skip_self=True, probes=probes)
    return nearest_neighbours(queries, vectors, limit, skip_self=True)
