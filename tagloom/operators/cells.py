"""Nearest neighbours by dot product over an index of cells: exact with pruning, or approximate with fixed probes.

The pool's vectors are dealt to k-means cells and written in the order of the cells, in files as large as a block. A cell keeps its
centre, its radius and the widest angle to its centre, so the dot product of a query with any of its vectors is bounded. In the exact
mode a task holds a block of queries of near cells and the k best of each so far: it reads the files of their own cells, whose k-th
similarity rules out the cells with bounds below, then the files that hold others, one at a time. So vectors and queries are
shuffled once and written once, whatever the bounds leave, and a query sends on k rows. The tasks read the shared folder as Arrow does
(file, hdfs, s3 and gs addresses). With probes a query is sent to its cells: each cell's vectors and its visitors are cut into blocks,
multiplied block by block. In both modes no cell, however full or popular, meets in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept
from .neighbours import BLOCK_BYTES, LEAST_ROWS, TILE, _top, _vectors

MAX_CELLS = 4096
FIT_ROWS = 200_000  # vectors that the centres are fitted on, picked by the hash of their id
TABLE = 1 << 19  # numbers in a table of queries by cells, or of vectors that are sent on at a time
QUERY_BYTES = 4 << 20  # a block of queries in a task
SLACK = 1e-9  # relative: products of blocks differ in their last bits


@dataclass
class CellIndex:
    """members (cell, id, turn, vector) as a written table; a row of each array for every cell that has members; the places of its cells in the arrays for every file."""

    members: DataFrame | None
    ids: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    longest: np.ndarray
    rows: np.ndarray
    first_turn: np.ndarray
    files: tuple[tuple[str, np.ndarray], ...] = ()

    def at(self, own: np.ndarray) -> CellIndex:
        """The arrays of some cells."""
        return CellIndex(None, self.ids[own], self.centres[own], self.radius[own], self.angle[own], self.longest[own], self.rows[own], self.first_turn[own])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No vector of a cell has a larger dot product with the query: the better of a bound by distance and one by angle."""
        norms = np.linalg.norm(q, axis=1)[:, None]
        dots = q @ self.centres.T
        by_distance = dots + norms * self.radius
        size = norms * np.linalg.norm(self.centres, axis=1)
        cosine = np.divide(dots, size, out=np.ones_like(dots), where=size > 0)
        away = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - self.angle, 0)
        nearest = np.cos(np.minimum(away, np.pi))
        by_angle = np.where(nearest > 0, norms * self.longest * nearest, 0.0)
        return np.minimum(by_distance, by_angle) + SLACK * (norms * self.longest + 1e-300)


def fit_centres(pool: DataFrame, cells: int, fit_rows: int = FIT_ROWS, iterations: int = 8) -> np.ndarray:
    """Centres of k-means over at most about ``fit_rows`` vectors, those with the smallest hashes of their ids."""
    n = pool.count()
    share = min(1.0, fit_rows / max(1, n))
    if cells < 2:
        return np.array([pool.limit(1).first().vector], float)
    picked = pool.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else pool
    model = KMeans(k=cells, maxIter=iterations, seed=1, initSteps=1).fit(picked.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    return np.array(model.clusterCenters())


def _rows_of(cells: int) -> int:
    """How many rows are met with all cells at a time."""
    return max(1, TABLE // max(1, cells))


def _deal(centres: np.ndarray):
    """Add each vector's cell and its distance and angle to the centre."""
    lengths = np.linalg.norm(centres, axis=1)
    step = _rows_of(len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                v = _vectors(batch.column(2))
                dots, norms = v @ centres.T, np.linalg.norm(v, axis=1)
                cell = (dots - lengths**2 / 2).argmax(1)
                away = np.linalg.norm(v - centres[cell], axis=1)
                size = norms * lengths[cell]
                cosine = np.divide(dots[np.arange(len(v)), cell], size, out=np.full(len(v), -1.0), where=size > 0)
                angle = np.where(norms > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)
                columns = [pa.array(cell.astype(np.int32)), *batch.columns, pa.array(away), pa.array(angle), pa.array(norms)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "id", "turn", "vector", "away", "angle", "norm"])

    return run


_DEALT = "cell int, id bigint, turn bigint, vector array<float>, away double, angle double, norm double"


def _typed(df: DataFrame, order_col: str | None) -> DataFrame:
    turn = F.col(order_col).cast("bigint") if order_col else F.lit(0).cast("bigint")
    return df.select(F.col("doc_id").cast("bigint").alias("id"), turn.alias("turn"), F.col("vector").cast("array<float>").alias("vector")).where("vector IS NOT NULL AND size(vector) > 0 AND turn IS NOT NULL")


def cell_index(pool: DataFrame, cells: int | None = None, order_col: str | None = None, fit_rows: int = FIT_ROWS) -> CellIndex:
    """Deal a pool (doc_id, vector, and the order's column) to cells: about the root of its size, ``MAX_CELLS`` at most."""
    rows = _typed(pool, order_col)
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    cells = min(cells or max(1, round(n**0.5)), MAX_CELLS, max(1, n))
    if not n:
        none = np.zeros(0)
        return CellIndex(rows.select(F.lit(0).alias("cell"), "*"), none.astype(int), np.zeros((0, 1)), none, none, none, none.astype(int), none.astype(int))
    centres = fit_centres(rows, cells, fit_rows)
    block = max(1, BLOCK_BYTES // (8 * dim))
    order = ("cell", "turn", "id")
    members = kept(rows.mapInArrow(_deal(centres), _DEALT).repartitionByRange(-(-n // block), *order).sortWithinPartitions(*order), block)
    # a row for every cell of a file: as many as there are cells and files
    facts = members.groupBy(F.col("_metadata.file_path").alias("file"), "cell").agg(
        F.max("away").alias("away"), F.max("angle").alias("angle"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("rows"), F.min("turn").alias("turn")
    ).toPandas().sort_values(["file", "cell"])
    whole = facts.groupby("cell").agg({"away": "max", "angle": "max", "norm": "max", "rows": "sum", "turn": "min"})
    ids = whole.index.to_numpy()
    more = 1 + 1e-9
    return CellIndex(
        members.select("cell", "id", "turn", "vector"), ids, centres[ids], whole["away"].to_numpy() * more, whole["angle"].to_numpy() + 1e-9,
        whole["norm"].to_numpy() * more, whole["rows"].to_numpy(), whole["turn"].to_numpy(),
        tuple((path, np.searchsorted(ids, own["cell"].to_numpy())) for path, own in facts.groupby("file")),
    )


_VISIT = "cell int, id bigint, turn bigint, vector array<float>"


def _choose(index: CellIndex, k: int, probes: int, earlier: bool, further: bool):
    """Visits of a batch of queries: the first cells of each, or (``further``, which also reads each query's floor) the others that can matter."""
    index = replace(index, members=None)  # tasks need the arrays only
    step, sent = _rows_of(len(index.ids)), max(1, TABLE // max(1, index.centres.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if len(index.ids) else 0, step):
                batch = whole.slice(at, step)
                turns = np.asarray(batch.column(1))[:, None]
                bound = index.bounds(_vectors(batch.column(2)))
                if earlier:
                    bound[index.first_turn[None] >= turns] = -np.inf
                order = np.argsort(-bound, axis=1, kind="stable")
                # as many of the best cells as hold k vectors and one more (the query's own), at least ``probes``
                held = np.cumsum(index.rows[order], axis=1)
                first = (np.arange(order.shape[1]) < probes) | (held - index.rows[order] < k + 1)
                best = np.take_along_axis(bound, order, 1)
                if further:
                    floor = np.asarray(batch.column(3).fill_null(-np.inf))[:, None]
                    chosen = ~first & (best >= floor)
                else:
                    chosen = first
                r, c = np.nonzero(chosen & (best > -np.inf))
                for some in range(0, len(r), sent):
                    rows, own = r[some : some + sent], c[some : some + sent]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(index.ids[order[rows, own]].astype(np.int32)), *[batch.column(i).take(pa.array(rows)) for i in range(3)]],
                        names=["cell", "id", "turn", "vector"],
                    )

    return run


def first_visits(queries: DataFrame, index: CellIndex, k: int, probes: int, earlier: bool = False) -> DataFrame:
    """cell, id, turn, vector of the cells that each query visits before anything is known."""
    return queries.select("id", "turn", "vector").mapInArrow(_choose(index, k, probes, earlier, False), _VISIT)


def further_visits(queries: DataFrame, floors: DataFrame, index: CellIndex, k: int, probes: int, earlier: bool = False) -> DataFrame:
    """cell, id, turn, vector of the other cells whose bound reaches the query's floor (id, floor: null if it has fewer than k): what the exact mode can't rule out."""
    met = queries.join(floors, "id", "left").select("id", "turn", "vector", "floor")
    return met.mapInArrow(_choose(index, k, probes, earlier, True), _VISIT)


def _meet(visits: DataFrame, index: CellIndex, k: int, earlier: bool, skip_self: bool, block: int | None) -> DataFrame:
    """q_id, n_id, sim: the k best of every block of a cell for its visitors."""
    dim = max(1, index.centres.shape[1])
    rows = block or max(1, BLOCK_BYTES // (8 * dim))
    visits = kept(visits)
    # a row a cell: into how many blocks its visitors and its members are cut
    guests = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("qn"))
    spark = visits.sparkSession
    own = spark.createDataFrame([(int(c), -(-int(n) // rows)) for c, n in zip(index.ids, index.rows, strict=True)], "cell int, nn int")
    sizes = F.broadcast(kept(guests.join(own, "cell")))

    def deal(df: DataFrame, mine: str, other: str, side: int) -> DataFrame:
        base = F.col("cell").cast("bigint") * (1 << 31)
        here, there = base + F.pmod(F.xxhash64("id"), F.col(mine)), base + F.col("part")
        qb, nb = (here, there) if side == 0 else (there, here)
        return df.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(qb.alias("qb"), nb.alias("nb"), F.lit(side).alias("side"), "id", "turn", "vector")

    dealt = deal(visits, "qn", "nn", 0).unionByName(deal(index.members, "nn", "qn", 1))
    return dealt.repartition("qb", "nb").sortWithinPartitions("qb", "nb").mapInArrow(_top(k, earlier, skip_self), "q_id bigint, n_id bigint, sim double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "n_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _without_copies(cell: np.ndarray, ids: np.ndarray, turns: np.ndarray, v: np.ndarray, least: int) -> np.ndarray:
    """Which rows to keep: not those that ``least`` lower ids with an equal vector in the cell and no later turn precede. Rows ascend by cell, turn, id."""
    words = np.random.default_rng(1).integers(0, 1 << 62, v.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    key = np.ascontiguousarray(v).view(np.uint64) @ words + cell.astype(np.uint64) * words[0]
    keep = np.ones(len(ids), bool)
    _, group, n = np.unique(key, return_inverse=True, return_counts=True)
    crowd = np.flatnonzero(n[group] > least)
    crowd = crowd[np.argsort(group[crowd], kind="stable")]
    for rows in np.split(crowd, np.flatnonzero(np.diff(group[crowd])) + 1) if len(crowd) else ():
        rows = rows[(v[rows] == v[rows[0]]).all(1)]
        lowest: list[int] = []
        for i, own in zip(rows.tolist(), ids[rows].tolist(), strict=True):
            at = bisect_left(lowest, own)
            if at == least:
                keep[i] = False
            elif at == len(lowest) or lowest[at] != own:
                lowest.insert(at, own)
                del lowest[least:]
    return keep


class _Members:
    """A file of the pool: rows by cell and turn, without the copies that no query has among its k best."""

    def __init__(self, path: str, least: int):
        system, place = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
        with system.open_input_file(place) as source:
            t = pq.ParquetFile(source).read(columns=["cell", "id", "turn", "vector"], use_threads=False)
        self.cell, self.ids, self.turns = (np.asarray(t.column(c).combine_chunks()) for c in ("cell", "id", "turn"))
        self.v = _vectors(t.column("vector"))
        keep = _without_copies(self.cell, self.ids, self.turns, self.v, least)
        if not keep.all():
            self.cell, self.ids, self.turns, self.v = self.cell[keep], self.ids[keep], self.turns[keep], self.v[keep]

    def place(self, cell: int) -> tuple[int, int]:
        a, b = np.searchsorted(self.cell, [cell, cell + 1])
        return int(a), int(b)


class _Best:
    """The k best of each query of a block so far, ties to the lower id."""

    def __init__(self, n: int, k: int):
        self.sims, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        k = self.ids.shape[1]
        own, row = np.unique(rows, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(own)), k), row])
        ids, sims = np.concatenate([self.ids[own].ravel(), ids]), np.concatenate([self.sims[own].ravel(), sims])
        order = np.lexsort((ids, -sims, row))
        first = order[np.searchsorted(row[order], np.arange(len(own)))[:, None] + np.arange(k)]
        self.ids[own], self.sims[own] = ids[first], sims[first]


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows, the last of fewer."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, rows - n))
            n, at = n + held[-1].num_rows, at + held[-1].num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(index: CellIndex, k: int, earlier: bool, skip_self: bool, rows: int, block: int | None):
    """q_id, n_id, sim: the k best of every query (cell, id, turn, vector), ``rows`` queries at a time."""
    index = replace(index, members=None)  # tasks need the arrays only
    tile, columns = min(TILE[0], rows), min(TILE[1], block or TILE[1])

    def meet(best: _Best, at: np.ndarray, ids, turns, q, slack, members: _Members, a: int, b: int) -> None:
        """The queries of the places ``at`` and the rows a to b of a file."""
        s = q[at] @ members.v[a:b].T
        if earlier:
            s[members.turns[None, a:b] >= turns[at, None]] = -np.inf
        if skip_self:
            s[members.ids[None, a:b] == ids[at, None]] = -np.inf
        floor = np.maximum(best.sims[at, -1] - slack[at], np.finfo(float).min)
        keep = s >= floor[:, None]
        if b - a > k and np.count_nonzero(keep) > 4 * k * len(at):
            kth = np.partition(s, b - a - k, axis=1)[:, -k]
            keep = s >= np.maximum(floor, np.where(kth > -np.inf, kth - slack[at], -np.inf))[:, None]
        r, c = np.divmod(np.flatnonzero(keep), b - a)
        r, c = at[r], c + a
        step = max(1, TABLE // q.shape[1])
        for i in range(0, len(r), step):
            rr, cc = r[i : i + step], c[i : i + step]
            # the sum in the order of the numbers: the same for equal vectors, which products of blocks are not
            sims = np.add.accumulate(q[rr] * members.v[cc], axis=1)[:, -1]
            own = sims >= best.sims[rr, -1]
            if own.any():
                best.add(rr[own], members.ids[cc[own]], sims[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(path, own, index.at(own)) for path, own in index.files]
        longest = index.longest.max()
        for t in _cut(batches, rows):
            home, ids, turns = (np.asarray(t.column(i).combine_chunks()) for i in range(3))
            q = _vectors(t.column(3))
            if earlier:  # queries of near turns together: what comes later is not multiplied
                order = np.argsort(turns, kind="stable")
                home, ids, turns, q = home[order], ids[order], turns[order], q[order]
            slack = SLACK * np.linalg.norm(q, axis=1) * longest
            best = _Best(len(q), k)
            for own_cells in (True, False):
                for path, own, part in parts:
                    if own_cells and not np.isin(own, home).any():
                        continue
                    members = None
                    step = min(tile, _rows_of(len(own)))
                    for i in range(0, len(q), step):
                        here = slice(i, i + step)
                        need = home[here, None] == own
                        if not own_cells:
                            need = ~need & (part.bounds(q[here]) >= best.sims[here, -1:])
                        if earlier:
                            need &= part.first_turn < turns[here, None]
                        for c in np.flatnonzero(need.any(0)):
                            members = members or _Members(path, k + skip_self)
                            at = i + np.flatnonzero(need[:, c])
                            a, b = members.place(part.ids[c])
                            if earlier:
                                b = a + int(np.searchsorted(members.turns[a:b], turns[at].max()))
                            for j in range(a, b, columns):
                                meet(best, at, ids, turns, q, slack, members, j, min(b, j + columns))
            r, c = np.nonzero(best.sims > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(best.ids[r, c]), pa.array(best.sims[r, c])], names=["q_id", "n_id", "sim"])

    return run


def cell_neighbours(
    queries: DataFrame, index: CellIndex, k: int = 10, order_col: str | None = None, skip_self: bool = False, probes: int | None = None, block: int | None = None
) -> DataFrame:
    """q_id, n_id, sim, rank: the ``k`` most similar pool vectors of each query; ties to the lower id.

    Without ``probes`` the rows are those of ``nearest_neighbours``; a null of the order's column has no neighbours and is none. With it each query visits that many cells (and more where
    these hold fewer than ``k`` vectors) and no others: approximate, in one pass. ``order_col``, for which the index must be
    built too, counts only neighbours with a smaller value. Null vectors give no rows. ``block`` is the rows of a block.
    """
    earlier = order_col is not None
    q = _typed(queries, order_col)
    if probes:
        return _best(_meet(first_visits(q, index, k, probes, earlier), index, k, earlier, skip_self, block), k)
    spark = queries.sparkSession
    n = q.count()
    if not n or not len(index.ids):
        return spark.createDataFrame([], "q_id bigint, n_id bigint, sim double, rank int")
    rows = block or max(1, QUERY_BYTES // (8 * index.centres.shape[1]))
    parts = max(-(-n // rows), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    near = q.mapInArrow(_deal(index.centres), _DEALT).select("cell", "id", "turn", "vector").repartitionByRange(parts, "cell", "id")
    return _best(near.mapInArrow(_search(index, k, earlier, skip_self, rows, block), "q_id bigint, n_id bigint, sim double"), k)
