"""Connected components of an edge table, without the driver or one task holding it.

Each partition first joins its own edges with a union-find, which leaves a star
per local component and so at most one row per node of the partition. Then
alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) run until nothing changes: each is a
grouped minimum, which aggregates before it shuffles, and a join back, in which
the rows of a centre with very many neighbours stay in their own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_spread


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter((x for x in parent if root(x) != x), np.int64)
    roots = np.fromiter((root(int(x)) for x in nodes), np.int64, len(nodes))
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(roots[i : i + 100_000])], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component_id (its smallest node) for every node of an edge; edges are pairs of bigints."""
    ws = Workspace(edges.sparkSession, "components")
    stars = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_local_stars, "u bigint, v bigint")
    # u > v in every row: v is the smaller node
    current = ws.keep(stars, "stars0")
    for n in range(1, max_rounds):
        # large star: the larger neighbours of a centre that has smaller ones move to the smallest
        low = current.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        centres = ws.keep(current.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(low, "v"), f"centres{n}")
        # a centre may have any share of all edges
        moved = join_spread(current, centres, ["v"], "n", current.count(), "left")
        large = ws.keep(moved.select("u", F.coalesce("m", "v").alias("v")).distinct(), f"large{n}")
        # small star: the node and its smaller neighbours move to the smallest
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = ws.keep(small, f"stars{n}")
        # a forest of stars has no node that is both an end and a centre, and one centre per end
        ends = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        tangled = ends.where("n > 1").select("u").unionByName(ends.join(after.select(F.col("v").alias("u")).distinct(), "u").select("u"))
        ws.drop(f"stars{n - 1}")
        ws.drop(f"large{n}")
        ws.drop(f"centres{n}")
        current = after
        if tangled.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = current.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return ws.result(current.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(tops))
