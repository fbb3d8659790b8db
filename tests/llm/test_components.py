"""Connected components and the join that spreads hot keys, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.llm.common import join_spread
from tagloom.llm.components import connected_components


def _plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("shape", ["hub", "chain", "random"])
def test_components_equal_union_find(spark, shape):
    draw = random.Random(shape)
    if shape == "hub":  # one centre with most of the edges, whose id is neither least nor greatest, and pairs
        edges = [(5_000, x) for x in draw.sample(range(10_000), 3_000) if x != 5_000] + [(x, x + 1) for x in range(20_000, 20_600, 2)]
    elif shape == "chain":
        edges = list(zip(order := draw.sample(range(-300, 300), 600), order[1:], strict=False))
    else:
        edges = [(draw.randrange(900), draw.randrange(900)) for _ in range(700)]
    frame = spark.createDataFrame(edges + edges[:20], "a bigint, b bigint").repartition(7)
    got = {r.node: r.component_id for r in connected_components(frame).collect()}
    wanted = _plain([e for e in edges if e[0] != e[1]])
    assert got == wanted


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_spread_equals_join(spark, tmp_path, how):
    keys = [1] * 4_000 + [2] * 900 + list(range(3, 2_000)) + [None] * 5
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 3 <> 0").write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    assert facts.where(f"n * 1000 > {len(keys)}").count() == 2  # both ways are taken
    got = join_spread(rows, facts, ["k"], "n", len(keys), how)
    assert sorted(got.select("k", "i", "n").collect(), key=str) == sorted(rows.join(facts, "k", how).select("k", "i", "n").collect(), key=str)
