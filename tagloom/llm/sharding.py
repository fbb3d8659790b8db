"""Balanced contiguous shards from global prefix sums of row sizes.

Rows are put in one global order, the order of documents with equal texts moved
next to the first of them. The order is range-partitioned, so no task holds more
than its range; each partition's totals (rows, bytes) go into a small table with
one row per partition, whose prefix sums turn positions inside a partition into
global ones. Cutting the global byte positions at equal targets gives shards
that are contiguous in that order and near equal in bytes.

A group of equal texts of at most ``whole_group`` of a shard's target stays in
one shard; a larger group is cut by rows, so that no group unbalances a shard.

Edge cases: a null text has 16 bytes of overhead only, and the CRC of an empty
text; nulls form a group of their own with empty texts. A null doc_id sorts
first. Repeated rows are rows like any other, each with its own slot (the order
between identical rows is immaterial, as they are equal in all columns). An empty
table gives an empty result. A very long text is one row and never cut, so a shard can exceed the target by half a
row. Ties in the order are told by the texts' hashes. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, join_spread, pick, utf8_length

ROW_OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, whole_group: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; see the module."""
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        (utf8_length("text") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = ws.keep(rows, "rows")
    group = ["size", "text_crc32", "h"]
    firsts = rows.groupBy(*group).agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members"), F.sum("size").alias("group_bytes")
    )
    # only groups of two and more need the join; it is the small side, of a few numbers a group
    repeated = ws.keep(firsts.where("members > 1"), "repeated")
    placed = join_spread(rows, repeated, group, "members", rows.count(), "left").select(
        "doc_id",
        "size",
        "text_crc32",
        "h",
        F.coalesce("first_id", "doc_id").alias("first_id"),
        F.coalesce("group_bytes", "size").alias("group_bytes"),
    )
    order = ["first_id", "h", "doc_id"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = ws.keep(
        ws.keep(placed, "placed")
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()),
        "ranged",
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    # one row per partition: a few thousand at any scale
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte_base"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_base"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    numbered = ranged.withColumns(
        {
            "before_bytes": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
            "before_rows": F.row_number().over(inside) - 1,
        }
    ).join(F.broadcast(bases), "part")
    at = F.col("byte_base") + F.col("before_bytes")
    numbered = numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        *order[:2],
        "group_bytes",
        "all_bytes",
        at.alias("at"),
        (F.col("row_base") + F.col("before_rows")).alias("row"),
    )
    numbered = ws.keep(numbered, "numbered")
    small = F.col("group_bytes") * shards <= F.lit(whole_group) * F.col("all_bytes")
    # the middle of a whole group, or of a row, decides
    groups = (
        numbered.where(small & (F.col("group_bytes") > F.col("size")))
        .groupBy("first_id", "h")
        .agg(F.min("at").alias("group_at"))
    )
    middle = F.when(
        F.col("group_at").isNotNull(), F.col("group_at") * 2 + F.col("group_bytes")
    ).otherwise(F.col("at") * 2 + F.col("size"))
    cut = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / (F.col("all_bytes") * 2))).cast("int")
    same_group = numbered["first_id"].eqNullSafe(groups["first_id"]) & (numbered["h"] == groups["h"])
    sharded = numbered.join(groups, same_group, "left").select(
        "doc_id", "size", "text_crc32", numbered["row"], cut.alias("shard")
    )
    sharded = ws.keep(sharded, "sharded")
    starts = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return ws.result(
        sharded.join(F.broadcast(starts), "shard").select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("row") - F.col("first_row")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
