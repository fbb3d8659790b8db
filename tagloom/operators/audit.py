"""Audits of automatic decisions by later human ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 50
MIN_AUDITS = 10


def audited_pairs(history: DataFrame, states: tuple[str, ...] = ("pos", "neg")) -> DataFrame:
    """id, doc_id, tag_id, auto_state, human_state: automatic rows with the first later human row of the pair."""
    later = Window.partitionBy("doc_id", "tag_id").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    human = F.first(F.when(F.col("source") == "human", F.col("state")), ignorenulls=True).over(later)
    return (
        history.withColumn("human_state", human)
        .where((F.col("source") == "auto") & F.col("state").isin(*states) & F.col("human_state").isNotNull())
        .select("id", "doc_id", "tag_id", F.col("state").alias("auto_state"), "human_state")
    )


def audit_window(pairs: DataFrame, n: int = WINDOW) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("tag_id").orderBy(F.desc("id")))
    return pairs.withColumn("rn", rank).where(F.col("rn") <= n).drop("rn")


def audited_precision(history: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """tag_id, precision, n over the last 50 audited positives; of all ``tags`` if given: null and 0 without an audit."""
    found = audit_window(audited_pairs(history, ("pos",))).groupBy("tag_id").agg(
        F.avg((F.col("human_state") == "pos").cast("double")).alias("precision"), F.count(F.lit(1)).alias("n")
    )
    if tags is None:
        return found
    return tags.select("tag_id").join(found, "tag_id", "left").select("tag_id", "precision", F.coalesce("n", F.lit(0)).alias("n"))


def auto_completion_audit(history: DataFrame) -> DataFrame:
    """tag_id, precision, recall, n over the last 50 audited decisions of either state."""
    tp = F.count_if((F.col("auto_state") == "pos") & (F.col("human_state") == "pos"))
    return audit_window(audited_pairs(history)).groupBy("tag_id").agg(
        F.try_divide(tp, F.count_if(F.col("auto_state") == "pos")).alias("precision"),
        F.try_divide(tp, F.count_if(F.col("human_state") == "pos")).alias("recall"),
        F.count(F.lit(1)).alias("n"),
    )


def tags_to_suspend(tags: DataFrame, history: DataFrame, target_precision: float = 0.95, target_recall: float = 0.95) -> DataFrame:
    """tag_id of automatic tags whose audits (ten or more) miss a target."""
    single = audited_precision(history).select("tag_id", F.col("precision").alias("p1"), F.col("n").alias("n1"))
    full = auto_completion_audit(history).select("tag_id", F.col("precision").alias("p2"), F.col("recall").alias("r2"), F.col("n").alias("n2"))
    first = (F.col("n1") >= MIN_AUDITS) & (F.col("p1") < target_precision)
    second = (F.col("n2") >= MIN_AUDITS) & ((F.col("p2") < target_precision) | (F.col("r2") < target_recall))
    return (
        tags.where("auto_enabled AND NOT archived")
        .join(single, "tag_id", "left")
        .join(full, "tag_id", "left")
        .where(F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False)))
        .select("tag_id")
    )
