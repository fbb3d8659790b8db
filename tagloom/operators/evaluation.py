"""Prequential evaluation: scored labels, windows, precision and recall, thresholds, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 300
MIN_POSITIVES = 30
MIN_EVALUATED = 150


def scored_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """id, doc_id, tag_id, score, is_pos: predictions whose pair has a human label now."""
    human = labels.where("source = 'human'").select("doc_id", "tag_id", (F.col("state") == "pos").alias("is_pos"))
    return predictions.join(human, ["doc_id", "tag_id"]).select("id", "doc_id", "tag_id", "score", "is_pos")


def evaluation_window(scored: DataFrame, n: int = WINDOW) -> DataFrame:
    """The last ``n`` per tag by id; Spark keeps ``n`` per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("tag_id").orderBy(F.desc("id")))
    return scored.withColumn("rn", rank).where(F.col("rn") <= n).drop("rn")


def _grid(scored: DataFrame, steps: int, size: float) -> DataFrame:
    """Precision, recall, n, pos at each grid threshold: a row per tag and step.

    A score counts once, at the highest step that it reaches (-1: none); the counts at a threshold are those of its step
    and all above, summed from the tag's histogram of ``steps`` + 2 places at most.
    """

    def threshold(step):
        return (step.cast("float") * F.lit(size).cast("float")).cast("float")

    score = F.col("score").cast("float")
    # the quotient is off by one step at most: the tests are those of the thresholds themselves
    guess = F.when(score.isNull(), -2).when(F.isnan(score), steps).otherwise(F.greatest(F.lit(-2.0), F.least(F.lit(float(steps)), F.floor(score / F.lit(size)))))
    near = F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: (guess + d).cast("int"))
    reached = F.filter(near, lambda k: (k >= 0) & (k <= steps) & (score >= threshold(k)))
    own = F.coalesce(F.array_max(reached), F.lit(-1))
    pos = F.col("is_pos")
    places = scored.groupBy("tag_id", own.alias("at")).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("q"), F.count(F.lit(1)).alias("n"))
    tags = places.groupBy("tag_id").agg(F.collect_list(F.struct("at", "p", "q")).alias("h"), F.sum("p").alias("pos"), F.sum("n").alias("n"))

    def above(step, what: str):
        return F.aggregate("h", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["at"] >= step, x[what]).otherwise(0))

    rows = tags.select("tag_id", "h", "pos", "n", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    rows = rows.select("tag_id", "step", above(F.col("step"), "p").alias("tp"), above(F.col("step"), "q").alias("fp"), "pos", "n")
    return rows.select(
        "tag_id", "step", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "pos").alias("recall"), "n", "pos",
    )


def precision_recall(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tag_id, precision, recall, n, pos at one threshold; null where undefined."""
    at = F.col("score").cast("float") >= F.lit(threshold).cast("float")
    tp = F.count_if(at & F.col("is_pos"))
    return scored.groupBy("tag_id").agg(
        F.try_divide(tp, F.count_if(at)).alias("precision"),
        F.try_divide(tp, F.count_if("is_pos")).alias("recall"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_pos").alias("pos"),
    )


def pr_curve(scored: DataFrame) -> DataFrame:
    """tag_id, step, precision, recall at thresholds 0, .05, … 1."""
    return _grid(scored, 20, 0.05).select("tag_id", "step", "precision", "recall")


def calibrate_threshold(scored: DataFrame, target_precision: float = 0.95) -> DataFrame:
    """tag_id, threshold: the lowest hundredth with the precision, null if none (precision is not monotone)."""
    step = F.min(F.when(F.col("precision") >= target_precision, F.col("step")))
    return _grid(scored, 100, 0.01).groupBy("tag_id").agg(step.alias("step")).select(
        "tag_id", (F.col("step").cast("float") * F.lit(0.01).cast("float")).cast("float").alias("threshold")
    )


def calibrate_neg_threshold(scored: DataFrame, target_recall: float = 0.95) -> DataFrame:
    """tag_id, neg_threshold: the highest hundredth that keeps the recall, null without positives."""
    step = F.max(F.when(F.col("recall") >= target_recall, F.col("step")))
    return _grid(scored, 100, 0.01).groupBy("tag_id").agg(step.alias("step")).select(
        "tag_id", (F.col("step").cast("float") * F.lit(0.01).cast("float")).cast("float").alias("neg_threshold")
    )


def eligibility(scored: DataFrame, target_precision: float = 0.95) -> DataFrame:
    """tag_id, n_pos, n_evaluated, threshold, eligible."""
    counts = scored.groupBy("tag_id").agg(F.count_if("is_pos").alias("n_pos"), F.count(F.lit(1)).alias("n_evaluated"))
    ok = (F.col("n_pos") >= MIN_POSITIVES) & (F.col("n_evaluated") >= MIN_EVALUATED) & F.col("threshold").isNotNull()
    return counts.join(calibrate_threshold(scored, target_precision), "tag_id").withColumn("eligible", ok)
