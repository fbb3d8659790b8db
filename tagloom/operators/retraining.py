"""Retraining and recalibration: the step that closes the learning loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automation import EngineConfig
from .evaluation import calibrate_neg_threshold, calibrate_threshold, evaluation_window, scored_labels
from .scoring import train_classifiers, training_samples


def retrain(
    tags: DataFrame, labels: DataFrame, vectors: DataFrame, predictions: DataFrame, classifiers: DataFrame, now: str, config: EngineConfig = EngineConfig(), model_id: str = "m1"
) -> tuple[DataFrame, DataFrame]:
    """(classifiers, tags) after training all active tags and setting both of their thresholds.

    A tag that can't train, or isn't active, keeps its classifier; ``classifiers`` has tag_id, weights, bias, n_pos, n_neg, trained_at.
    The thresholds of active tags are those of their last scored labels, null where these give none.
    """
    active = tags.where("NOT archived").select("tag_id")
    samples = training_samples(labels, vectors, model_id).join(active, "tag_id", "left_semi")
    new = train_classifiers(samples).withColumn("trained_at", F.lit(now))
    kept = classifiers.join(new.select("tag_id"), "tag_id", "left_anti").select(*new.columns)
    window = evaluation_window(scored_labels(predictions, labels))
    limits = (
        active.join(calibrate_threshold(window, config.target_precision).withColumnRenamed("threshold", "high"), "tag_id", "left")
        .join(calibrate_neg_threshold(window, config.target_recall).withColumnRenamed("neg_threshold", "low"), "tag_id", "left")
        .withColumn("hit", F.lit(True))
    )
    after = tags.join(limits, "tag_id", "left").select(
        *[
            F.when(F.col("hit"), F.col("high")).otherwise(F.col(c)).alias(c) if c == "threshold"
            else F.when(F.col("hit"), F.col("low")).otherwise(F.col(c)).alias(c) if c == "neg_threshold"
            else F.col(c)
            for c in tags.columns
        ]
    )
    return kept.unionByName(new), after
