"""Decisions by thresholds, automatic labels, and the full-automation pass, all documents at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import audit_sampled
from .labels import label_rows, moment, replace_labels

RECENT = 300


@dataclass(frozen=True)
class EngineConfig:
    """Settings with their defaults."""

    target_precision: float = 0.95
    target_recall: float = 0.95
    audit_rate: float = 0.05
    full_automation: bool = False
    fulltext_policy: str = "after_tagging_all"
    drawings_policy: str = "on_demand"
    fulltext_policy_tags: tuple[int, ...] = ()
    drawings_policy_tags: tuple[int, ...] = ()


POLICIES = ("on_demand", "after_tagging_all", "after_tagging_selected_tags")


def changed_settings(config: EngineConfig, tags: DataFrame, **changes) -> EngineConfig:
    """The settings after a change, or an error: full automation needs an active tag in automatic mode, rates and targets are shares."""
    new = replace(config, **changes)
    for name in ("target_precision", "target_recall", "audit_rate"):
        if not 0 <= getattr(new, name) <= 1:
            raise ValueError(f"{name} must lie between 0 and 1")
    for name in ("fulltext_policy", "drawings_policy"):
        if getattr(new, name) not in POLICIES:
            raise ValueError(f"{name} must be one of {', '.join(POLICIES)}")
    if new.full_automation and tags.where("auto_enabled AND NOT archived").isEmpty():
        raise ValueError("full automation needs a tag in automatic mode")
    return new


def decision() -> Column:
    """not_automatic, pos, neg or uncertain, in this order of tests."""
    score = F.col("score").cast("float")
    return (
        F.when(~F.col("auto_enabled"), "not_automatic")
        .when(score.isNull(), "uncertain")
        .when(score >= F.col("threshold"), "pos")
        .when(score < F.col("neg_threshold"), "neg")
        .otherwise("uncertain")
    )


def with_decision(scores: DataFrame, tags: DataFrame) -> DataFrame:
    own = tags.select("tag_id", "auto_enabled", "threshold", "neg_threshold")
    return scores.join(own, "tag_id").withColumn("decision", decision()).drop("auto_enabled", "threshold", "neg_threshold")


def review_flags(decided: DataFrame, labels: DataFrame) -> DataFrame:
    """Add automatic (the pair has an automatic label) and uncertain."""
    auto = labels.where("source = 'auto'").select("doc_id", "tag_id", F.lit(True).alias("a")).distinct()
    return (
        decided.join(auto, ["doc_id", "tag_id"], "left")
        .withColumn("automatic", F.coalesce("a", F.lit(False)))
        .withColumn("uncertain", ~F.col("automatic") & (F.col("decision") == "uncertain"))
        .drop("a")
    )


def doc_tag_grid(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """Every document with every active tag: the tags are the small side of this deliberate product."""
    return docs.select("doc_id").join(tags.where("NOT archived").select("tag_id"))


def auto_completable(decisions: DataFrame) -> DataFrame:
    """doc_id of documents all of whose tags are decided; a document without rows has no active tag."""
    return decisions.groupBy("doc_id").agg(F.bool_and(F.col("decision").isin("pos", "neg")).alias("ok")).where("ok").select("doc_id")


def latest_scores(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("doc_id", "tag_id").agg(F.max_by("score", "id").alias("score"))


def recent_documents(predictions: DataFrame, n: int = RECENT) -> DataFrame:
    """The ``n`` documents with the newest predictions."""
    return predictions.groupBy("doc_id").agg(F.max("id").alias("last_id")).orderBy(F.desc("last_id")).limit(n)


def automation_readiness(predictions: DataFrame, tags: DataFrame, n: int = RECENT) -> DataFrame:
    """would_complete, total: how many of the recent documents today's settings would complete."""
    recent = recent_documents(predictions, n).select("doc_id")
    grid = doc_tag_grid(recent, tags).join(latest_scores(predictions), ["doc_id", "tag_id"], "left")
    done = auto_completable(with_decision(grid, tags)).withColumn("done", F.lit(1))
    return recent.join(done, "doc_id", "left").agg(F.count("done").alias("would_complete"), F.count(F.lit(1)).alias("total"))


def pending_auto_labels(scores: DataFrame, tags: DataFrame, labels: DataFrame, queue: DataFrame) -> DataFrame:
    """doc_id, tag_id, score: automatic positives of queued documents without any label for the tag."""
    auto = tags.where("auto_enabled AND threshold IS NOT NULL AND NOT archived").select("tag_id", "threshold")
    open_pairs = scores.join(queue.select("doc_id"), "doc_id", "left_semi").join(labels.select("doc_id", "tag_id"), ["doc_id", "tag_id"], "left_anti")
    return open_pairs.join(auto, "tag_id").where(F.col("score").cast("float") >= F.col("threshold")).select("doc_id", "tag_id", "score")


def apply_auto_labels(labels: DataFrame, decisions: DataFrame, tags: DataFrame, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, rows written): automatic states, never over a human label.

    ``decisions`` has doc_id, tag_id, state, and score and model_version where known: the label's confidence and model. The
    written rows, which are also the history's, have all columns of the label table and the tag's present version.
    """
    human = labels.where("source = 'human'").select("doc_id", "tag_id")
    versions = tags.select("tag_id", (F.col("version") if "version" in tags.columns else F.lit(None)).cast("int").alias("tag_version"))
    known = decisions.columns
    written = label_rows(
        decisions.join(human, ["doc_id", "tag_id"], "left_anti")
        .join(versions, "tag_id", "left")
        .select(
            "doc_id", "tag_id", "state", F.lit("auto").alias("source"), "tag_version", moment(now).alias("created_at"),
            *[F.col(c).alias(as_) for c, as_ in (("score", "confidence"), ("model_version", "model_version")) if c in known],
        )
    )
    return replace_labels(labels, written), written


def full_automation(
    documents: DataFrame, scores: DataFrame, tags: DataFrame, labels: DataFrame, audit_rate: float = 0.05, enabled: bool = True, now: str | None = None
) -> dict[str, DataFrame]:
    """One pass over the queue: automatic labels, and documents that need no review.

    Confident positives are always written. If ``enabled``, confident absences are written too, also for documents that
    stay queued, and labels that exist count as decisions; a document all of whose tags are decided is completed,
    but a sampled share stays queued for a full review. ``scores`` has doc_id, tag_id, score and, where known,
    model_version. The result has labels (after) and written (the history's rows), both with all columns of the label
    table, completed, audited, documents (after), predictions (doc_id, tag_id, model_version, score, suggested: logged for completed documents, from new
    labels and from old ones with a confidence) and positives (doc_id, tags of completed documents, for retrieval).
    """
    queue = documents.where("review_state = 'queued' AND fetch_status = 'fetched'").select("doc_id")
    version = (F.col("model_version") if "model_version" in scores.columns else F.lit(None)).cast("string")
    own = scores.select("doc_id", "tag_id", "score", version.alias("model_version"))
    grid = doc_tag_grid(queue, tags).join(own, ["doc_id", "tag_id"], "left")
    have = label_rows(labels).select("doc_id", "tag_id", F.col("state").alias("have"), "confidence", F.col("model_version").alias("had_version"))
    decided = (
        with_decision(grid, tags)
        .join(have, ["doc_id", "tag_id"], "left")
        .withColumn("decision", F.coalesce("have", "decision"))
    )
    states = ("pos", "neg") if enabled else ("pos",)
    new = decided.where(F.col("have").isNull() & F.col("decision").isin(*states)).select("doc_id", "tag_id", F.col("decision").alias("state"), "score", "model_version")
    after, written = apply_auto_labels(labels, new, tags, now)
    complete = auto_completable(decided if enabled else decided.limit(0)).withColumn("audited", audit_sampled(F.col("doc_id"), audit_rate))
    done = complete.where("NOT audited").select("doc_id")
    gone = decided.join(done, "doc_id", "left_semi")
    logged = F.when(F.col("have").isNull(), F.col("score").cast("double")).otherwise(F.col("confidence"))
    by = F.when(F.col("have").isNull(), F.col("model_version")).otherwise(F.coalesce("had_version", F.lit("")))
    state = done.withColumn("now", F.lit("auto_completed"))
    return {
        "labels": after,
        "written": written,
        "completed": done,
        "audited": complete.where("audited").select("doc_id"),
        "documents": documents.join(state, "doc_id", "left").withColumn("review_state", F.coalesce("now", "review_state")).drop("now"),
        "predictions": gone.select("doc_id", "tag_id", by.alias("model_version"), logged.alias("score"), F.lit(True).alias("suggested")).where("score IS NOT NULL"),
        "positives": gone.groupBy("doc_id").agg(F.collect_set(F.when(F.col("decision") == "pos", F.col("tag_id"))).alias("tags")),
    }


def automation_state_counts(documents: DataFrame, labels: DataFrame, tags: DataFrame) -> DataFrame:
    """auto_completed; queued documents with all active tags labelled automatically; with some."""
    active = tags.where("NOT archived").select("tag_id")
    per_doc = labels.where("source = 'auto'").join(active, "tag_id", "left_semi").groupBy("doc_id").agg(F.countDistinct("tag_id").alias("n"))
    total = active.agg(F.count(F.lit(1)).alias("n_tags"))
    queued = (F.col("review_state") == "queued") & (F.col("fetch_status") == "fetched")
    return (
        documents.join(per_doc, "doc_id", "left")
        .join(F.broadcast(total))  # one row
        .agg(
            F.count_if(F.col("review_state") == "auto_completed").alias("auto_completed"),
            F.count_if(queued & (F.col("n") == F.col("n_tags")) & (F.col("n_tags") > 0)).alias("all_auto"),
            F.count_if(queued & (F.col("n") < F.col("n_tags"))).alias("some_auto"),
        )
    )


def retrieval_candidates(
    docs: DataFrame, pos_tags: DataFrame, done: DataFrame, policy: str, policy_tags: tuple[int, ...] = ()
) -> DataFrame:
    """doc_id to retrieve under a policy; ``pos_tags`` has doc_id, tags; ``done`` what is there already."""
    if policy not in ("after_tagging_all", "after_tagging_selected_tags"):
        return docs.select("doc_id").limit(0)
    wanted = docs.select("doc_id")
    if policy == "after_tagging_selected_tags":
        own = F.array(*[F.lit(int(t)) for t in policy_tags]).cast("array<bigint>")
        wanted = wanted.join(pos_tags.where(F.arrays_overlap(F.col("tags").cast("array<bigint>"), own)).select("doc_id"), "doc_id", "left_semi")
    return wanted.join(done.select("doc_id"), "doc_id", "left_anti")


def retrieval_jobs(docs: DataFrame, pos_tags: DataFrame, fulltext: DataFrame, drawings: DataFrame, config: EngineConfig) -> DataFrame:
    """doc_id, kind (fulltext, drawings) to retrieve under the two policies, less what is there."""
    have = {"fulltext": fulltext.where("status IN ('fetched', 'non_english_only')"), "drawings": drawings.where("status = 'fetched'")}
    policies = {"fulltext": (config.fulltext_policy, config.fulltext_policy_tags), "drawings": (config.drawings_policy, config.drawings_policy_tags)}
    parts = [retrieval_candidates(docs, pos_tags, have[kind], *policies[kind]).withColumn("kind", F.lit(kind)) for kind in have]
    return parts[0].unionByName(parts[1])
