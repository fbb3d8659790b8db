"""Label state: statistics, review candidates, and set-based changes with their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

REVIEWED = ("validated", "auto_completed")
LABEL = {
    "doc_id": "bigint", "tag_id": "bigint", "state": "string", "source": "string", "confidence": "double", "model_version": "string",
    "tag_version": "int", "created_at": "timestamp",
}


def label_rows(labels: DataFrame) -> DataFrame:
    """The columns of the label table; what the frame lacks is null."""
    return labels.select(*[(F.col(c) if c in labels.columns else F.lit(None)).cast(t).alias(c) for c, t in LABEL.items()])


def moment(now: str | None):
    return (F.lit(now) if now else F.current_timestamp()).cast("timestamp")


def replace_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """The label table with the rows of ``new`` in place of those of the same pairs, all columns kept."""
    rest = label_rows(labels).join(new.select("doc_id", "tag_id"), ["doc_id", "tag_id"], "left_anti")
    return rest.unionByName(label_rows(new))


def tag_stats(tags: DataFrame, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """tag_id, human_pos, human_neg, auto_pos, auto_neg, stale, unlabelled; zeros kept."""
    own = labels.join(tags.select("tag_id", "version"), "tag_id")
    human, auto = F.col("source") == "human", F.col("source") == "auto"
    pos, neg = F.col("state") == "pos", F.col("state") == "neg"
    counts = own.groupBy("tag_id").agg(
        F.count_if(human & pos).alias("human_pos"),
        F.count_if(human & neg).alias("human_neg"),
        F.count_if(auto & pos).alias("auto_pos"),
        F.count_if(auto & neg).alias("auto_neg"),
        F.count_if(human & (F.col("tag_version") < F.col("version"))).alias("stale"),
    )
    reviewed = documents.where(F.col("review_state").isin(*REVIEWED)).select("doc_id")
    # reviewed documents less the labelled ones among them: cheaper than the anti join of the grid
    labelled = labels.join(reviewed, "doc_id", "left_semi").groupBy("tag_id").agg(F.countDistinct("doc_id").alias("labelled"))
    total = reviewed.agg(F.count(F.lit(1)).alias("reviewed"))
    return (
        tags.select("tag_id")
        .join(counts, "tag_id", "left")
        .join(labelled, "tag_id", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "tag_id",
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("human_pos", "human_neg", "auto_pos", "auto_neg", "stale")),
            (F.col("reviewed") - F.coalesce("labelled", F.lit(0))).alias("unlabelled"),
        )
    )


def tag_review_candidates(documents: DataFrame, labels: DataFrame, tags: DataFrame) -> DataFrame:
    """doc_id, tag_id, previous_state, previous_version: reviewed documents without a label, or with a stale human one."""
    reviewed = documents.where(F.col("review_state").isin(*REVIEWED)).select("doc_id")
    grid = reviewed.join(tags.where("NOT archived").select("tag_id", "version"))
    stale = (F.col("source") == "human") & (F.col("tag_version") < F.col("version"))
    return (
        grid.join(labels.select("doc_id", "tag_id", "state", "source", "tag_version"), ["doc_id", "tag_id"], "left")
        .where(F.col("state").isNull() | stale)
        .select("doc_id", "tag_id", F.col("state").alias("previous_state"), F.col("tag_version").alias("previous_version"))
    )


def tag_review_queue(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with their score and rank in the tag: best first, unscored last.

    Ranks come from ranges of the order and the numbers of rows before them, so no task ranks a whole tag.
    """
    order = [F.col("tag_id"), F.desc_nulls_last("score"), F.col("doc_id")]
    scored = candidates.join(scores.select("doc_id", "tag_id", "score"), ["doc_id", "tag_id"], "left")
    ranged = kept(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("tag_id", "part").agg(F.count(F.lit(1)).alias("n"))
    # a row for each tag in each range
    before = Window.partitionBy("tag_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("tag_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("tag_id", "part").orderBy(*order[1:]))
    return ranged.withColumn("rn", inside).join(bases, ["tag_id", "part"]).select(
        *candidates.columns, "score", (F.col("base") + F.col("rn")).alias("rank")
    )


def label_sets(labels: DataFrame) -> DataFrame:
    """doc_id, human_pos, pos, auto: sorted tag ids."""

    def tags_where(cond):
        return F.array_sort(F.collect_set(F.when(cond, F.col("tag_id"))))

    pos = F.col("state") == "pos"
    return labels.groupBy("doc_id").agg(
        tags_where(pos & (F.col("source") == "human")).alias("human_pos"), tags_where(pos).alias("pos"), tags_where(F.col("source") == "auto").alias("auto")
    )


def labels_from_history(history: DataFrame) -> DataFrame:
    """The latest state of every pair."""
    return history.groupBy("doc_id", "tag_id").agg(F.max_by(F.struct("state", "source"), "id").alias("s")).select("doc_id", "tag_id", "s.state", "s.source")


def validate(
    decisions: DataFrame, tags: DataFrame, labels: DataFrame, documents: DataFrame, scores: DataFrame | None = None, now: str | None = None
) -> dict[str, DataFrame]:
    """Full reviews: every active tag of a decided document gets a human state.

    ``decisions`` has doc_id and checked (tag ids); ``scores`` (doc_id, tag_id, score, suggested) are those of the moment, from
    before the labels: the decided documents' ones come back as predictions to be logged, with their model_version if they
    have one. ``labels`` and ``history`` (the rows written) have all columns of the label table; a human label has no
    confidence and no model.
    """
    docs = decisions.select("doc_id", "checked")
    active = tags.where("NOT archived").select("tag_id", F.col("version").alias("tag_version"))
    new = docs.join(active).select(
        "doc_id", "tag_id", F.when(F.array_contains("checked", F.col("tag_id")), "pos").otherwise("neg").alias("state"),
        F.lit("human").alias("source"), "tag_version", moment(now).alias("created_at"),
    )
    done = docs.select("doc_id").withColumn("now", F.lit("validated"))
    after = documents.join(done, "doc_id", "left").withColumn("review_state", F.coalesce("now", "review_state")).drop("now")
    out = {"labels": replace_labels(labels, new), "history": label_rows(new), "documents": after}
    if scores is not None:
        version = ["model_version"] if "model_version" in scores.columns else []
        out["predictions"] = scores.where("score IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi").join(active.select("tag_id"), "tag_id", "left_semi").select(
            "doc_id", "tag_id", "score", "suggested", *version
        )
    return out


def label_pairs(decisions: DataFrame, labels: DataFrame, scores: DataFrame, now: str | None = None) -> dict[str, DataFrame]:
    """Labels of single pairs: the score is logged only if the pair was unknown; review_state stays.

    ``labels`` and ``history`` have all columns of the label table.
    """
    known = labels.select("doc_id", "tag_id")
    logged = decisions.join(known, ["doc_id", "tag_id"], "left_anti").join(scores, ["doc_id", "tag_id"])
    logged = logged.select("doc_id", "tag_id", "score", *(["model_version"] if "model_version" in scores.columns else []))
    new = decisions.select("doc_id", "tag_id", "state", F.lit("human").alias("source"), "tag_version", moment(now).alias("created_at"))
    return {"labels": replace_labels(labels, new), "history": label_rows(new), "predictions": logged}


def discard_stale(labels: DataFrame, tags: DataFrame) -> DataFrame:
    """Labels without the human ones of an older tag version."""
    own = tags.select("tag_id", "version")
    stale = (F.col("source") == "human") & (F.col("tag_version") < F.col("version"))
    return labels.join(own, "tag_id", "left").where(~F.coalesce(stale, F.lit(False))).drop("version")


def queue_by_uncertainty(queue: DataFrame, scores: DataFrame, tags: DataFrame) -> DataFrame:
    """doc_id, uncertainty in this order: least distance of a score to its threshold; documents without scores last."""
    own = scores.where("score IS NOT NULL").join(tags.where("NOT archived").select("tag_id", "threshold"), "tag_id")
    gap = F.abs(F.col("score").cast("double") - F.coalesce(F.col("threshold").cast("double"), F.lit(0.5)))
    least = own.groupBy("doc_id").agg(F.min(gap).alias("uncertainty"))
    ranked = queue.select("doc_id").join(least, "doc_id", "left")
    return ranked.orderBy(F.asc_nulls_last("uncertainty"), "doc_id")


def retrain_due(documents: DataFrame, last_count: int = 0, every: int = 10) -> DataFrame:
    """n_validated, due: whether the number of validated documents has crossed a multiple of ``every``."""
    n = F.count_if(F.col("review_state") == "validated")
    return documents.agg(n.alias("n_validated")).withColumn(
        "due", (F.col("n_validated") > 0) & (F.floor(F.col("n_validated") / every) > F.floor(F.lit(last_count) / every))
    )


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``current`` replaced by those of ``new`` with the same keys; of several new ones the last by ``order``."""
    if order:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, "s.*")
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*current.columns))


def apply_document_updates(documents: DataFrame, updates: DataFrame, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``updates`` (doc_id and others) put in where they are not null, those in ``nullable`` also where they are."""
    others = [c for c in updates.columns if c != "doc_id"]
    new = updates.select("doc_id", F.lit(True).alias("hit"), *[F.col(c).alias(f"new_{c}") for c in others])

    def value(c: str):
        if c not in others:
            return F.col(c)
        return (F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)) if c in nullable else F.coalesce(f"new_{c}", c)).alias(c)

    return documents.join(new, "doc_id", "left").select(*[value(c) for c in documents.columns])


def upsert_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Drawing pages by (doc_id, page): a rotation survives only while the source publication is the same."""
    old = pages.select("doc_id", "page", F.col("source").alias("old_source"), F.col("rotation").alias("old_rotation"))
    fresh = new.join(old, ["doc_id", "page"], "left").select(
        "doc_id", "page", "source",
        F.when(F.col("source").eqNullSafe(F.col("old_source")), F.coalesce("old_rotation", F.lit(0))).otherwise(0).alias("rotation"),
    )
    return pages.join(new.select("doc_id", "page"), ["doc_id", "page"], "left_anti").select("doc_id", "page", "source", "rotation").unionByName(fresh)


def set_rotation(pages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, rejected edits): rotations of 0, 90, 180 or 270 of known pages."""
    valid = edits.where(F.col("rotation").isin(0, 90, 180, 270)).join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    rejected = edits.join(valid.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    new = valid.select("doc_id", "page", F.col("rotation").alias("r"))
    after = pages.join(new, ["doc_id", "page"], "left").withColumn("rotation", F.coalesce("r", "rotation")).drop("r")
    return after, rejected
