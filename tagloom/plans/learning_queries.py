"""Queries of the learning loop: scores, evaluation, audits, decisions, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sampling import audit_sampled, audit_unit
from ..operators import audit, automation, cells, corpus, evaluation, labels, neighbours, retraining, scoring, sql_functions
from ..sources.tables import spark_table, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register a query under its function's name, with SQL over the named derived tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_clause(sql, *tables)
        return f

    return add


class T:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = (spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        return spark_table(*self._at, name)

    def queue(self) -> DataFrame:
        return self.a_vectors.where("doc_id % 2 = 1")

    def pool(self) -> DataFrame:
        return self.a_vectors.where("doc_id % 2 = 0")


def r6(c) -> F.Column:
    return F.round(c, 6)


_DOT = "list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[]))"
_NEIGHBOURS = f"""
near AS (SELECT q_id, n_id, sim, rank FROM (
  SELECT q.doc_id AS q_id, n.doc_id AS n_id, {_DOT} AS sim,
         row_number() OVER (PARTITION BY q.doc_id ORDER BY {_DOT} DESC, n.doc_id) AS rank
  FROM a_vectors q JOIN a_vectors n ON q.doc_id % 2 = 1 AND n.doc_id % 2 = 0) WHERE rank <= 10)"""
_KNN = (
    _NEIGHBOURS
    + """,
knn AS (SELECT q_id AS doc_id, tag_id,
  sum(CASE WHEN state = 'pos' THEN greatest(sim, 0) ELSE 0 END) / nullif(sum(greatest(sim, 0)), 0) AS knn
  FROM near JOIN a_labels l ON l.doc_id = n_id AND source = 'human' GROUP BY q_id, tag_id)"""
)


@query(f"WITH {_NEIGHBOURS} SELECT q_id, n_id, round(sim, 6) AS sim, rank FROM near", "a_vectors")
def nearest_neighbours(spark, sf_dir):
    t = T(spark, sf_dir)
    return neighbours.nearest_neighbours(t.queue(), t.pool()).withColumn("sim", r6("sim"))


@query(f"WITH {_NEIGHBOURS} SELECT q_id, n_id, round(sim, 6) AS sim, rank FROM near", "a_vectors")
def pruned_neighbours(spark, sf_dir):
    """The same over cells: only those whose bound reaches the k-th similarity are searched."""
    t = T(spark, sf_dir)
    return cells.cell_neighbours(t.queue(), cells.cell_index(t.pool())).withColumn("sim", r6("sim"))


@query()
def probed_neighbours(spark, sf_dir):
    """Approximate: eight cells a query."""
    t = T(spark, sf_dir)
    return cells.cell_neighbours(t.queue(), cells.cell_index(t.pool()), probes=8).withColumn("sim", r6("sim"))


@query(
    f"""WITH {_KNN} SELECT knn.doc_id, knn.tag_id, round(knn, 6) AS knn,
    coalesce(CAST(knn AS FLOAT) >= t.threshold, false) OR coalesce(l.state = 'pos', false) AS suggested
    FROM knn JOIN a_tags t ON t.tag_id = knn.tag_id LEFT JOIN a_labels l ON l.doc_id = knn.doc_id AND l.tag_id = knn.tag_id""",
    "a_vectors", "a_labels", "a_tags",
)
def knn_scores(spark, sf_dir):
    """Which tags does each unreviewed document probably carry?"""
    t = T(spark, sf_dir)
    scores = scoring.knn_scores(neighbours.nearest_neighbours(t.queue(), t.pool()), t.a_labels).withColumn("score", F.col("knn")).withColumn("source", F.lit("knn"))
    return scoring.with_suggested(scores, t.a_tags, t.a_labels).select("doc_id", "tag_id", r6("knn").alias("knn"), "suggested")


@query(
    """SELECT q_id, n_id, sim, rank FROM (
      SELECT q.doc_id AS q_id, n.doc_id AS n_id, round(list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[])), 6) AS sim,
        row_number() OVER (PARTITION BY q.doc_id ORDER BY list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[])) DESC, n.doc_id) AS rank
      FROM a_vectors q JOIN a_vectors n ON q.doc_id % 50 = 0 AND q.doc_id <> n.doc_id) WHERE rank <= 10""",
    "a_vectors",
)
def similar_documents(spark, sf_dir):
    t = T(spark, sf_dir)
    return neighbours.similar_to(t.a_vectors.where("doc_id % 50 = 0"), t.a_vectors).withColumn("sim", r6("sim"))


@query(
    """SELECT q_id, n_id, sim, rank FROM (
      SELECT q.doc_id AS q_id, n.doc_id AS n_id, round(list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[])), 6) AS sim,
        row_number() OVER (PARTITION BY q.doc_id ORDER BY list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[])) DESC, n.doc_id) AS rank
      FROM a_vectors q JOIN a_vectors n ON n.doc_id < q.doc_id) WHERE rank <= 10""",
    "a_vectors",
)
def prequential_neighbours(spark, sf_dir):
    """Replay: neighbours among what was validated before (by id)."""
    t = T(spark, sf_dir)
    v = t.a_vectors.withColumn("turn", F.col("doc_id"))
    return neighbours.nearest_neighbours(v, v, order_col="turn").withColumn("sim", r6("sim"))


@query(
    """SELECT q_id, n_id, sim, rank FROM (
      SELECT q.doc_id AS q_id, n.doc_id AS n_id, round(list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[])), 6) AS sim,
        row_number() OVER (PARTITION BY q.doc_id ORDER BY list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[])) DESC, n.doc_id) AS rank
      FROM a_vectors q JOIN a_vectors n ON n.doc_id < q.doc_id) WHERE rank <= 10""",
    "a_vectors",
)
def pruned_replay(spark, sf_dir):
    """The replay over cells."""
    v = T(spark, sf_dir).a_vectors.withColumn("turn", F.col("doc_id"))
    return cells.cell_neighbours(v, cells.cell_index(v, order_col="turn"), order_col="turn").withColumn("sim", r6("sim"))


@query(
    """SELECT v.doc_id, v.model_id FROM a_vectors v JOIN a_documents d ON d.doc_id = v.doc_id WHERE d.review_state = 'validated'""",
    "a_vectors", "a_documents",
)
def validated_pool(spark, sf_dir):
    t = T(spark, sf_dir)
    return scoring.validated_pool(t.a_vectors, t.a_documents).select("doc_id", "model_id")


@query(
    """SELECT l.doc_id, l.tag_id, CASE WHEN state = 'pos' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM a_labels l JOIN a_vectors v ON v.doc_id = l.doc_id WHERE source = 'human'""",
    "a_labels", "a_vectors",
)
def training_samples(spark, sf_dir):
    t = T(spark, sf_dir)
    return scoring.training_samples(t.a_labels, t.a_vectors).select("doc_id", "tag_id", "y")


@query("SELECT tag_id, count(*) FILTER (WHERE source = 'human' AND state = 'pos') AS n_pos FROM a_labels GROUP BY tag_id", "a_labels")
def human_positives(spark, sf_dir):
    return scoring.human_positives(T(spark, sf_dir).a_labels)


_CENTROID = """
pos AS (SELECT l.tag_id, generate_subscripts(v.vector, 1) AS i, unnest(CAST(v.vector AS DOUBLE[])) AS x
        FROM a_labels l JOIN a_vectors v ON v.doc_id = l.doc_id WHERE source = 'human' AND state = 'pos'),
m AS (SELECT tag_id, i, avg(x) AS m FROM pos GROUP BY tag_id, i),
c AS (SELECT tag_id, list(m ORDER BY i) AS tv FROM m GROUP BY tag_id)"""


@query(
    f"""WITH {_CENTROID} SELECT v.doc_id, c.tag_id,
    round(greatest(0, least(1, (list_dot_product(CAST(v.vector AS DOUBLE[]), tv) / sqrt(list_dot_product(tv, tv)) + 1) / 2)), 6) AS zero_shot
    FROM a_vectors v CROSS JOIN c""",
    "a_vectors", "a_labels",
)
def zero_shot_scores(spark, sf_dir):
    t = T(spark, sf_dir)
    tags = scoring.tag_centroids(scoring.training_samples(t.a_labels, t.a_vectors))
    return scoring.zero_shot_scores(t.a_vectors, tags).withColumn("zero_shot", r6("zero_shot"))


@query()
def trained_classifiers(spark, sf_dir):
    t = T(spark, sf_dir)
    return scoring.train_classifiers(scoring.training_samples(t.a_labels, t.a_vectors))


@query(
    """WITH w AS (SELECT doc_id AS tag_id, vector AS weights, 0.1 AS bias FROM a_vectors WHERE doc_id < 10)
    SELECT v.doc_id, w.tag_id, round(1 / (1 + exp(-(list_dot_product(CAST(v.vector AS DOUBLE[]), CAST(weights AS DOUBLE[])) + 0.1))), 6) AS lr FROM a_vectors v CROSS JOIN w""",
    "a_vectors",
)
def classifier_scores(spark, sf_dir):
    """Prediction with given weights: the first ten vectors stand for them."""
    v = T(spark, sf_dir).a_vectors
    weights = v.where("doc_id < 10").select(F.col("doc_id").alias("tag_id"), F.col("vector").alias("weights"), F.lit(0.1).alias("bias"))
    return scoring.lr_scores(v, weights).withColumn("lr", r6("lr"))


@query()
def score_documents(spark, sf_dir):
    t = T(spark, sf_dir)
    samples = scoring.training_samples(t.a_labels, t.a_vectors)
    return scoring.score_documents(t.queue(), t.pool(), t.a_tags, t.a_labels, scoring.train_classifiers(samples), scoring.tag_centroids(samples))


@query(
    f"""WITH {_KNN}, n AS (SELECT tag_id, count(*) FILTER (WHERE source = 'human' AND state = 'pos') AS n_pos FROM a_labels GROUP BY tag_id),
    w AS (SELECT doc_id AS tag_id, CAST(vector AS DOUBLE[]) AS weights FROM a_vectors WHERE doc_id < 8),
    g AS (SELECT q.doc_id, t.tag_id, t.auto_enabled, t.threshold, t.neg_threshold, n_pos, knn.knn, 1 / (1 + exp(-(list_dot_product(CAST(q.vector AS DOUBLE[]), weights) + 0.1))) AS lr
      FROM a_vectors q CROSS JOIN a_tags t LEFT JOIN w ON w.tag_id = t.tag_id LEFT JOIN knn ON knn.doc_id = q.doc_id AND knn.tag_id = t.tag_id LEFT JOIN n ON n.tag_id = t.tag_id
      WHERE q.doc_id % 2 = 1 AND NOT t.archived),
    s AS (SELECT *, CASE WHEN lr IS NOT NULL AND knn IS NOT NULL THEN n_pos / (n_pos + 20) * lr + (1 - n_pos / (n_pos + 20)) * knn ELSE coalesce(lr, knn) END AS blended FROM g),
    f AS (SELECT *, CAST(blended AS FLOAT) AS score FROM s)
    SELECT f.doc_id, f.tag_id, round(blended, 6) AS score, CASE WHEN lr IS NOT NULL AND knn IS NOT NULL THEN 'blended' WHEN lr IS NOT NULL THEN 'lr' WHEN knn IS NOT NULL THEN 'knn' END AS source,
      CASE WHEN lr IS NULL THEN 'm1' ELSE 'm1+lr@2026-01-02T03:04:05Z' END AS model_version,
      coalesce(l.state = 'pos', false) OR coalesce(score >= threshold, false) AS suggested, coalesce(l.source = 'auto', false) AS automatic,
      NOT coalesce(l.source = 'auto', false) AND CASE WHEN NOT auto_enabled THEN 'not_automatic' WHEN score IS NULL THEN 'uncertain' WHEN score >= threshold THEN 'pos' WHEN score < neg_threshold THEN 'neg' ELSE 'uncertain' END = 'uncertain' AS uncertain
    FROM f LEFT JOIN a_labels l ON l.doc_id = f.doc_id AND l.tag_id = f.tag_id""",
    "a_vectors", "a_labels", "a_tags",
)
def scored_rows(spark, sf_dir):
    """All columns of the scoring row, with given weights: the first vectors stand for the trained ones of the first tags."""
    t = T(spark, sf_dir)
    given = t.a_vectors.where("doc_id < 8").select(
        F.col("doc_id").alias("tag_id"), F.col("vector").alias("weights"), F.lit(0.1).alias("bias"), F.lit("2026-01-02T03:04:05Z").alias("trained_at")
    )
    centroids = scoring.tag_centroids(scoring.training_samples(t.a_labels, t.a_vectors))
    return scoring.score_rows(t.queue(), t.pool(), t.a_tags, t.a_labels, given, centroids).withColumn("score", r6("score"))


@query(
    f"""WITH {_CENTROID}, n AS (SELECT tag_id, count(*) FILTER (WHERE source = 'human' AND state = 'pos') AS n_pos FROM a_history GROUP BY tag_id)
    SELECT v.doc_id, c.tag_id, round(greatest(0, least(1, (list_dot_product(CAST(v.vector AS DOUBLE[]), tv) / sqrt(list_dot_product(tv, tv)) + 1) / 2)), 6) AS zero_shot
    FROM a_vectors v CROSS JOIN c LEFT JOIN n ON n.tag_id = c.tag_id WHERE coalesce(n_pos, 0) < 3""",
    "a_vectors", "a_labels", "a_history",
)
def zero_shot_of_new_tags(spark, sf_dir):
    """Zero-shot scores of the tags for which the history has fewer than three human positives."""
    t = T(spark, sf_dir)
    tags = scoring.tag_centroids(scoring.training_samples(t.a_labels, t.a_vectors))
    return scoring.zero_shot_scores(t.a_vectors, tags, scoring.human_positives(t.a_history)).withColumn("zero_shot", r6("zero_shot"))


@query("SELECT tag_id, version = 1 AS found FROM a_tags WHERE tag_id IN (SELECT doc_id FROM a_vectors) OR version <> 1", "a_tags", "a_vectors")
def current_tag_vectors(spark, sf_dir):
    """Which tags have a vector of their present version, where vectors of version 1 are there?"""
    t = T(spark, sf_dir)
    there = t.a_vectors.select(F.col("doc_id").alias("tag_id"), "model_id", F.lit(1).alias("tag_version"), "vector")
    found, missing = scoring.tag_vectors_current(t.a_tags, there, "m1")
    return found.select("tag_id", F.lit(True).alias("found")).unionByName(missing.withColumn("found", F.lit(False)))


@query(
    """WITH near AS (SELECT q_id, n_id, sim FROM (
      SELECT q.doc_id AS q_id, n.doc_id AS n_id, list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[])) AS sim,
        row_number() OVER (PARTITION BY q.doc_id ORDER BY list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(n.vector AS DOUBLE[])) DESC, n.doc_id) AS rank
      FROM a_vectors q JOIN a_vectors n ON n.doc_id < q.doc_id) WHERE rank <= 10)
    SELECT q_id AS doc_id, tag_id, round(sum(CASE WHEN state = 'pos' THEN greatest(sim, 0) ELSE 0 END) / nullif(sum(greatest(sim, 0)), 0), 6) AS score
    FROM near JOIN a_labels l ON l.doc_id = n_id AND source = 'human' GROUP BY q_id, tag_id""",
    "a_vectors", "a_labels",
)
def prequential_predictions(spark, sf_dir):
    """What the neighbours validated before each document (by id) said about its tags."""
    t = T(spark, sf_dir)
    return scoring.prequential_replay(t.a_vectors.withColumn("turn", F.col("doc_id")), t.a_labels, "turn").withColumn("score", r6("score"))


_SCORED = """
scored AS (SELECT p.id, p.doc_id, p.tag_id, p.score, l.state = 'pos' AS is_pos
           FROM a_predictions p JOIN a_labels l ON l.doc_id = p.doc_id AND l.tag_id = p.tag_id AND l.source = 'human'),
win AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY tag_id ORDER BY id DESC) <= 300)"""
_GRID = (
    _SCORED
    + """,
grid AS (SELECT tag_id, step, count(*) FILTER (WHERE is_pos AND hit) AS tp, count(*) FILTER (WHERE hit) AS pp, count(*) FILTER (WHERE is_pos) AS pos, count(*) AS n
         FROM (SELECT win.*, s.step, score >= CAST(s.step AS FLOAT) * CAST(0.01 AS FLOAT) AS hit FROM win CROSS JOIN (SELECT unnest(range(101)) AS step) s)
         GROUP BY tag_id, step),
thr AS (SELECT tag_id, min(step) FILTER (WHERE pp > 0 AND tp / pp >= 0.6) AS lo, max(step) FILTER (WHERE pos > 0 AND tp / pos >= 0.95) AS hi FROM grid GROUP BY tag_id)"""
)
_PRED = ("a_predictions", "a_labels")


def _window(spark, sf_dir) -> DataFrame:
    t = T(spark, sf_dir)
    return evaluation.evaluation_window(evaluation.scored_labels(t.a_predictions, t.a_labels))


@query(f"WITH {_SCORED} SELECT id, doc_id, tag_id, score, is_pos FROM scored", *_PRED)
def scored_labels(spark, sf_dir):
    t = T(spark, sf_dir)
    return evaluation.scored_labels(t.a_predictions, t.a_labels)


@query(f"WITH {_SCORED} SELECT id, doc_id, tag_id, score, is_pos FROM win", *_PRED)
def evaluation_window(spark, sf_dir):
    return _window(spark, sf_dir)


@query(
    f"""WITH {_SCORED} SELECT tag_id, round(count(*) FILTER (WHERE is_pos AND score >= 0.5::FLOAT) / nullif(count(*) FILTER (WHERE score >= 0.5::FLOAT), 0), 6) AS precision,
    round(count(*) FILTER (WHERE is_pos AND score >= 0.5::FLOAT) / nullif(count(*) FILTER (WHERE is_pos), 0), 6) AS recall, count(*) AS n, count(*) FILTER (WHERE is_pos) AS pos FROM win GROUP BY tag_id""",
    *_PRED,
)
def precision_recall(spark, sf_dir):
    return evaluation.precision_recall(_window(spark, sf_dir)).withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query(
    f"""WITH {_SCORED} SELECT tag_id, CAST(step AS INT) AS step, round(count(*) FILTER (WHERE is_pos AND hit) / nullif(count(*) FILTER (WHERE hit), 0), 6) AS precision,
    round(count(*) FILTER (WHERE is_pos AND hit) / nullif(count(*) FILTER (WHERE is_pos), 0), 6) AS recall
    FROM (SELECT win.*, s.step, score >= CAST(s.step AS FLOAT) * CAST(0.05 AS FLOAT) AS hit FROM win CROSS JOIN (SELECT unnest(range(21)) AS step) s) GROUP BY tag_id, step""",
    *_PRED,
)
def pr_curve(spark, sf_dir):
    return evaluation.pr_curve(_window(spark, sf_dir)).withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query(f"WITH {_GRID} SELECT tag_id, round(lo * 0.01, 6)::DOUBLE AS threshold FROM thr", *_PRED)
def calibrated_thresholds(spark, sf_dir):
    return evaluation.calibrate_threshold(_window(spark, sf_dir), 0.6).withColumn("threshold", r6(F.col("threshold").cast("double")))


@query(f"WITH {_GRID} SELECT tag_id, round(hi * 0.01, 6)::DOUBLE AS neg_threshold FROM thr", *_PRED)
def calibrated_neg_thresholds(spark, sf_dir):
    return evaluation.calibrate_neg_threshold(_window(spark, sf_dir)).withColumn("neg_threshold", r6(F.col("neg_threshold").cast("double")))


@query(
    f"""WITH {_GRID} SELECT w.tag_id, w.n_pos, w.n_evaluated, round(lo * 0.01, 6)::DOUBLE AS threshold, n_pos >= 30 AND n_evaluated >= 150 AND lo IS NOT NULL AS eligible
    FROM (SELECT tag_id, count(*) FILTER (WHERE is_pos) AS n_pos, count(*) AS n_evaluated FROM win GROUP BY tag_id) w JOIN thr ON thr.tag_id = w.tag_id""",
    *_PRED,
)
def eligibility(spark, sf_dir):
    return evaluation.eligibility(_window(spark, sf_dir), 0.6).withColumn("threshold", r6(F.col("threshold").cast("double")))


@query(
    f"""WITH {_GRID}, half AS (SELECT tag_id, count(*) FILTER (WHERE is_pos AND CAST(score AS FLOAT) >= 0.5) AS tp, count(*) FILTER (WHERE CAST(score AS FLOAT) >= 0.5) AS hit,
      count(*) FILTER (WHERE is_pos) AS n_pos, count(*) AS n FROM win GROUP BY tag_id)
    SELECT h.tag_id, round(tp / nullif(hit, 0), 6) AS precision, round(tp / nullif(n_pos, 0), 6) AS recall, n, n_pos, round(lo * 0.01, 6)::DOUBLE AS threshold,
      round(hi * 0.01, 6)::DOUBLE AS neg_threshold, n_pos >= 30 AND n >= 150 AND lo IS NOT NULL AS eligible FROM half h JOIN thr ON thr.tag_id = h.tag_id""",
    *_PRED,
)
def sql_evaluation(spark, sf_dir):
    """The whole evaluation of every tag as one SQL statement."""
    sql_functions.register_learning(spark)
    rows = spark.sql("SELECT * FROM evaluate_tag(TABLE(SELECT tag_id, score, is_pos FROM {win}) PARTITION BY (tag_id), 0.6D, 0.95D)", win=_window(spark, sf_dir))
    return rows.select(
        "tag_id", r6("precision").alias("precision"), r6("recall").alias("recall"), "n", "n_pos", r6(F.col("threshold").cast("double")).alias("threshold"),
        r6(F.col("neg_threshold").cast("double")).alias("neg_threshold"), "eligible",
    )


_OLD = "SELECT tag_id, 1 AS n_pos, 1 AS n_neg, 'before' AS trained_at FROM a_tags WHERE tag_id IN (3, 9)"


def _retrained(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = T(spark, sf_dir)
    old = t.a_tags.where("tag_id IN (3, 9)").select(
        "tag_id", F.array().cast("array<double>").alias("weights"), F.lit(0.0).alias("bias"), F.lit(1).cast("bigint").alias("n_pos"), F.lit(1).cast("bigint").alias("n_neg"),
        F.lit("before").alias("trained_at"),
    )
    return retraining.retrain(t.a_tags, t.a_labels, t.a_vectors, t.a_predictions, old, "now", automation.EngineConfig(target_precision=0.6))


@query(
    f"""WITH {_GRID} SELECT t.tag_id, CASE WHEN archived THEN round(CAST(t.threshold AS DOUBLE), 6) ELSE round(lo * 0.01, 6)::DOUBLE END AS threshold,
    CASE WHEN archived THEN round(CAST(t.neg_threshold AS DOUBLE), 6) ELSE round(hi * 0.01, 6)::DOUBLE END AS neg_threshold FROM a_tags t LEFT JOIN thr ON thr.tag_id = t.tag_id""",
    *_PRED, "a_tags",
)
def retrained_tags(spark, sf_dir):
    """Thresholds after retraining: of active tags new or none, of archived ones as they were."""
    return _retrained(spark, sf_dir)[1].select("tag_id", *(r6(F.col(c).cast("double")).alias(c) for c in ("threshold", "neg_threshold")))


@query(
    f"""WITH old AS ({_OLD}), n AS (SELECT l.tag_id, count(*) FILTER (WHERE state = 'pos') AS n_pos, count(*) FILTER (WHERE state = 'neg') AS n_neg FROM a_labels l
      JOIN a_tags t ON t.tag_id = l.tag_id AND NOT archived JOIN a_vectors v ON v.doc_id = l.doc_id WHERE source = 'human' GROUP BY l.tag_id),
    new AS (SELECT tag_id, n_pos, n_neg, 'now' AS trained_at FROM n WHERE n_pos >= 5 AND n_neg >= 5)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE tag_id NOT IN (SELECT tag_id FROM new)""",
    "a_labels", "a_tags", "a_vectors",
)
def retrained_classifiers(spark, sf_dir):
    """Which classifiers are new after retraining, and from how many samples; tags that don't train keep theirs."""
    return _retrained(spark, sf_dir)[0].select("tag_id", "n_pos", "n_neg", "trained_at")


_PAIRS = """
pairs AS (SELECT * FROM (SELECT id, doc_id, tag_id, state AS auto_state, source,
  first_value(CASE WHEN source = 'human' THEN state END IGNORE NULLS) OVER (PARTITION BY doc_id, tag_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS human_state
  FROM a_history) WHERE source = 'auto' AND human_state IS NOT NULL)"""


@query(f"WITH {_PAIRS} SELECT id, doc_id, tag_id, auto_state, human_state FROM pairs", "a_history")
def audited_pairs(spark, sf_dir):
    return audit.audited_pairs(T(spark, sf_dir).a_history)


@query(
    f"""WITH {_PAIRS} SELECT t.tag_id, round(avg((human_state = 'pos')::INT), 6) AS precision, count(p.id) AS n FROM a_tags t
    LEFT JOIN (SELECT * FROM pairs WHERE auto_state = 'pos' QUALIFY row_number() OVER (PARTITION BY tag_id ORDER BY id DESC) <= 50) p ON p.tag_id = t.tag_id GROUP BY t.tag_id""",
    "a_history", "a_tags",
)
def audited_precision(spark, sf_dir):
    t = T(spark, sf_dir)
    return audit.audited_precision(t.a_history, t.a_tags).withColumn("precision", r6("precision"))


_FULL_AUDIT = """
audits AS (SELECT tag_id, count(*) FILTER (WHERE auto_state = 'pos' AND human_state = 'pos') AS tp, count(*) FILTER (WHERE auto_state = 'pos') AS pp,
  count(*) FILTER (WHERE human_state = 'pos') AS hp, count(*) AS n
  FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY tag_id ORDER BY id DESC) <= 50) GROUP BY tag_id)"""


@query(f"WITH {_PAIRS}, {_FULL_AUDIT} SELECT tag_id, round(tp / nullif(pp, 0), 6) AS precision, round(tp / nullif(hp, 0), 6) AS recall, n FROM audits", "a_history")
def auto_completion_audit(spark, sf_dir):
    return audit.auto_completion_audit(T(spark, sf_dir).a_history).withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query(
    f"""WITH {_PAIRS}, {_FULL_AUDIT},
    one AS (SELECT tag_id, avg((human_state = 'pos')::INT) AS p, count(*) AS n
            FROM (SELECT * FROM pairs WHERE auto_state = 'pos' QUALIFY row_number() OVER (PARTITION BY tag_id ORDER BY id DESC) <= 50) GROUP BY tag_id)
    SELECT t.tag_id FROM a_tags t LEFT JOIN one ON one.tag_id = t.tag_id LEFT JOIN audits a ON a.tag_id = t.tag_id
    WHERE auto_enabled AND NOT archived AND ((one.n >= 10 AND one.p < 0.67) OR (a.n >= 10 AND (a.tp / nullif(a.pp, 0) < 0.67 OR a.tp / nullif(a.hp, 0) < 0.67)))""",
    "a_history", "a_tags",
)
def tags_to_suspend(spark, sf_dir):
    t = T(spark, sf_dir)
    return audit.tags_to_suspend(t.a_tags, t.a_history, 0.67, 0.67)


_DECISION = """CASE WHEN NOT auto_enabled THEN 'not_automatic' WHEN score IS NULL THEN 'uncertain' WHEN score >= threshold THEN 'pos' WHEN score < neg_threshold THEN 'neg' ELSE 'uncertain' END"""
_LATEST = "latest AS (SELECT doc_id, tag_id, arg_max(score, id) AS score FROM a_predictions GROUP BY doc_id, tag_id)"


@query(f"WITH {_LATEST} SELECT doc_id, tag_id, score FROM latest", "a_predictions")
def latest_scores(spark, sf_dir):
    return automation.latest_scores(T(spark, sf_dir).a_predictions)


@query(f"WITH {_LATEST} SELECT l.doc_id, l.tag_id, l.score, {_DECISION} AS decision FROM latest l JOIN a_tags t ON t.tag_id = l.tag_id", "a_predictions", "a_tags")
def tag_decisions(spark, sf_dir):
    t = T(spark, sf_dir)
    return automation.with_decision(automation.latest_scores(t.a_predictions), t.a_tags)


@query(
    f"""WITH {_LATEST}, d AS (SELECT l.doc_id, l.tag_id, {_DECISION} AS decision FROM latest l JOIN a_tags t ON t.tag_id = l.tag_id)
    SELECT d.doc_id, d.tag_id, decision, a.doc_id IS NOT NULL AS automatic, a.doc_id IS NULL AND decision = 'uncertain' AS uncertain
    FROM d LEFT JOIN a_labels a ON a.source = 'auto' AND a.doc_id = d.doc_id AND a.tag_id = d.tag_id""",
    "a_predictions", "a_tags", "a_labels",
)
def review_flags(spark, sf_dir):
    t = T(spark, sf_dir)
    decided = automation.with_decision(automation.latest_scores(t.a_predictions), t.a_tags)
    return automation.review_flags(decided, t.a_labels).select("doc_id", "tag_id", "decision", "automatic", "uncertain")


_READY = f"""{_LATEST}, auto_tags AS (SELECT tag_id, threshold, neg_threshold, auto_enabled FROM a_tags WHERE NOT archived),
recent AS (SELECT doc_id, max(id) AS last_id FROM a_predictions GROUP BY doc_id ORDER BY last_id DESC LIMIT 300),
d AS (SELECT r.doc_id, bool_and({_DECISION} IN ('pos', 'neg')) AS ok FROM recent r CROSS JOIN auto_tags t LEFT JOIN latest l ON l.doc_id = r.doc_id AND l.tag_id = t.tag_id GROUP BY r.doc_id)"""


@query(f"WITH {_READY} SELECT count(*) FILTER (WHERE ok) AS would_complete, count(*) AS total FROM d", "a_predictions", "a_tags")
def automation_readiness(spark, sf_dir):
    t = T(spark, sf_dir)
    return automation.automation_readiness(t.a_predictions, t.a_tags)


@query(
    f"""WITH {_LATEST} SELECT l.doc_id, l.tag_id, l.score FROM latest l JOIN a_tags t ON t.tag_id = l.tag_id
    WHERE auto_enabled AND NOT archived AND score >= threshold AND NOT EXISTS (SELECT 1 FROM a_labels x WHERE x.doc_id = l.doc_id AND x.tag_id = l.tag_id)""",
    "a_predictions", "a_tags", "a_labels",
)
def pending_auto_labels(spark, sf_dir):
    t = T(spark, sf_dir)
    scores = automation.latest_scores(t.a_predictions)
    return automation.pending_auto_labels(scores, t.a_tags, t.a_labels, scores.select("doc_id").distinct())


_VERSION = "'m1+lr@' || CAST({0}.tag_id AS VARCHAR)"
_LAB = """lab AS (SELECT doc_id, tag_id, state, source, CASE WHEN source = 'auto' THEN (tag_id + 1) / 16.0 END::DOUBLE AS confidence,
      CASE WHEN source = 'auto' AND tag_id % 2 = 0 THEN 'm0' END AS model_version, tag_version FROM a_labels)"""
LABEL_COLUMNS = ("doc_id", "tag_id", "state", "source", "confidence", "model_version", "tag_version")


def _versioned(scores: DataFrame) -> DataFrame:
    return scores.withColumn("model_version", F.concat(F.lit("m1+lr@"), F.col("tag_id").cast("string")))


def _known(t: T) -> DataFrame:
    """The labels, the automatic ones with the confidence and the model that they were written with."""
    auto = F.col("source") == "auto"
    return t.a_labels.withColumn("confidence", F.when(auto, (F.col("tag_id") + 1) / F.lit(16.0))).withColumn(
        "model_version", F.when(auto & (F.col("tag_id") % 2 == 0), "m0")
    )


@query(
    f"""WITH {_LATEST}, {_LAB}, w AS (SELECT l.doc_id, l.tag_id, CASE WHEN score >= threshold THEN 'pos' ELSE 'neg' END AS state, score, version FROM latest l JOIN a_tags t ON t.tag_id = l.tag_id
      WHERE auto_enabled AND (score >= threshold OR score < neg_threshold)
      AND NOT EXISTS (SELECT 1 FROM a_labels x WHERE x.doc_id = l.doc_id AND x.tag_id = l.tag_id AND x.source = 'human'))
    SELECT * FROM lab a WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = a.doc_id AND w.tag_id = a.tag_id)
    UNION ALL SELECT doc_id, tag_id, state, 'auto', CAST(score AS DOUBLE), {_VERSION.format('w')}, version FROM w""",
    "a_predictions", "a_tags", "a_labels",
)
def applied_auto_labels(spark, sf_dir):
    t = T(spark, sf_dir)
    decided = _versioned(automation.with_decision(automation.latest_scores(t.a_predictions), t.a_tags)).where("decision IN ('pos', 'neg')")
    return automation.apply_auto_labels(_known(t), decided.withColumnRenamed("decision", "state"), t.a_tags)[0].select(*LABEL_COLUMNS)


_SAMPLED = """a AS (SELECT doc_id, ((CAST(doc_id AS UHUGEINT) * 2654435761) % 18446744073709551616 + 11400714819323198485) % 18446744073709551616 AS h1 FROM documents),
    b AS (SELECT doc_id, xor(CAST(h1 AS UBIGINT), CAST(h1 // 32768 AS UBIGINT)) AS h2 FROM a)
    SELECT doc_id, CAST(CAST(((CAST(h2 AS UHUGEINT) % 4294967296 * 2685821657736338717 + (CAST(h2 AS UHUGEINT) // 4294967296 * 2685821657736338717 % 4294967296) * 4294967296) % 18446744073709551616) // 4294967296 AS FLOAT) / CAST(4294967295 AS FLOAT) < CAST(0.05 AS FLOAT) AS BOOLEAN) AS sampled FROM b"""


@query(f"WITH {_SAMPLED}")
def audit_sampling(spark, sf_dir):
    return T(spark, sf_dir).documents.select("doc_id", audit_sampled(F.col("doc_id"), 0.05).alias("sampled"))


@query(f"WITH {_SAMPLED}")
def sql_audit_sampling(spark, sf_dir):
    """The same by the SQL function."""
    sql_functions.register_learning(spark)
    return spark.sql("SELECT doc_id, audit_sampled(doc_id, 0.05D) AS sampled FROM {d}", d=T(spark, sf_dir).documents)



def _decided(enabled: str) -> str:
    """Every queued document with every active tag: its label's state, else the decision."""
    return f"""{_LATEST}, {_LAB}, decided AS (SELECT d.doc_id, t.tag_id, s.score, t.version, h.state AS have, h.confidence, h.model_version AS had, coalesce(h.state, {_DECISION.replace('auto_enabled', enabled)}) AS decision
    FROM a_documents d CROSS JOIN a_tags t LEFT JOIN latest s ON s.doc_id = d.doc_id AND s.tag_id = t.tag_id LEFT JOIN lab h ON h.doc_id = d.doc_id AND h.tag_id = t.tag_id
    WHERE review_state = 'queued' AND fetch_status = 'fetched' AND NOT archived)"""


def _automated(spark, sf_dir, everything: bool = False) -> dict[str, DataFrame]:
    t = T(spark, sf_dir)
    tags = t.a_tags.withColumn("auto_enabled", F.lit(True)) if everything else t.a_tags
    return automation.full_automation(t.a_documents, _versioned(automation.latest_scores(t.a_predictions)), tags, _known(t))


_AUTOMATED = ("a_documents", "a_tags", "a_labels", "a_predictions")


@query(
    f"""WITH {_decided('auto_enabled')} SELECT doc_id, tag_id, decision AS state, 'auto' AS source, CAST(score AS DOUBLE) AS confidence, {_VERSION.format('decided')} AS model_version, version AS tag_version
    FROM decided WHERE have IS NULL AND decision IN ('pos', 'neg')""",
    *_AUTOMATED,
)
def full_automation(spark, sf_dir):
    return _automated(spark, sf_dir)["written"].select(*LABEL_COLUMNS)


@query(
    f"""WITH {_decided('auto_enabled')}, w AS (SELECT doc_id, tag_id, decision AS state, 'auto' AS source, CAST(score AS DOUBLE) AS confidence, {_VERSION.format('decided')} AS model_version, version AS tag_version
      FROM decided WHERE have IS NULL AND decision IN ('pos', 'neg'))
    SELECT * FROM lab UNION ALL SELECT * FROM w""",
    *_AUTOMATED,
)
def automated_labels(spark, sf_dir):
    """The whole label table after a pass."""
    return _automated(spark, sf_dir)["labels"].select(*LABEL_COLUMNS)


@query(
    f"""WITH {_decided('true')}, sampling AS (WITH {_SAMPLED}), done AS (SELECT doc_id FROM decided GROUP BY doc_id HAVING bool_and(decision IN ('pos', 'neg')))
    SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM done) AND NOT sampled THEN 'auto_completed' ELSE review_state END AS review_state
    FROM a_documents d JOIN sampling s ON s.doc_id = d.doc_id""",
    *_AUTOMATED,
)
def automated_documents(spark, sf_dir):
    """Review states after a pass with all tags automatic: documents decided as a whole are done, but for the audited share."""
    return _automated(spark, sf_dir, True)["documents"].select("doc_id", "review_state")


@query(
    f"""WITH {_decided('true')}, sampling AS (WITH {_SAMPLED}), done AS (SELECT doc_id FROM decided GROUP BY doc_id HAVING bool_and(decision IN ('pos', 'neg')))
    SELECT d.doc_id, d.tag_id, CASE WHEN have IS NULL THEN {_VERSION.format('d')} ELSE coalesce(had, '') END AS model_version,
      round(CASE WHEN have IS NULL THEN CAST(d.score AS DOUBLE) ELSE confidence END, 6) AS score, true AS suggested FROM decided d JOIN sampling s ON s.doc_id = d.doc_id AND NOT sampled
    WHERE d.doc_id IN (SELECT doc_id FROM done) AND CASE WHEN have IS NULL THEN CAST(d.score AS DOUBLE) ELSE confidence END IS NOT NULL""",
    *_AUTOMATED,
)
def automated_predictions(spark, sf_dir):
    """Scores that the pass logs for the documents it completes."""
    return _automated(spark, sf_dir, True)["predictions"].withColumn("score", r6("score"))


@query(
    f"""WITH {_decided('true')}, sampling AS (WITH {_SAMPLED}), done AS (SELECT doc_id FROM decided GROUP BY doc_id HAVING bool_and(decision IN ('pos', 'neg')))
    SELECT (SELECT count(*) FILTER (WHERE fetch_status = 'fetched') FROM a_documents) AS fetched, (SELECT count(*) FROM done JOIN sampling USING (doc_id) WHERE NOT sampled) AS auto_completed,
      (SELECT count(*) FROM done JOIN sampling USING (doc_id) WHERE sampled) AS audited_samples, (SELECT count(*) FILTER (WHERE fetch_status IN ('error', 'not_found')) FROM a_documents) AS errors""",
    *_AUTOMATED,
)
def import_outcomes(spark, sf_dir):
    """What an import came to: fetched and failed documents, and what the pass after it decided."""
    out = _automated(spark, sf_dir, True)
    return corpus.import_outcomes(T(spark, sf_dir).a_documents, out["completed"], out["audited"])


@query(
    """WITH n AS (SELECT doc_id, count(DISTINCT tag_id) AS n FROM a_labels WHERE source = 'auto' AND tag_id IN (SELECT tag_id FROM a_tags WHERE NOT archived) GROUP BY doc_id),
    k AS (SELECT count(*) AS n_tags FROM a_tags WHERE NOT archived)
    SELECT count(*) FILTER (WHERE review_state = 'auto_completed') AS auto_completed,
    count(*) FILTER (WHERE review_state = 'queued' AND fetch_status = 'fetched' AND n = n_tags AND n_tags > 0) AS all_auto,
    count(*) FILTER (WHERE review_state = 'queued' AND fetch_status = 'fetched' AND n < n_tags) AS some_auto
    FROM a_documents d LEFT JOIN n ON n.doc_id = d.doc_id CROSS JOIN k""",
    "a_documents", "a_labels", "a_tags",
)
def automation_state_counts(spark, sf_dir):
    t = T(spark, sf_dir)
    return automation.automation_state_counts(t.a_documents, t.a_labels, t.a_tags)


@query(
    """WITH r AS (SELECT doc_id FROM a_documents WHERE review_state IN ('validated', 'auto_completed')),
    c AS (SELECT l.tag_id, count(*) FILTER (WHERE source = 'human' AND state = 'pos') AS human_pos, count(*) FILTER (WHERE source = 'human' AND state = 'neg') AS human_neg,
      count(*) FILTER (WHERE source = 'auto' AND state = 'pos') AS auto_pos, count(*) FILTER (WHERE source = 'auto' AND state = 'neg') AS auto_neg,
      count(*) FILTER (WHERE source = 'human' AND tag_version < version) AS stale,
      count(DISTINCT doc_id) FILTER (WHERE doc_id IN (SELECT doc_id FROM r)) AS labelled FROM a_labels l JOIN a_tags t ON t.tag_id = l.tag_id GROUP BY l.tag_id)
    SELECT t.tag_id, coalesce(human_pos, 0) AS human_pos, coalesce(human_neg, 0) AS human_neg, coalesce(auto_pos, 0) AS auto_pos, coalesce(auto_neg, 0) AS auto_neg,
      coalesce(stale, 0) AS stale, (SELECT count(*) FROM r) - coalesce(labelled, 0) AS unlabelled FROM a_tags t LEFT JOIN c ON c.tag_id = t.tag_id""",
    "a_documents", "a_labels", "a_tags",
)
def tag_stats(spark, sf_dir):
    t = T(spark, sf_dir)
    return labels.tag_stats(t.a_tags, t.a_labels, t.a_documents)


@query(
    """SELECT d.doc_id, t.tag_id, l.state AS previous_state, l.tag_version AS previous_version FROM a_documents d CROSS JOIN a_tags t
    LEFT JOIN a_labels l ON l.doc_id = d.doc_id AND l.tag_id = t.tag_id
    WHERE review_state IN ('validated', 'auto_completed') AND NOT archived AND (l.state IS NULL OR (l.source = 'human' AND l.tag_version < t.version))""",
    "a_documents", "a_labels", "a_tags",
)
def tag_review_candidates(spark, sf_dir):
    t = T(spark, sf_dir)
    return labels.tag_review_candidates(t.a_documents, t.a_labels, t.a_tags)


@query(
    f"""WITH {_LATEST}, c AS (SELECT d.doc_id, t.tag_id FROM a_documents d CROSS JOIN a_tags t LEFT JOIN a_labels l ON l.doc_id = d.doc_id AND l.tag_id = t.tag_id
      WHERE review_state IN ('validated', 'auto_completed') AND NOT archived AND (l.state IS NULL OR (l.source = 'human' AND l.tag_version < t.version)))
    SELECT c.doc_id, c.tag_id, s.score, row_number() OVER (PARTITION BY c.tag_id ORDER BY s.score DESC NULLS LAST, c.doc_id) AS rank
    FROM c LEFT JOIN latest s ON s.doc_id = c.doc_id AND s.tag_id = c.tag_id""",
    "a_documents", "a_labels", "a_tags", "a_predictions",
)
def tag_review_queue(spark, sf_dir):
    t = T(spark, sf_dir)
    c = labels.tag_review_candidates(t.a_documents, t.a_labels, t.a_tags).select("doc_id", "tag_id")
    return labels.tag_review_queue(c, automation.latest_scores(t.a_predictions))


@query(
    """SELECT doc_id, coalesce(list(DISTINCT tag_id ORDER BY tag_id) FILTER (WHERE state = 'pos' AND source = 'human'), []) AS human_pos,
    coalesce(list(DISTINCT tag_id ORDER BY tag_id) FILTER (WHERE state = 'pos'), []) AS pos, coalesce(list(DISTINCT tag_id ORDER BY tag_id) FILTER (WHERE source = 'auto'), []) AS auto
    FROM a_labels GROUP BY doc_id""",
    "a_labels",
)
def label_sets(spark, sf_dir):
    return labels.label_sets(T(spark, sf_dir).a_labels)


@query("SELECT doc_id, tag_id, arg_max(state, id) AS state, arg_max(source, id) AS source FROM a_history GROUP BY doc_id, tag_id", "a_history")
def labels_from_history(spark, sf_dir):
    return labels.labels_from_history(T(spark, sf_dir).a_history)


@query(
    f"""WITH {_LAB}, n AS (SELECT d.doc_id, t.tag_id, CASE WHEN t.tag_id IN (d.doc_id % 10, (d.doc_id + 3) % 10) THEN 'pos' ELSE 'neg' END AS state, 'human' AS source, t.version AS tag_version
      FROM (SELECT doc_id FROM a_vectors WHERE doc_id % 5 = 1) d CROSS JOIN a_tags t WHERE NOT archived)
    SELECT * FROM lab l WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = l.doc_id AND n.tag_id = l.tag_id)
    UNION ALL SELECT doc_id, tag_id, state, source, NULL, NULL, tag_version FROM n""",
    "a_vectors", "a_tags", "a_labels",
)
def validated_labels(spark, sf_dir):
    t = T(spark, sf_dir)
    decisions = t.a_vectors.where("doc_id % 5 = 1").select("doc_id", F.array(F.col("doc_id") % 10, (F.col("doc_id") + 3) % 10).alias("checked"))
    return labels.validate(decisions, t.a_tags, _known(t), t.a_documents)["labels"].select(*LABEL_COLUMNS)


@query(
    """SELECT l.doc_id, l.tag_id, l.state, l.source, l.tag_version FROM a_labels l JOIN a_tags t ON t.tag_id = l.tag_id WHERE NOT (l.source = 'human' AND l.tag_version < t.version)""",
    "a_labels", "a_tags",
)
def labels_without_stale(spark, sf_dir):
    t = T(spark, sf_dir)
    return labels.discard_stale(t.a_labels, t.a_tags).select("doc_id", "tag_id", "state", "source", "tag_version")


@query(
    f"""WITH {_LATEST}, u AS (SELECT l.doc_id, min(abs(CAST(score AS DOUBLE) - coalesce(CAST(threshold AS DOUBLE), 0.5))) AS u FROM latest l JOIN a_tags t ON t.tag_id = l.tag_id WHERE NOT archived GROUP BY l.doc_id)
    SELECT d.doc_id, round(u, 6) AS uncertainty FROM a_documents d LEFT JOIN u ON u.doc_id = d.doc_id WHERE fetch_status = 'fetched' AND review_state = 'queued'""",
    "a_documents", "a_predictions", "a_tags",
)
def queue_by_uncertainty(spark, sf_dir):
    t = T(spark, sf_dir)
    queue = t.a_documents.where("fetch_status = 'fetched' AND review_state = 'queued'")
    return labels.queue_by_uncertainty(queue, automation.latest_scores(t.a_predictions), t.a_tags).select("doc_id", r6("uncertainty").alias("uncertainty"))


@query("SELECT count(*) FILTER (WHERE review_state = 'validated') AS n_validated, count(*) FILTER (WHERE review_state = 'validated') >= 10 AS due FROM a_documents", "a_documents")
def retrain_due(spark, sf_dir):
    return labels.retrain_due(T(spark, sf_dir).a_documents)
