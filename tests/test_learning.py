"""Neighbours, scoring rows, retraining, automation, edits and streams against plain versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.functions import sampling, vectors
from tagloom.operators import automation, corpus, evaluation, exports, labels, library, neighbours, outline, retraining, scoring, sql_functions, tags
from tagloom.streaming import jobs


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    # few different directions, so that many products tie
    x = rng.integers(-1, 2, (90, 5)).astype(np.float32)
    return x, spark.createDataFrame([(i, x[i].tolist(), (i * 37) % 90) for i in range(90)], "doc_id bigint, vector array<float>, turn bigint").repartition(3)


@pytest.mark.parametrize("block", [None, 7])
@pytest.mark.parametrize("order_col", [None, "turn"])
def test_neighbours_equal_brute_force(frame, block, order_col, monkeypatch):
    x, df = frame
    monkeypatch.setattr(neighbours, "TILE", (4, 11))
    monkeypatch.setattr(neighbours, "LEAST_ROWS", 20)
    got = neighbours.nearest_neighbours(df, df, 6, order_col, skip_self=True, block=block).collect()
    sims = x.astype(float) @ x.T.astype(float)
    want = set()
    for q in range(90):
        able = [n for n in range(90) if n != q and (order_col is None or (n * 37) % 90 < (q * 37) % 90)]
        best = sorted(able, key=lambda n: (-sims[q, n], n))[:6]
        want |= {(q, n, sims[q, n], r + 1) for r, n in enumerate(best)}
    assert {(r.q_id, r.n_id, r.sim, r.rank) for r in got} == want and len(got) == len(want)


def test_products_are_the_same_joined(frame, monkeypatch):
    x, df = frame
    own = df.where("doc_id < 4").select(F.col("doc_id").alias("tag_id"), F.col("vector").alias("w"), (F.col("doc_id") / 8).alias("b"))
    a = {(r.doc_id, r.tag_id): r.z for r in scoring.products(df, own, "w", "b").collect()}
    monkeypatch.setattr(scoring, "MAX_TAGS", 2)
    b = {(r.doc_id, r.tag_id): r.z for r in scoring.products(df, own, "w", "b").collect()}
    assert a == b == {(i, t): float(x[i] @ x[t]) + t / 8 for i in range(90) for t in range(4)}
    assert scoring.products(df, own.limit(0), "w").count() == 0


def _tags(spark, rows):
    return spark.createDataFrame(rows, "tag_id bigint, name string, definition string, parent_id bigint, color string, hotkey string, archived boolean, version int")


def test_edits_of_one_batch_meet_each_other(spark):
    t = _tags(spark, [(i, f"t{i}", "d", None, None, None, False, 1) for i in range(6)])
    edits = spark.createDataFrame(
        [(0, "same", "d", None, None, "x", False), (1, "same", "d", None, None, None, False), (2, "t2", "d", None, None, "X", True), (3, "t3", "d", 4, None, None, False),
         (4, "t4", "d", 3, None, None, False), (5, "t5", "e", 0, "red", "y", True)],
        "tag_id bigint, name string, definition string, parent_id bigint, color string, hotkey string, bump boolean",
    )
    after, rejected, changed = tags.apply_tag_edits(t, edits)
    assert {r.tag_id: r.reason for r in rejected.collect()} == {1: "duplicate_name", 2: "hotkey_in_use", 3: "invalid_parent", 4: "invalid_parent"}
    rows = {r.tag_id: r for r in after.collect()}
    assert rows[0].name == "same" and rows[1].name == "t1" and rows[5].parent_id == 0 and rows[5].version == 2 and rows[3].parent_id is None
    assert {r.tag_id for r in changed.collect()} == {0, 5}


def test_retraining(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, "m1", x[i].tolist()) for i in range(40)], "doc_id bigint, model_id string, vector array<float>")
    states = [(i, t, "pos" if x[i, t] > 0 else "neg", "human") for i in range(40) for t in (0, 1, 3)] + [(i, 2, "pos", "human") for i in range(3)]
    own = spark.createDataFrame(states, "doc_id bigint, tag_id bigint, state string, source string")
    t = spark.createDataFrame([(i, 0.9, 0.1, i == 3) for i in range(4)], "tag_id bigint, threshold float, neg_threshold float, archived boolean")
    log = spark.createDataFrame([(i, i, 0, float(1 / (1 + np.exp(-x[i, 0])))) for i in range(40)], "id bigint, doc_id bigint, tag_id bigint, score float")
    old = spark.createDataFrame([(i, [1.0], 0.0, 7, 7, "before") for i in (0, 2, 3)], "tag_id bigint, weights array<double>, bias double, n_pos bigint, n_neg bigint, trained_at string")
    models, after = retraining.retrain(t, own, v, log, old, "now")
    assert {r.tag_id: r.trained_at for r in models.collect()} == {0: "now", 1: "now", 2: "before", 3: "before"}
    rows = {r.tag_id: r for r in after.collect()}
    steps = np.arange(101, dtype=np.float32) * np.float32(0.01)
    score, pos = np.array([r.score for r in log.collect()], np.float32), x[:, 0] > 0
    precise = [s for s in steps if (score >= s).any() and pos[score >= s].mean() >= 0.95]
    recalled = [s for s in steps if (pos & (score >= s)).sum() >= 0.95 * pos.sum()]
    assert abs(rows[0].threshold - min(precise)) < 1e-6 and abs(rows[0].neg_threshold - max(recalled)) < 1e-6
    assert rows[1].threshold is None and rows[2].neg_threshold is None and abs(rows[3].threshold - 0.9) < 1e-6


def test_automation_outputs(spark):
    docs = spark.createDataFrame([(i, "queued", "fetched") for i in range(4)], "doc_id bigint, review_state string, fetch_status string")
    t = spark.createDataFrame([(1, True, 0.5, 0.2, False), (2, True, 0.5, 0.2, False)], "tag_id bigint, auto_enabled boolean, threshold float, neg_threshold float, archived boolean")
    scores = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 1, 0.9), (1, 2, 0.3), (2, 1, 0.05), (3, 1, 0.7)], "doc_id bigint, tag_id bigint, score double")
    have = spark.createDataFrame([(2, 2, "pos", "human", None), (3, 2, "neg", "auto", 0.15)], "doc_id bigint, tag_id bigint, state string, source string, confidence double")
    out = automation.full_automation(docs, scores, t, have, 0.0)
    assert {r.doc_id for r in out["completed"].collect()} == {0, 2, 3}
    assert {(r.doc_id, r.tag_id, r.score) for r in out["predictions"].collect()} == {(0, 1, 0.9), (0, 2, 0.1), (2, 1, 0.05), (3, 1, 0.7), (3, 2, 0.15)}
    assert {r.doc_id: sorted(r.tags) for r in out["positives"].collect()} == {0: [1], 2: [2], 3: [1]}
    assert {r.doc_id: r.review_state for r in out["documents"].collect()} == {0: "auto_completed", 1: "queued", 2: "auto_completed", 3: "auto_completed"}
    off = automation.full_automation(docs, scores, t, have, 0.0, enabled=False)
    assert {(r.doc_id, r.tag_id, r.state) for r in off["written"].collect()} == {(0, 1, "pos"), (1, 1, "pos"), (3, 1, "pos")}
    assert off["completed"].isEmpty() and off["predictions"].isEmpty() and off["documents"].where("review_state <> 'queued'").isEmpty()


def test_labels_survive_passes(spark):
    """The label table that a pass gives is one that the next pass, a review and the statistics can start from."""
    docs = spark.createDataFrame([(i, "queued", "fetched") for i in range(3)], "doc_id bigint, review_state string, fetch_status string")
    t = spark.createDataFrame([(1, True, 0.5, 0.2, False, 4), (2, True, 0.5, 0.2, False, 1)], "tag_id bigint, auto_enabled boolean, threshold float, neg_threshold float, archived boolean, version int")
    scores = spark.createDataFrame([(0, 1, 0.9, "v1"), (0, 2, 0.3, "v1"), (1, 1, 0.05, "v1"), (1, 2, 0.8, "v1")], "doc_id bigint, tag_id bigint, score double, model_version string")
    have = spark.createDataFrame([(2, 1, "pos", "human", 3), (2, 2, "neg", "auto", 1)], "doc_id bigint, tag_id bigint, state string, source string, tag_version int")
    first = automation.full_automation(docs, scores, t, have, 0.0, now="2024-05-01")
    rows = {(r.doc_id, r.tag_id): (r.state, r.source, r.confidence, r.model_version, r.tag_version, str(r.created_at)[:10]) for r in first["labels"].collect()}
    assert rows == {
        (0, 1): ("pos", "auto", 0.9, "v1", 4, "2024-05-01"), (1, 1): ("neg", "auto", 0.05, "v1", 4, "2024-05-01"), (1, 2): ("pos", "auto", 0.8, "v1", 1, "2024-05-01"),
        (2, 1): ("pos", "human", None, None, 3, "None"), (2, 2): ("neg", "auto", None, None, 1, "None"),
    }
    assert {(r.doc_id, r.tag_id, r.model_version, r.score) for r in first["predictions"].collect()} == {(1, 1, "v1", 0.05), (1, 2, "v1", 0.8)}
    # the next model decides the open pair; what the first pass wrote is logged with its own confidence and model
    later = spark.createDataFrame([(0, 1, 0.1, "v2"), (0, 2, 0.7, "v2")], "doc_id bigint, tag_id bigint, score double, model_version string")
    second = automation.full_automation(docs, later, t, first["labels"], 0.0, now="2024-06-01")
    assert [(r.doc_id, r.tag_id, r.confidence, r.model_version, r.tag_version) for r in second["written"].collect()] == [(0, 2, 0.7, "v2", 1)]
    assert {(r.doc_id, r.tag_id, r.model_version, r.score) for r in second["predictions"].collect()} >= {(0, 1, "v1", 0.9), (0, 2, "v2", 0.7)}
    stats = {r.tag_id: r for r in labels.tag_stats(t, second["labels"], second["documents"]).collect()}
    assert (stats[1].human_pos, stats[1].auto_pos, stats[1].auto_neg, stats[1].stale) == (1, 1, 1, 1)
    review = labels.validate(spark.createDataFrame([(0, [2])], "doc_id bigint, checked array<bigint>"), t, second["labels"], docs, now="2024-07-01")
    rows = {(r.doc_id, r.tag_id): (r.state, r.source, r.confidence, r.model_version, r.tag_version) for r in review["labels"].collect()}
    assert rows[0, 1] == ("neg", "human", None, None, 4) and rows[0, 2] == ("pos", "human", None, None, 1) and rows[1, 2] == ("pos", "auto", 0.8, "v1", 1)
    assert review["history"].columns == second["written"].columns == review["labels"].columns
    pairs = labels.label_pairs(spark.createDataFrame([(1, 1, "pos", 4)], "doc_id bigint, tag_id bigint, state string, tag_version int"), review["labels"], scores)
    assert pairs["labels"].count() == 6 and pairs["predictions"].isEmpty()


def test_highlights(spark):
    text = "Heading\n\n[0007] first words here.\nplain text."
    marks = spark.createDataFrame(
        [(1, 1, "description", 1, 4, False), (2, 1, "description", 8, 9, False), (3, 1, "description", 18, 20, False), (4, 1, "description", 2, 3, True), (5, 2, "title", 0, 1, False)],
        "id bigint, doc_id bigint, section string, new_start int, new_stop int, detached boolean",
    )
    blocks = outline.description_blocks(spark.createDataFrame([(1, text), (3, None)], "doc_id bigint, description string")).withColumn("section", F.lit("description"))
    got = {r.id: r.location for r in outline.highlight_locations(marks, blocks).collect()}
    assert got == {1: "Description, heading", 2: "Description", 3: "Description [0007]", 4: "Description", 5: "Title"}
    h = spark.createDataFrame([(1, "q", None, "pink"), (2, "r", "old", "blue")], "id bigint, quote string, comment string, color string")
    edits = spark.createDataFrame([(1, " new ", "green"), (2, " ", "blue"), (3, "x", "blue"), (2, "x", "black")], "id bigint, comment string, color string")
    after, rejected = outline.edit_highlights(h, edits.limit(3))
    assert {(r.id, r.comment, r.color) for r in after.collect()} == {(1, "new", "green"), (2, None, "blue")} and [r.id for r in rejected.collect()] == [3]
    left, unknown = outline.delete_highlights(h, edits.where("id <> 1").select("id").distinct())
    assert [r.id for r in left.collect()] == [1] and [r.id for r in unknown.collect()] == [3]
    many = spark.createDataFrame([(1, 0, 4, "ab", "𝛼ab ab ab"), (2, 0, 2, "", "x"), (3, 0, 2, "zz", None)], "id bigint, start int, stop int, quote string, text string")
    assert {r.id: (r.new_start, r.detached) for r in outline.resolve_highlights(many).collect()} == {1: (2, False), 2: (0, True), 3: (0, True)}


def test_searches_updates_and_reviews(spark):
    state = spark.createDataFrame([("b", 5), ("A", 1), ("c", 9)], "search string, next_start bigint")
    assert [r.search for r in corpus.list_searches(state).collect()] == ["A", "b", "c"]
    assert {r.search for r in corpus.delete_searches(state, state.where("search = 'b'")).collect()} == {"A", "c"}
    assert {r.search: r.next_start for r in corpus.restart_search(state, state.where("search = 'c'")).collect()} == {"A": 1, "b": 5, "c": 1}
    docs = spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], "doc_id bigint, a string, b string")
    new = spark.createDataFrame([(1, None, None)], "doc_id bigint, a string, b string")
    assert {(r.doc_id, r.a, r.b) for r in labels.apply_document_updates(docs, new, ("b",)).collect()} == {(1, "x", None), (2, "x", "y")}
    t = spark.createDataFrame([(1, False, 3), (2, True, 1)], "tag_id bigint, archived boolean, version int")
    none = spark.createDataFrame([], "doc_id bigint, tag_id bigint, state string, source string, tag_version int")
    queue = spark.createDataFrame([(1, "queued"), (2, "queued")], "doc_id bigint, review_state string")
    scores = spark.createDataFrame([(1, 1, 0.5, True), (1, 2, 0.5, True), (2, 1, 0.1, False)], "doc_id bigint, tag_id bigint, score double, suggested boolean")
    out = labels.validate(spark.createDataFrame([(1, [1])], "doc_id bigint, checked array<bigint>"), t, none, queue, scores)
    assert [(r.doc_id, r.tag_id, r.score) for r in out["predictions"].collect()] == [(1, 1, 0.5)] and out["labels"].count() == 1


def test_terms_without_marks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Čeština škoda ŐRÜLT", "e\u0301te été"), (2, None, "")], "doc_id bigint, title string, abstract string")
    index = library.build_term_index(docs)
    assert {(r.token, r.section): r.positions for r in index.collect()} == {
        ("cestina", "title"): [0], ("skoda", "title"): [1], ("orult", "title"): [2], ("ete", "abstract"): [0, 1]
    }
    assert [r.doc_id for r in library.text_match(index, phrases=(("ete", "ete"),), sections=("abstract",)).collect()] == [1]
    assert library.text_match(index, all_of=("skoda",), sections=("abstract",)).isEmpty()


def test_sql_surface(spark):
    vectors.register(spark)
    rows = spark.sql("SELECT b.* FROM (SELECT 'intro\n1. A lamp\nwith glass\n2) Another' AS t) x, LATERAL claim_blocks(t) b").collect()
    assert [(r.n, r.label, r.start, r.stop) for r in rows] == [(0, None, 0, 5), (1, "1", 6, 26), (2, "2", 27, 37)]
    assert spark.sql("SELECT l2_normalise(array(3.0D, 4.0D)) AS v, l2_normalise(array(0.0D)) AS z").first().asDict() == {"v": [0.6, 0.8], "z": [0.0]}


def test_learning_in_sql(spark):
    sql_functions.register_learning(spark)
    rng = np.random.default_rng(8)
    rows = [(int(i % 3), float(np.float32(round(rng.random(), 2))), bool(rng.random() < 0.5)) for i in range(400)] + [(5, None, True), (5, 0.5, None), (6, float("nan"), True)]
    frame = spark.createDataFrame(rows, "tag_id bigint, score float, is_pos boolean")
    frame.createOrReplaceTempView("scored_rows")
    got = {r.tag_id: r for r in spark.sql("SELECT * FROM evaluate_tag(TABLE(scored_rows) PARTITION BY (tag_id), 0.5D, 0.9D)").collect()}
    low = {r.tag_id: r.threshold for r in evaluation.calibrate_threshold(frame, 0.5).collect()}
    high = {r.tag_id: r.neg_threshold for r in evaluation.calibrate_neg_threshold(frame, 0.9).collect()}
    able = {r.tag_id: (r.n_pos, r.n_evaluated, r.eligible) for r in evaluation.eligibility(frame, 0.5).collect()}
    half = {r.tag_id: (r.precision, r.recall) for r in evaluation.precision_recall(frame.where("is_pos IS NOT NULL")).collect()}
    for t in got:
        assert (got[t].threshold, got[t].neg_threshold, (got[t].n_pos, got[t].n, got[t].eligible)) == (low[t], high[t], able[t])
        assert (got[t].precision, got[t].recall) == half[t]
    ids = spark.createDataFrame([(i,) for i in [*range(500), -3, 2**62 + 1, None]], "id bigint")
    assert ids.selectExpr("audit_unit(id) AS a", "audit_sampled(id, 0.3D) AS s", "id").select(
        F.bool_and(F.col("a").eqNullSafe(sampling.audit_unit(F.col("id")).cast("float"))), F.bool_and(F.col("s").eqNullSafe(sampling.audit_sampled(F.col("id"), 0.3)))
    ).first() == (True, True)
    samples = [(t, float(i % 2), [float(i % 7), float(t), 1.0 * (i % 2)]) for t in (1, 2) for i in range(30)] + [(3, 1.0, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(samples, "tag_id bigint, y double, vector array<double>")
    frame.createOrReplaceTempView("samples")
    fitted = {r.tag_id: (r.weights, r.bias, r.n_pos, r.n_neg) for r in spark.sql("SELECT * FROM fit_tag(TABLE(samples) PARTITION BY (tag_id))").collect()}
    want = {r.tag_id: (r.weights, r.bias, r.n_pos, r.n_neg) for r in scoring.train_classifiers(frame).collect()}
    assert fitted.keys() == want.keys() == {1, 2}
    for t in want:
        assert np.allclose(fitted[t][0], want[t][0], atol=1e-9) and abs(fitted[t][1] - want[t][1]) < 1e-9 and fitted[t][2:] == want[t][2:]


def test_json_rows_have_highlights(spark, tmp_path):
    docs = spark.createDataFrame([(1, "EP1", "T", "EP.1.A1", "fetched"), (2, "EP2", None, None, "fetched")], "doc_id bigint, pub_key string, title string, abstract_source string, fetch_status string")
    none = spark.createDataFrame([], "doc_id bigint, tag_id bigint, state string")
    marks = spark.createDataFrame(
        [(2, 1, "claims", 0, "b", None, "blue"), (1, 1, "title", 4, "a", "c", "pink")], "id bigint, doc_id bigint, section string, start int, quote string, comment string, color string"
    )
    rows = exports.export_rows(docs, none, spark.createDataFrame([], "tag_id bigint, name string"), marks)
    exports.write_json(rows, str(tmp_path / "j"))
    exports.write_csv(rows, str(tmp_path / "c"))
    got = {r.publication_number: r for r in spark.read.json(str(tmp_path / "j")).collect()}
    assert [(h.section, h.quote, h.comment) for h in got["EP1"].highlights] == [("title", "a", "c"), ("claims", "b", None)] and got["EP2"].highlights == []
    assert got["EP1"].sources == ["abstract EP.1.A1"] and got["EP2"].sources == []
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_streamed_evaluation_and_scoring(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, i, i % 2, float(np.float32(rng.random())), bool(rng.random() < 0.5)) for i in range(200)]
    scored = spark.createDataFrame(rows, "id bigint, doc_id bigint, tag_id bigint, score float, is_pos boolean")
    for part in ("id < 90", "id >= 90"):
        scored.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    config = automation.EngineConfig(target_precision=0.5, target_recall=0.9)
    source = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.evaluation_monitor(source, config).writeStream.outputMode("update").format("memory").queryName("evaluated").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {r.tag_id: r for r in spark.table("evaluated").where("n = 100").collect()}
    high = {r.tag_id: r.threshold for r in evaluation.calibrate_threshold(scored, 0.5).collect()}
    low = {r.tag_id: r.neg_threshold for r in evaluation.calibrate_neg_threshold(scored, 0.9).collect()}
    assert len(last) == 2 and all(abs(last[t].threshold - high[t]) < 1e-6 and abs(last[t].neg_threshold - low[t]) < 1e-6 for t in (0, 1))

    x = rng.normal(size=(30, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "doc_id bigint, vector array<float>")
    state = {
        "pool": v.where("doc_id < 20"),
        "tags": spark.createDataFrame([(0, 0.5, 0.1, True, False), (1, None, None, False, False)], "tag_id bigint, threshold float, neg_threshold float, auto_enabled boolean, archived boolean"),
        "labels": spark.createDataFrame([(i, 0, "pos" if i % 3 else "neg", "human") for i in range(20)], "doc_id bigint, tag_id bigint, state string, source string"),
        "classifiers": spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], 0.0, "t1")], "tag_id bigint, weights array<double>, bias double, trained_at string"),
        "tag_vectors": spark.createDataFrame([(1, x[0].tolist())], "tag_id bigint, vector array<float>"),
    }
    v.where("doc_id >= 20").coalesce(1).write.parquet(str(tmp_path / "v"))
    out = []
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "v"))
    q = jobs.score_batches(stream, lambda: state, lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cv")).start()
    q.processAllAvailable()
    q.stop()
    want = scoring.score_rows(v.where("doc_id >= 20"), *(state[k] for k in ("pool", "tags", "labels", "classifiers", "tag_vectors"))).collect()
    assert len(out) == 20 and {(r.doc_id, r.tag_id): (r.source, r.model_version, r.suggested) for r in out} == {(r.doc_id, r.tag_id): (r.source, r.model_version, r.suggested) for r in want}
    assert {r.decision for r in out if r.tag_id == 1} == {"not_automatic"} and {r.model_version for r in out if r.tag_id == 0} == {"m1+lr@t1"}


def test_terms_of_few_texts_at_a_time(monkeypatch):
    """A task takes as many texts as have about ``WORDS`` words, with the same postings."""
    rows = [["a", "b", "a"], [], ["c"] * 30, None, ["a"] * 4, ["b", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["title"] * 6), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "section", "tokens"])

    def postings() -> list[dict]:
        return sorted((r for b in library._positions(iter([batch.slice(1), batch.slice(0, 1)])) for r in b.to_pylist()), key=repr)

    want = postings()
    monkeypatch.setattr(library, "WORDS", 6)
    parts = [b.num_rows for b in library._few_words(iter([batch]))]
    assert parts == [2, 1, 3] and postings() == want and len(want) == 6
