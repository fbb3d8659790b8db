"""Passes that have no SQL, against plain versions on small frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions import sampling, vectors
from tagloom.operators import automation, scoring


def test_full_automation(spark):
    documents = spark.createDataFrame(
        [(i, "queued" if i % 4 else "validated", "fetched" if i % 5 else "error") for i in range(40)], "doc_id bigint, review_state string, fetch_status string"
    )
    tags = spark.createDataFrame(
        [(1, True, 0.5, 0.2, False), (2, True, 0.6, 0.3, False), (3, True, 0.1, 0.05, True)],
        "tag_id bigint, auto_enabled boolean, threshold float, neg_threshold float, archived boolean",
    )
    scores = {(i, t): (i * 7 + t * 13) % 20 / 20 for i in range(40) for t in (1, 2, 3) if (i + t) % 9}
    labels = {(i, t): ("pos", "human" if i % 2 else "auto") for i in range(40) for t in (1, 2) if (i * t) % 6 == 1}
    out = automation.full_automation(
        documents,
        spark.createDataFrame([(*k, v) for k, v in scores.items()], "doc_id bigint, tag_id bigint, score double"),
        tags,
        spark.createDataFrame([(*k, *v) for k, v in labels.items()], "doc_id bigint, tag_id bigint, state string, source string"),
        0.0,
    )
    limits = {1: (0.5, 0.2), 2: (0.6, 0.3)}
    written, complete = {}, set()
    for i in range(40):
        if i % 4 == 0 or i % 5 == 0:
            continue
        decided = []
        for t, (high, low) in limits.items():
            s = scores.get((i, t))
            d = None if s is None else "pos" if np.float32(s) >= np.float32(high) else "neg" if np.float32(s) < np.float32(low) else None
            if (i, t) in labels:
                d = labels[(i, t)][0]
            elif d:
                written[(i, t)] = d
            decided.append(d)
        if all(decided):
            complete.add(i)
    assert {(r.doc_id, r.tag_id): r.state for r in out["written"].collect()} == written
    assert {r.doc_id for r in out["completed"].collect()} == complete and out["audited"].isEmpty()
    after = {(r.doc_id, r.tag_id): (r.state, r.source) for r in out["labels"].collect()}
    assert after == {**{k: (v, "auto") for k, v in written.items()}, **labels}


def test_score_documents(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "doc_id bigint, vector array<float>")
    truth = {(i, t): x[i, t] > 0 for i in range(40) for t in (0, 1)}
    labels = spark.createDataFrame([(i, t, "pos" if p else "neg", "human") for (i, t), p in truth.items()], "doc_id bigint, tag_id bigint, state string, source string")
    tags = spark.createDataFrame([(0, False), (1, False), (2, False), (3, True)], "tag_id bigint, archived boolean")
    samples = labels.join(frame, "doc_id").select("doc_id", "tag_id", F.when(F.col("state") == "pos", 1.0).otherwise(0.0).alias("y"), "vector")
    own = spark.createDataFrame([(2, x[0].tolist())], "tag_id bigint, vector array<float>")
    got = {
        (r.doc_id, r.tag_id): r
        for r in scoring.score_documents(frame.where("doc_id >= 40"), frame.where("doc_id < 40"), tags, labels, scoring.train_classifiers(samples), own).collect()
    }
    assert len(got) == 60
    d = x.astype(float)
    for t in (0, 1):
        y = np.array([truth[(i, t)] for i in range(40)], float)
        w, b = scoring.fit(d[:40], y)
        share = y.sum() / (y.sum() + 20)
        for q in range(40, 60):
            sims = d[q] @ d[:40].T
            near = np.argsort(-sims, kind="stable")[:10]
            weight = np.maximum(sims[near], 0)
            want = share / (1 + np.exp(-(d[q] @ w + b))) + (1 - share) * (weight * y[near]).sum() / weight.sum()
            assert abs(got[(q, t)].score - want) < 1e-6 and got[(q, t)].source == "blended"
    assert all(abs(got[(q, 2)].score - (d[q] @ d[0] + 1) / 2) < 1e-6 and got[(q, 2)].source == "zero_shot" for q in range(40, 60))


def test_embedding(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id bigint, input string")
    known = spark.createDataFrame([(3, "hashed-64")], "doc_id bigint, model_id string")
    rows = vectors.embed(df, "input", vectors.HashedTerms(), known).collect()
    assert [r.doc_id for r in rows] == [1] and np.allclose(rows[0].vector, vectors.HashedTerms().embed(["one two"])[0])


def test_sampled_documents_stay(spark):
    ids = [r.id for r in spark.range(2000).where(sampling.audit_sampled(F.col("id"), 0.05)).collect()]
    docs = spark.createDataFrame([(ids[0], "queued", "fetched"), (ids[0] + 1, "queued", "fetched")], "doc_id bigint, review_state string, fetch_status string")
    tags = spark.createDataFrame([(1, True, 0.5, 0.2, False)], "tag_id bigint, auto_enabled boolean, threshold float, neg_threshold float, archived boolean")
    scores = docs.select("doc_id", F.lit(1).cast("bigint").alias("tag_id"), F.lit(0.9).alias("score"))
    none = spark.createDataFrame([], "doc_id bigint, tag_id bigint, state string, source string")
    out = automation.full_automation(docs, scores, tags, none)
    assert [r.doc_id for r in out["audited"].collect()] == [ids[0]] and out["completed"].count() == 1


def test_products_evaluate_their_tags_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    w, x = rng.normal(size=(23, 4)), rng.normal(size=(9, 4))
    runs = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            runs.add(len(f))
            yield f

    tags = spark.createDataFrame([(i, v.tolist(), float(i)) for i, v in enumerate(w)], "tag_id bigint, w array<double>, b double").repartition(3)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "doc_id bigint, vector array<double>")
    want = {(i, j): v for (i, j), v in np.ndenumerate(x @ w.T + np.arange(23))}
    for most in (4096, 5):  # tags of all at a time, and in turns
        monkeypatch.setattr(scoring, "MAX_TAGS", most)
        before = runs.value
        got = {(r.doc_id, r.tag_id): r.z for r in scoring.products(docs, tags.mapInPandas(counted, tags.schema), "w", "b").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert runs.value - before == 23 or most == 5
    assert scoring.products(docs, tags.limit(0), "w").isEmpty()
