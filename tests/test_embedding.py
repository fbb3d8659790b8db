"""Embedders: words at once against one by one, learned axes against a whole SVD."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import terms, vectors
from tagloom.operators import embedding

TEXTS = ["One two  two", "", "  \n", "É𝛼 one\tÉ𝛼", "two"]


def test_words_at_once():
    out = np.zeros((len(TEXTS), 8))
    for i, t in enumerate(TEXTS):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % 8] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    assert np.allclose(vectors.HashedTerms(8).embed(TEXTS), out / np.where(norm > 0, norm, 1))
    counts = terms.term_counts(TEXTS, 16)
    assert counts.sum(1).tolist() == [len(t.split()) for t in TEXTS]
    assert vectors.HashedTerms(8).embed([]).shape == (0, 8)


def near(x: np.ndarray) -> list[set[int]]:
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return [set(np.argsort(-r, kind="stable")[:10]) for r in s]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_learned_axes_against_a_whole_svd(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").repartition(3)
    model = embedding.fit_terms(docs, "text", dim=8, features=512, passes=12)
    texts = [r.text for r in docs.where("text IS NOT NULL").orderBy("doc_id").collect()]
    counts = terms.term_counts(texts, 512)
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1
    assert np.allclose(model.idf, idf)
    x = terms.weighted(counts, idf)
    _, values, v = np.linalg.svd(x, full_matrices=False)
    # the same space where it is apart from the next axis, and the same order of neighbours
    kept = np.linalg.norm(model.axes.T @ v[:8].T, axis=0)
    assert kept[:6].min() > 0.99
    whole = x @ v[:8].T
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    both = [len(a & b) for a, b in zip(near(model.embed(texts).astype(float)), near(whole), strict=True)]
    assert np.mean(both) > 9
    rows = vectors.embed(docs, "text", model).where(F.size("vector") == 8)
    assert rows.count() == len(texts) and rows.first().model_id == model.model_id


def test_without_texts(spark):
    none = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert embedding.fit_terms(none, "text", dim=4, features=16).embed(["a b"]).shape == (1, 4)
    few = spark.createDataFrame([(1, "a"), (2, "")], "doc_id bigint, text string")
    assert np.isfinite(embedding.fit_terms(few, "text", dim=4, features=16).embed(["a", "", "zz"])).all()
