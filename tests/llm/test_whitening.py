"""Whitening against plain numpy, with edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

pytest.importorskip("tagloom.llm")

from tagloom.llm.whitening import whiten  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, members int, w string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "x", 1, "w") for i, v in rows], SCHEMA).repartition(parts)


def collected(df):
    got: dict = {}
    for r in df.collect():
        got.setdefault(r.vec_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.component) for k, v in got.items()}


def plain(rows, components=4):
    x = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in rows}
    fit = np.array(sorted(set(x.values())), dtype=object)
    n, s = len(fit), fit.sum(0)
    a = (fit - 0).astype(float) - np.array([v / n for v in s])
    e, axes = np.linalg.eigh(a.T @ a / n)
    e, axes = e[::-1], axes[:, ::-1]
    out = {}
    for i, own in x.items():
        dev = sum((n * c - t) ** 2 for c, t in zip(own, s, strict=True))
        centred = np.array(own, float) - np.array([v / n for v in s])
        out[i] = (n, dev, centred @ axes[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum())
    return out


def test_against_numpy(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(700, 9)) * [3, 1, 0.5, 0.2, 0.1, 0.1, 2, 0.7, 0.3] + 4
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist()) for i in range(400)]
    bad = [(2000, None), (2001, [None] + [1.0] * 8), (2002, [float("nan")] * 9), (2003, [float("inf")] + [0.0] * 8), (2004, []), (2005, [1.0] * 5), (2006, [1e30] + [0.0] * 8)]
    got, want = collected(whiten(frame(spark, rows + bad))), plain(rows)
    assert set(got) == set(want)
    signs = np.sign([g.whitened * w for g, w in zip(got[0], want[0][2], strict=True)])
    for i, own in got.items():
        n, dev, w, share = want[i]
        assert [(g.component, g.n, g.deviation) for g in own] == [(c, n, dev) for c in (1, 2, 3, 4)]
        assert np.allclose([g.whitened for g in own] * signs, w, atol=1e-8)
        assert np.allclose([g.explained for g in own], share, rtol=1e-9)
        assert all(g.identity_error < 1e-9 for g in own)


def test_rows_come_back_as_often_as_they_are(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, 0.0]), (3, [2.0, -1.0])]
    got = whiten(frame(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in rows for c in (1, 2))
    assert {r.n for r in got} == {3}


def test_no_variance(spark):
    got = whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)}
    # one direction of two: the other component has nothing to tell
    got = whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(6)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    assert all(abs(r.identity_error) < 1e-9 for r in got)


def test_large_sums_stay_exact(spark):
    rows = [(i, [float(2**36 + 4096 * i), float(i)]) for i in range(5)]
    got, want = collected(whiten(frame(spark, rows))), plain(rows, 2)
    for i, own in got.items():
        assert own[0].deviation == want[i][1]


def test_empty(spark):
    got = whiten(frame(spark, []))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(frame(spark, [(1, None)])).count() == 0
