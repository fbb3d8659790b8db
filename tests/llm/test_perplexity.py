"""Perplexity of left-out texts: against plain counts, and junk on both sides of the band."""

from __future__ import annotations

import base64
import math
import random
from collections import Counter

import pytest

pytest.importorskip("tagloom.llm")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402

from tagloom.llm.common import Workspace  # noqa: E402
from tagloom.llm.quality_rules import ORDER, Model, _discounts, _grams, _pairs, left_out, log_perplexity, quality_rules  # noqa: E402
from tagloom.llm.text_arrays import text_chunks  # noqa: E402

from .test_documents import words_of  # noqa: E402


def plain_model(grams: list[int]) -> tuple[dict, dict]:
    """Counts of every order from the highest one's n-grams, and discounts."""
    levels = {ORDER: Counter(grams)}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = Counter(x & ((1 << 8 * k) - 1) for x in levels[k + 1])
    return levels, {k: _discounts([sum(c == i for c in level.values()) for i in (1, 2, 3, 4)]) for k, level in levels.items()}


def plain_probability(x: int, k: int, levels: dict, discounts: dict) -> float:
    """Interpolated modified Kneser-Ney probability of the last byte of a k-gram."""
    if not k:
        return 1 / 256
    d = discounts[k]
    x &= (1 << 8 * k) - 1
    near = {y: c for y, c in levels[k].items() if y >> 8 == x >> 8}
    rest = plain_probability(x, k - 1, levels, discounts)
    if not near:
        return rest
    c = near.get(x, 0)
    return (c - d[min(c, 3)] + sum(d[min(y, 3)] for y in near.values()) * rest) / sum(near.values())


TEXTS = ["abracadabra abba", "cab aba zz", "abracadabra abba", "bad cab zz top"]


def array_model(levels: dict, discounts: dict) -> Model:
    grams, contexts, places = ([], []), ([], [], [], [], []), {}
    for k in sorted(levels):
        start, first = len(grams[0]), len(contexts[0])
        for g in sorted(levels[k]):
            grams[0].append(g)
            grams[1].append(levels[k][g])
        for c in sorted({g >> 8 for g in levels[k]}):
            own = [n for g, n in levels[k].items() if g >> 8 == c]
            for column, x in zip(contexts, (c, sum(own), own.count(1), own.count(2), sum(n > 2 for n in own)), strict=True):
                column.append(x)
        places[k, None] = ((start, len(grams[0])), (first, len(contexts[0])), discounts[k])
    return Model(dict(zip(("g", "n"), map(np.array, grams), strict=True)), dict(zip(("ctx", "total", "c1", "c2", "c3"), map(np.array, contexts), strict=True)), places)


def test_left_out_equals_counts_of_the_other_texts():
    (chunk,) = text_chunks(pa.array(TEXTS))
    gram, text = _grams(chunk)
    levels, discounts = plain_model(gram.tolist())
    model = array_model(levels, discounts)
    t, g, n = _pairs(gram, text)
    got = left_out(t, g, n, np.array([2, 1, 2, 1])[t], lambda k, grams, contexts: model.of(k, None, grams, contexts))
    for i, own in enumerate(TEXTS):
        others, _ = plain_model([x for j, x in enumerate(gram.tolist()) if TEXTS[text[j]] != own])
        want = [math.log(plain_probability(x, ORDER, others, discounts)) for x in g[t == i].tolist()]
        assert np.allclose(got[t == i], want, atol=1e-12)
    # all bytes after a context, seen or not, share a probability of one
    for context in (0x6162, 0x636162):
        k = 1 + (context.bit_length() + 7) // 8
        assert abs(sum(plain_probability(context << 8 | b, k, levels, discounts) for b in range(256)) - 1) < 1e-9


def test_log_perplexity_equals_plain_model(spark):
    """Brute force, per language, from the texts to the perplexities, through files, several to a model."""
    from tagloom.llm import quality_rules as q

    rows = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "aa") for t in TEXTS), ("zz top zz", None), ("top zz", None), ("", "aa"), (None, "aa")])]
    whole = q._FILE_ROWS
    q._FILE_ROWS = 40
    try:
        got = {r.doc_id: r.log_ppl for r in log_perplexity(Workspace(spark, "t"), spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    finally:
        q._FILE_ROWS = whole
    for lang in ("aa", None):
        own = [(i, t) for i, t, x in rows if x == lang and t]
        (chunk,) = text_chunks(pa.array([t for _, t in own]))
        gram, text = _grams(chunk)
        _, discounts = plain_model(gram.tolist())
        for j, (i, t) in enumerate(own):
            others, _ = plain_model([x for x, k in zip(gram.tolist(), text.tolist(), strict=True) if own[k][1] != t])
            logs = [math.log(plain_probability(x, ORDER, others, discounts)) for x in gram[text == j].tolist()]
            assert abs(got[i] + sum(logs) / len(logs)) < 1e-9
    assert got[6] is None and got[7] is None


LONG = ["".join(random.Random(i).sample("abcdefghijklmnopqrstuvwxyz", 26)) for i in range(6)]


def junk(r: random.Random) -> dict[int, str]:
    french = ("qui", "vez", "œuv", "eau", "ç", "jou", "gî", "lle")
    return {
        9000: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(60)),
        9001: " ".join(base64.b64encode(r.randbytes(30)).decode() for _ in range(40)),
        9002: " ".join("".join(r.choice(french) for _ in range(r.randint(1, 4))) for _ in range(80)),
        9003: "".join(chr(r.randint(0xA1, 0xFF)) if r.random() < 0.85 else " " for _ in range(600)),
        # below the band: six long words in any order, in texts that are no copies of each other
        **{9004 + i: " ".join(r.choice(LONG) for _ in range(25)) for i in range(12)},
    }


def test_junk_is_rejected_and_clean_texts_stay(spark):
    bad = junk(random.Random(4))
    rows = [(i, words_of(60 + i % 50, 5000 + i), "en") for i in range(300)] + [(i, t, "en") for i, t in bad.items()]
    rows += [(9100, bad[9000], "en")]  # an exact copy of junk does not vouch for it
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in range(300))
    clean = [got[i].log_ppl for i in range(300)]
    for i in (9000, 9001, 9002, 9003, 9100):
        assert not got[i].base_failed and not got[i].kept and got[i].log_ppl > max(clean)
    for i in range(9004, 9016):
        assert not got[i].base_failed and not got[i].kept and got[i].log_ppl < min(clean)
