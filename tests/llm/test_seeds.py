"""Miss rate of the seed masks at the least share of equal words that the verification accepts."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("tagloom.llm")

from tagloom.llm.decontaminate import MASKS, WINDOW, _offsets, least_same, overlaps  # noqa: E402

from .test_documents import words_of  # noqa: E402


def miss_rate(length: int, substitutions: int, tries: int = 500) -> float:
    r = random.Random(1)
    missed = 0
    for _ in range(tries):
        bad = set(r.sample(range(length), substitutions))
        missed += all(any(a + o in bad for o in _offsets(m)) for m in MASKS for a in range(length - len(m) + 1))
    return missed / tries


@pytest.mark.parametrize("length", range(5, WINDOW + 1))
def test_masks_meet_what_the_verification_accepts(length):
    """Shorter items are met as a whole or not at all."""
    for substitutions in range(length - least_same(length) + 1):
        assert miss_rate(length, substitutions) < 0.1


def plain(doc, item):
    """Most equal words of a long enough stretch along any alignment, if that is enough."""
    need, best = min(len(item), WINDOW), 0
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= shift + i < len(doc) and doc[shift + i] == w for i, w in enumerate(item)]
        inside = [0 <= shift + i < len(doc) for i in range(len(item))]
        for a in range(len(item) - need + 1):
            if all(inside[a : a + need]):
                best = max(best, sum(same[a : a + need]))
    return (need, best) if need and best >= least_same(need) else None


def test_whole_result_against_brute_force(spark):
    """Items of every length with as many substitutions as are tolerated, and with one more, in texts of their own."""
    r = random.Random(8)
    items, docs = [], []
    for length in range(1, 34):
        for turn in range(12):
            own = words_of(length, 100 * length + turn).split()
            i = len(items)
            items.append(own)
            need = min(length, WINDOW)
            bad = min(need - least_same(need) + turn % 2, length)
            copy = own.copy()
            for at in r.sample(range(length), bad):
                copy[at] = f"other{at}"
            docs.append((i, words_of(r.randint(0, 40), 50_000 + i).split() + copy + words_of(r.randint(0, 40), 90_000 + i).split()))
    got = overlaps(
        spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id bigint, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string"),
    )
    found = {(x.doc_id, x.item_id): x for x in got.collect()}
    want = {}
    for i, d in docs:
        there = set(d)
        for j, t in enumerate(items):
            if (i == j or there & set(t)) and (p := plain(d, t)):
                want[i, j] = p
    assert set(found) <= set(want)
    for key, x in found.items():
        assert (x.n_words, x.n_same) == (want[key][0], x.n_same) and least_same(x.n_words) <= x.n_same <= want[key][1]
        doc, item = docs[key[0]][1], items[key[1]]
        a = sum(doc[x.doc_start + k] == item[x.item_start + k] for k in range(x.n_words))
        assert a == x.n_same
    for length in range(1, 34):
        own = [(i, i) for i, t in enumerate(items) if len(t) == length and (i, i) in want]
        assert len([k for k in own if k in found]) >= 0.9 * len(own)
    assert len(set(want) & set(found)) >= 0.95 * len(want)


def test_substituted_items_are_found(spark):
    r = random.Random(3)
    items, docs = [], []
    for i, length in enumerate([15, 20, 24] * 40):
        own = words_of(length, 3000 + i).split()
        items.append((i, " ".join(own)))
        for at in r.sample(range(length), length // 4):
            own[at] = f"other{at}"
        docs.append((i, f"{words_of(30, 6000 + i)} {' '.join(own)} {words_of(30, 9000 + i)}"))
    got = overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(i, i) for i in range(120)} <= {(x.doc_id, x.item_id) for x in got.collect()}
