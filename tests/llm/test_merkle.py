"""The manifest against a plain tree built level by level, and edge cases."""

from __future__ import annotations

import hashlib
import random
import string
import zlib

import pytest

pytest.importorskip("tagloom.llm")

from tagloom.llm.merkle import manifest  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, rank int, size string, item string, kids string"


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def reduced(nodes):
    """(top, for each node the list of its (left, right) siblings)."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for at in range(len(nodes)):
            run = at - at % 8
            for i in owner[at]:
                paths[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        owner = [sum(owner[i : i + 8], []) for i in range(0, len(nodes), 8)]
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    tops, below = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        top, paths = reduced([leaf(r, r[1]) for r in own])
        tops.append(top)
        below.append(list(zip(own, paths, strict=True)))
    root, upper = reduced(tops)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    out = []
    for top, pairs, up in zip(tops, below, upper, strict=True):
        for r, path in pairs:
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(lower)
            at = leaf(r, text)
            for left, right in path + up:
                at = h(left + at + right)
            out.append((r[0], leaf(r, r[1]), top, root, h("".join(a + b for a, b in path + up)), at, at == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, "x", "x", "x") for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in manifest(df).select(*COLUMNS).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


def test_against_plain_tree(spark):
    r = random.Random(3)
    # a language over one block of 4,096, one at a power of eight, one of a leaf, a null one, a name beyond ASCII
    sizes = {"en": 4200, "fr": 64, "de": 65, "xx": 1, None: 9, "é": 8, "": 2}
    rows, at = [], -5
    for lang, n in sizes.items():
        for _ in range(n):
            at += r.randint(1, 3)
            text = r.choice(("Some Text ", "plain", "É", "", "UP")) * r.randint(0, 3)
            rows.append((at, text if r.random() > 0.05 else None, lang, r.choice(("s1", None)), r.choice((len(text), None))))
    rows += [(None, "Null Id", "fr", "s", 1), (None, None, "fr", None, None), (7, "Twice", "de", "s", 5), (7, "Twice", "de", "s", 5), (7, "Other", "de", "s", 5)]
    rows += [(100_000, "Long " * 50_000, "fr", "s", 1)]
    got = check(spark, rows)
    assert {g[6] for g in got} == {True, False}


def test_small_tables(spark):
    one = check(spark, [(1, "a", "en", "s", 1)])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == h("")
    check(spark, [(i, "A", "en", "s", 1) for i in range(9)])
    check(spark, [(i, "A", f"l{i % 9}", "s", 1) for i in range(30)])
    check(spark, [(None, "Same", None, None, None)] * 20)


def test_empty(spark):
    got = manifest(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns[:6] == list(COLUMNS[:6])
