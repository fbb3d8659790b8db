"""Classes of related documents against a plain search, with hot families and long chains."""

from __future__ import annotations

import random
from collections import Counter

from tagloom.operators import families

SCHEMA = "doc_id bigint, application_number string, family_id bigint"


def plain(rows):
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for d, a, f in rows:
        if d is not None:
            for key in [("a", a)] * (a is not None) + [("f", f)] * (f is not None):
                x, y = root(("d", d)), root(key)
                parent[x] = y
    ids = {d for d, _, _ in rows if d is not None}
    least: dict = {}
    for d in ids:
        r = root(("d", d))
        least[r] = min(least.get(r, d), d)
    cls = {d: least[root(("d", d))] for d in ids}
    n = Counter(cls.values())
    return {d: (c, n[c]) for d, c in cls.items()}


def check(spark, rows):
    got = families.related_classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len({r.doc_id for r in got})
    assert {r.doc_id: (r.class_id, r.n_members) for r in got} == plain(rows)


def test_random_families(spark):
    r = random.Random(4)
    rows = [(i, r.choice((None, f"x{r.randint(0, 150)}")), r.choice((None, r.randint(0, 120)))) for i in range(300)]
    check(spark, rows + rows[:20] + [(None, "x1", 1), (7, "x3", None)])


def test_a_family_of_half_the_rows(spark):
    rows = [(i, f"x{i}", 1 if i % 2 else None) for i in range(2000)] + [(5000 + i, f"x{2 * i + 1}", None) for i in range(0, 900, 3)]
    check(spark, rows)


def test_long_chain(spark):
    """Two hundred documents in a row, in no order of their ids."""
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    check(spark, [(d, f"x{i // 2}", (i + 1) // 2) for i, d in enumerate(ids)])


def test_none(spark):
    assert families.related_classes(spark.createDataFrame([], SCHEMA)).isEmpty()
    check(spark, [(1, None, None), (2, "a", None)])


def test_asked_documents_only(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "b", None), (5, None, None)], SCHEMA)
    got = {(r.doc_id, r.related_id): list(r.via) for r in families.related_to(docs.where("doc_id in (1, 5)"), docs).collect()}
    assert got == {(1, 2): ["application_number", "family_id"], (1, 3): ["family_id"]}
