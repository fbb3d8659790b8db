"""Searches of the stored index against one that is built anew, through updates, removals and merges."""

from __future__ import annotations

import os
import random
import re

from tagloom.operators import library
from tagloom.operators.stored_index import StoredIndex

WORDS = "the of and lamp lens glass light lighter lights über été that there these thing".split()
SCHEMA = "doc_id bigint, title string, abstract string"


def texts(r: random.Random, ids) -> dict:
    def some(n):
        return None if r.random() < 0.1 else " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))

    return {i: (some(4), some(12)) for i in ids}


def frame(spark, docs: dict):
    return spark.createDataFrame([(i, *t) for i, t in docs.items()], SCHEMA).repartition(3)


ASKED = (
    {"all_of": ("the", "lamp")}, {"any_of": ("uber", "ete"), "none_of": ("the",)}, {"phrases": (("of", "the"), ("lamp",))}, {"prefixes": ("light", "th")},
    {"all_of": ("lens",), "sections": ("title",)}, {"none_of": ("and", "of")}, {"all_of": ("nowhere",)}, {}, {"prefixes": ("z",)}, {"none_of": ("the",), "sections": ("title",)},
)


def same(spark, index: StoredIndex, docs: dict):
    fresh = library.build_term_index(frame(spark, docs))
    for asked in ASKED:
        got = sorted(r.doc_id for r in index.match(**asked).collect())
        assert got == sorted(r.doc_id for r in library.text_match(fresh, **asked).collect()), asked


def test_updates(spark, tmp_path):
    r = random.Random(5)
    path = str(tmp_path / "index")
    docs = texts(r, range(120))
    index = StoredIndex.create(frame(spark, docs), path, parts=5)
    assert 2 <= len(index.bounds) <= 4
    same(spark, index, docs)
    new = texts(r, range(100, 160))
    index.upsert(frame(spark, new))
    docs |= new
    index.remove(frame(spark, {i: (None, None) for i in range(0, 160, 7)}))
    docs = {i: t for i, t in docs.items() if i % 7}
    index.upsert(frame(spark, {7: ("the lamp", None)}))  # back again
    docs[7] = ("the lamp", None)
    same(spark, StoredIndex.open(spark, path), docs)
    # a segment without its documents, as a failed write leaves it, is not there
    library.build_term_index(frame(spark, {9: ("nowhere", "nowhere")})).selectExpr("*", "0 AS part").write.partitionBy("part").parquet(f"{path}/postings/segment=9")
    index = StoredIndex.open(spark, path)
    assert index.match(all_of=("nowhere",)).isEmpty()
    index.merge()
    assert [n for n in os.listdir(f"{path}/documents") if n.startswith("segment")] == ["segment=4"]
    same(spark, StoredIndex.open(spark, path), docs)


def test_a_search_reads_the_words_parts_only(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = texts(random.Random(6), range(200))
    index = StoredIndex.create(frame(spark, docs), path, parts=8)
    rows = index.postings(("lamp", "lens"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    parts = sorted({index.part_of("lamp"), index.part_of("lens")})
    filters = "".join(re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)[0])
    assert re.search(rf"part#\d+ IN \({','.join(map(str, parts))}\)", filters) and "In(token, [lamp,lens" in filters
    assert len(parts) < len(index.bounds)
    # no text is read by a library search with the index
    d = frame(spark, docs).selectExpr("*", "'fetched' AS fetch_status", "'validated' AS review_state", "'EP1' AS pub_key")
    none = spark.createDataFrame([], "doc_id bigint, tag_id bigint, state string, source string, status string")
    found = library.library_search(d, none, none, none, library.LibraryFilters(text=("lamp",)), index)
    want = sorted(i for i, t in docs.items() if "lamp" in f"{t[0]} {t[1]}".split())
    assert sorted(r.doc_id for r in found.collect()) == want


def test_nothing(spark, tmp_path):
    index = StoredIndex.create(frame(spark, {}), str(tmp_path / "a"))
    assert index.match(all_of=("x",)).isEmpty() and index.match().isEmpty()
    index.upsert(frame(spark, {1: ("the lamp", "")}))
    assert [r.doc_id for r in index.match(phrases=(("the", "lamp"),)).collect()] == [1]
