"""Each stage of the corpus pipeline against a plain version of it, on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

pytest.importorskip("tagloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_documents import SCHEMA, WORD, rows, shingles, words_of  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    more = [(70, "intro " + words_of(30, 777) + " outro words follow here", "en", "s1", None, "x", "x", "x", "x")]
    spark.createDataFrame(rows() + more, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, words_of(30, 777)), (2, words_of(30, 888))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def repeated(w):
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    return len({j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)})


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "quality rules":
            good = [(i, t) for i, t, _ in before if len(w := WORD.findall(t or "")) >= 10 and 100 * repeated(w) <= 20 * len(w)]
            assert after == Counter(good)
        elif name == "line dedup":
            sites, texts = defaultdict(set), defaultdict(set)
            for _, t, s in before:
                for line in t.split("\n"):
                    sites[line.strip()].add(s)
                    texts[line.strip()].add(t)
            wide = {k for k in sites if k and len(sites[k]) >= 10 and len(texts[k]) >= 10}
            assert wide and after == Counter((i, "\n".join(x for x in t.split("\n") if x.strip() not in wide)) for i, t, _ in before)
        elif name == "near dedup":
            own = {i: shingles(t, 5) for i, t, _ in before if i is not None}
            parent = {i: i for i in own}
            for a in sorted(own):
                for b in sorted(own):
                    both = len(own[a] & own[b])
                    if a < b and both and 100 * both >= 80 * (len(own[a]) + len(own[b]) - both):
                        ra, rb = a, b
                        while parent[ra] != ra:
                            ra = parent[ra]
                        while parent[rb] != rb:
                            rb = parent[rb]
                        parent[max(ra, rb)] = min(ra, rb)
            assert {i for i, _ in after if i is not None} == {i for i in own if parent[i] == i}
            assert sum(n for (i, _), n in after.items() if i is None) == sum(i is None for i, _, _ in before)
        elif name == "decontamination":
            assert {i for i, _ in after} == {i for i, _, _ in before} - {70}
        else:
            pieces = [(r.doc_id, r.start, r.length, r.doc_tokens) for r in docs.collect()]
            total = Counter()
            for i, _, k, _ in pieces:
                total[i] += k
            assert set(total) == {i for i, _, _ in before} and all(total[i] == n for i, _, _, n in pieces)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_documents_are_told_apart_by_id_and_text(spark):
    """Repeated ids with unlike texts, equal rows, null ids and empty tables, in the stages that drop documents."""
    from tagloom.llm.decontaminate import decontaminate
    from tagloom.llm.near_dedup import drop_near_duplicates

    a, b, passage = words_of(60, 41), words_of(60, 42), words_of(30, 777)
    near = a.replace(a.split()[30], "other", 1)
    bad = words_of(20, 43) + " " + passage
    data = [(1, a), (1, b), (2, a), (3, b), (3, b), (4, "one"), (None, a), (None, a), (7, near), (7, near), (8, bad), (8, b + " x"), (None, bad), (9, None), (10, ""), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect())
    # b + " x" is near b; of a and its near copies the one of the smallest id stays; rows without words and null ids all stay
    want = Counter([(1, a), (1, b), (4, "one"), (None, a), (None, a), (8, bad), (None, bad), (9, None), (10, ""), (10, "")])
    assert got == want
    twice = docs.where("doc_id IN (1, 4) AND doc_id IS NOT NULL").unionByName(docs.where("doc_id = 1"))
    assert Counter((r.doc_id, r.text) for r in drop_near_duplicates(twice).collect()) == Counter([(1, a), (1, b), (4, "one")])
    items = spark.createDataFrame([(1, passage), (2, "one"), (None, None)], "item_id bigint, text string")
    clean = Counter((r.doc_id, r.text) for r in decontaminate(docs, items).collect())
    assert clean == Counter((i, t) for i, t in data if t is None or passage not in t)
    for stage in (drop_near_duplicates, lambda d: decontaminate(d, items)):
        assert stage(docs.limit(0)).count() == 0
