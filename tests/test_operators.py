"""Hand-computed cases of the operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import numbers, sampling, structure, text, vectors
from tagloom.operators import audit, automation, evaluation, exports, library, outline, scoring, tags
from tagloom.sources import files


# forms of a number by rule: letters, then digits between separators, then a letter with digits or nothing
@pytest.mark.parametrize(
    ("raw", "outcome", "key", "kind"),
    [
        ("WO 98/12.345 A2", "parsed", "WO9812345", "A2"), ("us 9,876,543 b2", "parsed", "US9876543", "B2"), ("\u0020wo2001000001 ", "parsed", "WO2001000001", None),
        ("EP0777T3", "parsed", "EP0777", "T3"), ("EP 5 a", "parsed", "EP5", "A"), ("FR 3 000 111 B1", "needs_normalisation", "FR3000111", "B1"),
        ("zzz1", "needs_normalisation", "ZZZ1", None), ("EP", "unparseable", None, None), ("31415", "unparseable", None, None), ("JP2001-5A", "unparseable", None, None),
        ("EP12B1C", "unparseable", None, None), ("E.P 5", "unparseable", None, None), (" / ", "unparseable", None, None), (None, "unparseable", None, None),
    ],
)
def test_numbers(spark, raw, outcome, key, kind):
    df = spark.createDataFrame([(raw,)], "input_raw string")
    r = numbers.normalise_numbers(df).first()
    assert (r.outcome, r.pub_key, r.kind) == (outcome, key, kind)
    vectors.register(spark)
    assert df.selectExpr("publication_key(input_raw) AS k").first().k == key


def _unit(doc_id: int) -> float:
    m = (1 << 64) - 1
    h = (doc_id * sampling.MULTIPLIER + sampling.OFFSET) & m
    h = ((h ^ (h >> 15)) * sampling.FINAL) & m
    return float(np.float32(h >> 32) / np.float32(0xFFFFFFFF))


def test_audit_sampling(spark):
    rows = spark.range(10_000).select("id", sampling.audit_unit(F.col("id")).alias("u"), sampling.audit_sampled(F.col("id"), 0.05).alias("s"), sampling.audit_sampled(F.col("id"), 0.0).alias("z")).collect()
    assert all(abs(r.u - _unit(r.id)) < 1e-6 for r in rows)
    assert 0.04 < sum(r.s for r in rows) / len(rows) < 0.06 and not any(r.z for r in rows)


def _share(hits, of):
    return sum(hits) / sum(of) if sum(of) else None


def test_precision_and_thresholds(spark):
    """Random scores, many of them exactly on a threshold, against the definitions at every threshold."""
    r = random.Random(11)
    rows, thresholds = [], [np.float32(np.float32(k) * np.float32(0.01)) for k in range(101)]
    for tag in range(12):
        for _ in range(r.randint(0, 40)):
            s = float(r.choice(thresholds)) if r.random() < 0.6 else r.uniform(-0.2, 1.2)
            rows.append((len(rows), len(rows), tag, s if r.random() < 0.95 else None, r.random() < tag / 11))
    frame = spark.createDataFrame(rows, "id bigint, doc_id bigint, tag_id bigint, score float, is_pos boolean")
    low, high = ({x.tag_id: x[1] for x in f(frame).collect()} for f in (lambda f: evaluation.calibrate_threshold(f, 0.7), lambda f: evaluation.calibrate_neg_threshold(f, 0.6)))
    half = {x.tag_id: x for x in evaluation.precision_recall(frame).collect()}
    curve = {(x.tag_id, x.step): (x.precision, x.recall) for x in evaluation.pr_curve(frame).collect()}
    for tag in {t for _, _, t, _, _ in rows}:
        own = [(None if s is None else np.float32(s), p) for _, _, t, s, p in rows if t == tag]

        def at(x, own=own):
            taken = [s is not None and s >= x for s, _ in own]
            hits = [a and p for a, (_, p) in zip(taken, own, strict=True)]
            return _share(hits, taken), _share(hits, [p for _, p in own])

        grid = [at(x) for x in thresholds]
        precise = [x for x, (p, _) in zip(thresholds, grid, strict=True) if p is not None and p >= 0.7]
        recalled = [x for x, (_, q) in zip(thresholds, grid, strict=True) if q is not None and q >= 0.6]
        assert low[tag] == (min(precise) if precise else None) and high[tag] == (max(recalled) if recalled else None)
        assert (half[tag].precision, half[tag].recall) == at(np.float32(0.5)) and half[tag].n == len(own)
        assert all(curve[tag, k] == at(np.float32(np.float32(k) * np.float32(0.05))) for k in range(21))
    newest = evaluation.evaluation_window(frame, 9).collect()
    assert {x.id for x in newest} == {i for t in range(12) for i in sorted(i for i, _, u, _, _ in rows if u == t)[-9:]}


def test_audits(spark):
    """Random histories against a walk through each: an automatic row is audited by the first human one after it."""
    r = random.Random(12)
    rows = [(i, r.randint(0, 60), r.randint(0, 4), r.choice(("auto", "auto", "human")), r.choice(("pos", "neg"))) for i in range(1500)]
    history = spark.createDataFrame(rows, "id bigint, doc_id bigint, tag_id bigint, source string, state string").repartition(3)
    pairs = []
    for i, d, t, source, state in rows:
        later = [s for j, e, u, by, s in rows if source == "auto" and j > i and (e, u, by) == (d, t, "human")]
        pairs += [(t, state, later[0])] if later else []
    tags = spark.range(7).select(F.col("id").alias("tag_id"))
    single = {x.tag_id: (x.precision, x.n) for x in audit.audited_precision(history, tags).collect()}
    full = {x.tag_id: (x.precision, x.recall, x.n) for x in audit.auto_completion_audit(history).collect()}
    for t in range(5):
        own = [(a == "pos", h == "pos") for u, a, h in pairs if u == t]
        positive = [x for x in own if x[0]][-50:]
        assert single[t] == (_share([h for _, h in positive], [a for a, _ in positive]), len(positive))
        last = own[-50:]
        both = [a and h for a, h in last]
        assert full[t] == (_share(both, [a for a, _ in last]), _share(both, [h for _, h in last]), len(last))
    assert single[5] == single[6] == (None, 0)


def test_settings(spark):
    tags = spark.createDataFrame([(1, False, False), (2, True, True)], "tag_id bigint, auto_enabled boolean, archived boolean")
    config = automation.EngineConfig()
    with pytest.raises(ValueError, match="automatic mode"):
        automation.changed_settings(config, tags, full_automation=True)
    assert automation.changed_settings(config, tags.withColumn("auto_enabled", F.lit(True)), full_automation=True).full_automation
    assert automation.changed_settings(config, tags, audit_rate=0.2, drawings_policy_tags=(3,)).drawings_policy_tags == (3,)
    for bad in ({"audit_rate": 1.5}, {"fulltext_policy": "never"}):
        with pytest.raises(ValueError):
            automation.changed_settings(config, tags, **bad)


def test_places_are_utf16_units(spark):
    rows = [(1, "claims", "aXab Ab"), (1, "title", "𝛼 AB ab"), (1, "abstract", None), (2, "description", "İab")]
    got = library.find_in_documents(spark.createDataFrame(rows, "doc_id bigint, section string, text string"), " Ab ").collect()
    assert sorted((x.doc_id, x.n, x.section, x.start, x.stop) for x in got) == [
        (1, 1, "title", 3, 5), (1, 2, "title", 6, 8), (1, 3, "claims", 2, 4), (1, 4, "claims", 5, 7), (2, 1, "description", 2, 4),
    ]
    with pytest.raises(ValueError):
        library.find_in_documents(spark.createDataFrame(rows, "doc_id bigint, section string, text string"), " a ")


def test_classifier_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 16))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(float)
    samples = spark.createDataFrame([(i, 1, float(y[i]), x[i].tolist()) for i in range(200)], "doc_id bigint, tag_id bigint, y double, vector array<float>")
    few = spark.createDataFrame([(1, 2, 1.0, [0.0] * 16)], samples.schema)
    got = scoring.train_classifiers(samples.unionByName(few)).collect()
    assert [r.tag_id for r in got] == [1]
    w, b = scoring.fit(x, y)
    assert np.allclose(got[0].weights, w, atol=1e-4) and abs(got[0].bias - b) < 1e-4
    assert (((x @ w + b) > 0) == y).mean() > 0.9


def test_large_tags_take_the_same_steps(spark, monkeypatch):
    """Three tags in blocks of a few samples, one of them without enough of a class, with a null vector; one job a step."""
    monkeypatch.setattr(scoring, "PACK_ROWS", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    tag = np.arange(300) % 3 + 1
    y = ((x[:, 0] + rng.normal(size=300) > 0) & (tag != 3)).astype(float)
    rows = [(i, int(tag[i]), float(y[i]), x[i].tolist()) for i in range(300)] + [(900, 1, 1.0, None)]
    samples = spark.createDataFrame(rows, "doc_id bigint, tag_id bigint, y double, vector array<float>").repartition(5)
    tracker = spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup(None), default=-1)
    got = {r.tag_id: r for r in scoring.train_large(samples, iterations=25).collect()}
    jobs = max(tracker.getJobIdsForGroup(None)) - before
    assert got.keys() == {1, 2} and jobs <= 25 * 2 + 6  # a step's shuffle and its result, as adaptive plans count them
    for t in got:
        w, b = scoring.fit(x[tag == t].astype(float), y[tag == t], iterations=25)
        assert np.abs(np.array(got[t].weights) - w).max() < 1e-9 and abs(got[t].bias - b) < 1e-9
        assert (got[t].n_pos, got[t].n_neg) == (int(y[tag == t].sum()), int((tag == t).sum() - y[tag == t].sum()))
    assert scoring.train_large(samples.where("tag_id = 3")).isEmpty()


def test_claim_references():
    def told(text, at=-1):
        found = structure.claims(text)
        return [(text[a:b], c) for a, b, c in found[at].links], found[at].needs(structure.claim_numbers(found))

    many = "\n".join(f"{i}. A lamp." for i in range(1, 11)) + "\n"
    assert told("12. The lamp of claim 7, further having a lens.") == ([("claim 7", 7)], {7})
    assert told(many + "11. A kit for Claims 3, 5 and 8 to 10 alike") == ([("Claims 3", 3), ("5", 5), ("8", 8), ("10", 10)], {3, 5, 8, 9, 10})
    assert told("1. A\n2. B\n4. Use after any Previous claim") == ([], {1, 2})
    assert told("3. Like claim 9 and disclaims 1") == ([("claim 9", 9)], set())
    assert told("no claim is meant here") == ([], set())
    assert told("2. Of claim 1\nas well as claim 7") == ([("claim 1", 1), ("claim 7", 7)], {1})


def test_no_number_is_too_large(spark):
    """Numbers beyond 32 bits are no claims, and ranges cost what the text holds."""
    texts = [
        "99999999999. The lamp of claim 99999999999 or 1",
        "1. A\n2. Of claims 1 to 2000000000",
        "1. A\n4294967295. Any of the preceding claims\n4294967296. of claim 1",
        "7. " + "claim " * 50_000 + "9" * 100_000,
        "5. " + "any preceding claim, " * 20_000,
        "".join(f"{i}. Any of the above claims\n" for i in range(1, 400)),
        "1. 𝛼 of claim 2",
        None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, claims string")
    rows: dict = {}
    for r in outline.claim_refs(docs).collect():
        rows.setdefault(r.doc_id, []).append((r.claim, r.start, r.stop, r.ref, r.depends))
    assert set(rows) == {1, 2, 5, 6}
    assert rows[1] == [(2, 11, 19, 1, True), (2, 23, 33, 2000000000, False)]
    at = texts[2].index("claim 1")
    assert rows[2] == [(4294967295, at, at + 7, 1, True)]
    assert len(rows[5]) == 399 * 398 // 2
    assert rows[6] == [(1, 9, 16, 2, False)]  # the letter is two units
    tree = {(r.doc_id, r.claim): (r.is_independent, r.depth, r.base) for r in outline.claim_tree(docs).collect()}
    assert tree[1, 2] == (False, 1, 1) and tree[2, 4294967295] == (False, 1, 1) and tree[5, 399] == (False, 398, 1)
    vectors.register(spark)
    docs.createOrReplaceTempView("claim_texts")
    for name, whole in (("claim_references", outline.claim_refs), ("claim_tree", outline.claim_tree), ("claim_blocks", outline.claim_blocks)):
        got = spark.sql(f"SELECT doc_id, b.* FROM claim_texts, LATERAL {name}(claims) b")
        if name == "claim_blocks":
            got = got.select("doc_id", F.col("n").cast("bigint"), "label", "start", "stop")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, whole(docs).collect())))


def test_claim_tree(spark):
    needs = {2: "claim 1", 3: "claims 1 or 2", 5: "claim 4", 6: "claims 3 and 5", 7: "claims 6 and 99"}
    text = "\n".join(f"{c}. A lamp of {needs[c]}" if c in needs else f"{c}. A lamp" for c in range(1, 8))
    docs = spark.createDataFrame([(1, text), (2, "\n".join(f"{c}) A lamp" for c in range(1, 8)))], "doc_id bigint, claims string")
    rows = {(r.doc_id, r.claim): (r.is_independent, r.depth, r.base) for r in outline.claim_tree(docs).collect()}
    assert [rows[1, c] for c in range(1, 8)] == [(True, 0, 1), (False, 1, 1), (False, 2, 1), (True, 0, 4), (False, 1, 4), (False, 3, 1), (False, 4, 1)]
    assert all(rows[2, c] == (True, 0, c) for c in range(1, 8))


def test_utf16(spark):
    df = spark.createDataFrame([("a𝛼b",)], "t string")
    r = df.select(text.utf16_len(F.col("t")).alias("n"), *(text.utf16_slice(F.col("t"), F.lit(a), F.lit(b)).alias(f"s{a}{b}") for a, b in ((0, 1), (1, 3), (1, 2), (2, 4), (3, 4), (3, 9), (2, 2)))).first()
    assert r.asDict() == {"n": 4, "s01": "a", "s13": "𝛼", "s12": None, "s24": None, "s34": "b", "s39": None, "s22": None}


def test_folder_names(spark):
    names = {"R&D / notes": "R&D _ notes", "a*b?": "a_b_", "name...": "name", "Aux.log": "Aux.log_", "lpt0": "lpt0", "nul": "nul_", "  tab\tsep ": "tab_sep", " . ": "_"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", text.safe_folder_name(F.col("n")).alias("s")).collect()} == names
    t = spark.createDataFrame([(5, "Plan"), (2, "plan"), (9, "PLAN (2)"), (11, "_UNTAGGED"), (12, "other")], "tag_id bigint, name string")
    want = {2: "plan", 5: "Plan (2)", 9: "PLAN (2) (2)", 11: "_UNTAGGED (2)", 12: "other"}
    assert {r.tag_id: r.folder for r in exports.tag_folder_names(t).collect()} == want


def test_clashing_folder_names(spark):
    """As one walk over the tags in the order of ids has it, with names that look like numbers of others; no group of equal names is one task's."""
    rng = random.Random(3)
    for size in (25, 400):
        some = ["a", "A", "b", "_untagged", *[f"{x} ({n})" for x in ("a", "_Untagged", "a (2)", "A (3)", "a (2) (2)", "lone") for n in (0, 1, 2, 3, 4, 5, 9, 40, "02")]]
        rows = [(i, rng.choice(some)) for i in rng.sample(range(10_000), size)]
        taken, want = {"_untagged"}, {}
        for tag, base in sorted(rows):
            n, name = 2, base
            while name.lower() in taken:
                name, n = f"{base} ({n})", n + 1
            taken.add(name.lower())
            want[tag] = name
        got = exports.tag_folder_names(spark.createDataFrame(rows, "tag_id bigint, name string"))
        assert {r.tag_id: r.folder for r in got.collect()} == want
    hot = exports.tag_folder_names(spark.range(5000, numPartitions=4).select(F.col("id").alias("tag_id"), F.lit("x").alias("name")))
    assert {r.folder for r in hot.collect()} == {"x", *(f"x ({n})" for n in range(2, 5001))}
    assert "FlatMapGroupsInPandas" not in hot._jdf.queryExecution().toString()


def test_upper_by_letter(spark):
    words = {"straße": "STRAẞE", "ﬁx ŉ": "ﬁX ŉ", "ᾳ𝛼é": "ᾼ𝛼É", "plain": "PLAIN", "": "", None: None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.u for r in df.select("w", text.upper_by_letter(F.col("w")).alias("u")).collect()} == words


XML = """<s total-result-count="12"><exchange-document country="GB" doc-number="7654321" kind="B2" family-id="555"><bibliographic-data>
<publication-reference><document-id document-id-type="docdb"><date>19990228</date></document-id></publication-reference>
<application-reference><document-id document-id-type="epodoc"><doc-number>GB19970000042</doc-number></document-id></application-reference>
<parties><applicants><applicant data-format="epodoc"><applicant-name><name>LAMPS LTD</name></applicant-name></applicant></applicants></parties>
<patent-classifications><patent-classification><section>G</section><class>02</class><subclass>B</subclass><main-group>7</main-group><subgroup>04</subgroup></patent-classification></patent-classifications>
<invention-title lang="en">Lens<b>es</b></invention-title></bibliographic-data><abstract lang="en"><p>First part.</p><p>Second.</p></abstract></exchange-document></s>"""


def test_publication_xml(spark):
    raw = spark.createDataFrame([(1, XML), (2, "<open"), (3, "<s><exchange-document kind='B'/></s>")], "id bigint, xml string")
    rows = {r.id: r for r in files.parse_publications(raw).collect()}
    a = rows[1]
    assert (a.docdb_id, a.application_number, a.publication_date, a.family_id) == ("GB.7654321.B2", "GB19970000042", "1999-02-28", "555")
    assert a.titles == {"en": "Lens"} and a.abstracts == {"en": "First part.\nSecond."} and a.applicants == ["LAMPS LTD"] and a.cpc == ["G02B7/04"]
    assert rows[2].error and rows[3].error
    totals, _ = files.parse_search_pages(raw)
    assert {r.id: r.total for r in totals.collect()} == {1: 12, 2: None, 3: None}


def test_fulltext_xml(spark):
    xml = """<f><description lang="EN"><heading>HEAD</heading><p>A <b>bold</b>  text</p><p>x<tables/></p></description><claims lang="de"><claim><claim-text>Eins</claim-text></claim></claims>
    <fulltext-instance lang="en" desc="Description"/><fulltext-instance lang="en" desc="other"/><document-instance desc="Drawing" link="l" number-of-pages="6"/></f>"""
    raw = spark.createDataFrame([(1, xml)], "id bigint, xml string")
    assert files.extract_description(raw, "en").first().text == "HEAD\nA bold text\n[Table 2 not reproduced]"
    assert files.extract_claims(raw, "de").first().text == "Eins" and files.extract_claims(raw, "fr").first().text is None
    assert [r.part for r in files.parse_fulltext_inquiry(raw).collect()] == ["description"]
    assert files.parse_image_inquiry(raw).first().pages == 6


def test_lists_and_schemes(spark, tmp_path):
    (tmp_path / "n.txt").write_text("EP1\r\n\r\n  US2 \n")
    assert [r.input_raw for r in files.read_number_list(spark, str(tmp_path / "n.txt")).orderBy("line_no").collect()] == ["EP1", "US2"]
    (tmp_path / "s.json").write_text('[{"name": "child", "definition": "d", "parent": "top", "hotkey": "j"}, {"name": "top", "definition": "d", "hotkey": "x"}]')
    known = spark.createDataFrame([(0, "old", "d", None, False, None)], "tag_id bigint, name string, definition string, parent_id bigint, archived boolean, hotkey string")
    new, dropped, lost = tags.import_tag_scheme(known, files.read_tag_scheme(spark, str(tmp_path / "s.json")))
    rows = {r.name: r for r in new.collect()}
    assert rows["child"].parent_id == rows["top"].tag_id and rows["top"].hotkey == "x" and [r.hotkey for r in dropped.collect()] == ["j"] and lost.isEmpty()


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, -2.5],)], "v array<float>")
    assert df.select(vectors.blob_to_vector(vectors.vector_to_blob("v")).alias("v")).first().v == [1.0, -2.5]
    vectors.register(spark)
    rows = spark.sql("SELECT b.* FROM (SELECT 'Title\n[0001] text.' AS t) x, LATERAL description_blocks(t) b").collect()
    assert [(r.kind, r.label, r.start, r.stop) for r in rows] == [("heading", None, 0, 5), ("paragraph", "0001", 6, 18)]


def test_rendered_document(spark):
    docs = spark.createDataFrame(
        [(1, "EP1", ["A1"], None, [], None, [], ["t1", "t2"], "EP.1.A1", "Text")],
        "doc_id bigint, pub_key string, kinds array<string>, title string, applicants array<string>, publication_date date, cpc array<string>, tags array<string>, abstract_source string, abstract string",
    )
    ft = spark.createDataFrame([(1, "non_english_only", "de", "EP.1.B1", "Text", None)], "doc_id bigint, status string, lang string, source string, description string, claims string")
    dr = spark.createDataFrame([], "doc_id bigint, status string, source string, paths array<string>")
    marks = spark.createDataFrame([(1, 1, "Claim 1", "yellow", False, "a\nb", "one\ntwo ")], "doc_id bigint, n int, location string, color string, detached boolean, quote string, comment string")
    want = (
        "Publication: EP1 (A1)\nTitle: Not available\nApplicants: Not available\nPublication date: Not available\nCPC: Not available\nTags: t1; t2\n"
        "Sources: abstract EP.1.A1; full text EP.1.B1\n\n===== ABSTRACT =====\nText\n===== DESCRIPTION =====\n[Non-English text, language: de]\nText\n"
        "===== CLAIMS =====\nClaims not available for this publication.\n===== DRAWINGS =====\nDrawings not retrieved.\n"
        '===== HIGHLIGHTS =====\nClaim 1 (yellow): "a b"\n  Comment: one\n           two\n'
    )
    assert exports.render_documents(docs, ft, dr, marks).first().text == want
