"""Queries of the corpus side: imports, families, cascades, searches, text structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text, vectors
from ..operators import corpus, embedding, families, labels, outline
from ..operators.kept import shared_path
from ..sources import files, formats
from ..sources.tables import with_clause
from .learning_queries import T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_clause(sql, *tables)
        return f

    return add


_PARSED = r"""
p0 AS (SELECT line_no, input_raw, upper(regexp_extract(trim(input_raw), '^([A-Za-z]+)', 1)) AS c,
         translate(regexp_extract(trim(input_raw), '^[A-Za-z]+(.*)$', 1), ' ./,', '') AS rest FROM a_number_lines),
p1 AS (SELECT *, regexp_extract(rest, '^([0-9]+)([A-Za-z][0-9]*)?$', 1) AS n, upper(regexp_extract(rest, '^([0-9]+)([A-Za-z][0-9]*)?$', 2)) AS k FROM p0),
parsed AS (SELECT line_no, input_raw, CASE WHEN c = '' OR n = '' THEN 'unparseable' WHEN c NOT IN ('EP', 'US', 'WO') THEN 'needs_normalisation' ELSE 'parsed' END AS outcome,
  CASE WHEN c <> '' AND n <> '' THEN c END AS country, CASE WHEN c <> '' AND n <> '' THEN n END AS number, CASE WHEN c <> '' AND n <> '' THEN nullif(k, '') END AS kind,
  CASE WHEN c <> '' AND n <> '' THEN concat(c, n) END AS pub_key FROM p1)"""
_RESULT = (
    _PARSED
    + """,
result AS (SELECT *, CASE WHEN outcome <> 'parsed' THEN outcome
    WHEN row_number() OVER (PARTITION BY outcome, pub_key ORDER BY line_no) > 1 OR pub_key IN (SELECT pub_key FROM known) THEN 'duplicate' ELSE 'imported' END AS result FROM parsed)"""
)
_KNOWN = "known AS (SELECT DISTINCT pub_key FROM a_documents WHERE doc_id % 7 = 0)"


def _results(spark, sf_dir) -> DataFrame:
    t = T(spark, sf_dir)
    return corpus.dedupe_numbers(numbers.normalise_numbers(t.a_number_lines), t.a_documents.where("doc_id % 7 = 0"))


@query(f"WITH {_PARSED} SELECT * FROM parsed", "a_number_lines")
def normalised_numbers(spark, sf_dir):
    return numbers.normalise_numbers(T(spark, sf_dir).a_number_lines)


@query(f"WITH {_KNOWN}, {_RESULT} SELECT line_no, pub_key, result FROM result", "a_number_lines", "a_documents")
def deduped_numbers(spark, sf_dir):
    return _results(spark, sf_dir).select("line_no", "pub_key", "result")


@query(f"WITH {_KNOWN}, {_RESULT} SELECT result, count(*) AS n FROM result GROUP BY result", "a_number_lines", "a_documents")
def import_report(spark, sf_dir):
    return corpus.import_report(_results(spark, sf_dir))


@query(
    f"""WITH {_PARSED} SELECT (SELECT max(doc_id) FROM a_documents WHERE doc_id % 7 = 0) + row_number() OVER (ORDER BY line_no) AS doc_id, pub_key, 'pending' AS fetch_status
    FROM (SELECT pub_key, min(line_no) AS line_no FROM parsed WHERE outcome = 'parsed' AND pub_key NOT IN (SELECT pub_key FROM a_documents WHERE doc_id % 7 = 0) GROUP BY pub_key)""",
    "a_number_lines", "a_documents",
)
def pending_documents(spark, sf_dir):
    t = T(spark, sf_dir)
    return corpus.add_pending(t.a_documents.where("doc_id % 7 = 0"), numbers.normalise_numbers(t.a_number_lines).where("outcome = 'parsed'"))


@query(
    """SELECT doc_id, concat(country, number) AS pub_key, concat(country, '.', number, '.', kind) AS docdb_id, regexp_extract(pub_key, '^([A-Za-z]+)', 1) AS c,
    regexp_extract(pub_key, '^[A-Za-z]+(.*)$', 1) AS n, concat('https://worldwide.espacenet.com/patent/search?q=pn%3D', pub_key, kind) AS url FROM a_documents""",
    "a_documents",
)
def document_keys(spark, sf_dir):
    c, n = numbers.split_pub_key(F.col("pub_key"))
    return T(spark, sf_dir).a_documents.select(
        "doc_id", numbers.pub_key(F.col("country"), F.col("number")).alias("pub_key"),
        numbers.docdb_id(F.col("country"), F.col("number"), F.col("kind")).alias("docdb_id"), c.alias("c"), n.alias("n"),
        numbers.publication_url(F.col("pub_key"), F.array("kind")).alias("url"),
    )


@query(
    """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN 404 ELSE 500 END AS code FROM documents WHERE doc_id % 7 = 0)
    SELECT d.doc_id, CASE WHEN code = 404 THEN 'not_found' WHEN code IS NOT NULL THEN 'error' WHEN abstract IS NOT NULL AND language = 'en' THEN 'fetched' ELSE 'no_english_abstract' END AS fetch_status
    FROM a_documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
    "a_documents",
)
def fetch_outcomes(spark, sf_dir):
    d = T(spark, sf_dir).a_documents
    selected = d.select("doc_id", F.when(F.col("language") == "en", F.col("abstract")).alias("abstract"))
    failures = d.where("doc_id % 7 = 0").select("doc_id", F.when(F.col("doc_id") % 14 == 0, 404).otherwise(500).alias("code"))
    return corpus.fetch_outcome(selected, failures)


@query(
    """SELECT doc_id, concat(title, '. ', abstract) AS input FROM a_documents WHERE title IS NOT NULL AND abstract IS NOT NULL""", "a_documents"
)
def embedding_inputs(spark, sf_dir):
    d = T(spark, sf_dir).a_documents
    return d.select("doc_id", vectors.embedding_text(F.col("title"), F.col("abstract")).alias("input")).where("input IS NOT NULL")


@query("SELECT tag_id, concat(name, ': ', definition) AS input FROM a_tags", "a_tags")
def tag_inputs(spark, sf_dir):
    return T(spark, sf_dir).a_tags.select("tag_id", vectors.tag_text(F.col("name"), F.col("definition")).alias("input"))


@query()
def embedded_documents(spark, sf_dir):
    d = T(spark, sf_dir).a_documents.select("doc_id", vectors.embedding_text(F.col("title"), F.col("abstract")).alias("input"))
    return vectors.embed(d, "input", vectors.HashedTerms())


@query()
def learned_embeddings(spark, sf_dir):
    """Documents along the axes learned from all of them."""
    d = T(spark, sf_dir).a_documents.select("doc_id", vectors.embedding_text(F.col("title"), F.col("abstract")).alias("input"))
    return vectors.embed(d, "input", embedding.fit_terms(d, "input"))


@query(
    """SELECT doc_id, related_id, list(DISTINCT via ORDER BY via) AS via FROM (
      SELECT a.doc_id, b.doc_id AS related_id, 'application_number' AS via FROM a_documents a JOIN a_documents b ON a.application_number = b.application_number AND a.doc_id <> b.doc_id
      UNION ALL SELECT a.doc_id, b.doc_id, 'family_id' FROM a_documents a JOIN a_documents b ON a.family_id = b.family_id AND a.doc_id <> b.doc_id) GROUP BY doc_id, related_id""",
    "a_documents",
)
def related_documents(spark, sf_dir):
    return corpus.related_documents(T(spark, sf_dir).a_documents)


_MEMBERS = """m AS (SELECT doc_id, 'a' || application_number AS key FROM a_documents WHERE application_number IS NOT NULL
    UNION ALL SELECT doc_id, 'f' || family_id FROM a_documents WHERE family_id IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {_MEMBERS}, r AS (SELECT doc_id AS root, doc_id FROM a_documents UNION SELECT r.root, b.doc_id FROM r JOIN m a ON a.doc_id = r.doc_id JOIN m b ON b.key = a.key)
    SELECT doc_id, min(root) AS class_id, count(DISTINCT root) AS n_members FROM r GROUP BY doc_id""",
    "a_documents",
)
def related_classes(spark, sf_dir):
    """Which documents hang together through applications and families, over any number of steps?"""
    return families.related_classes(T(spark, sf_dir).a_documents)


@query(
    """SELECT d.doc_id, o.doc_id AS related_id, list_sort(list_filter([CASE WHEN d.application_number = o.application_number THEN 'application_number' END,
      CASE WHEN d.family_id = o.family_id THEN 'family_id' END], lambda x: x IS NOT NULL)) AS via
    FROM a_documents d JOIN a_documents o ON d.doc_id <> o.doc_id AND (d.application_number = o.application_number OR d.family_id = o.family_id) WHERE d.review_state = 'skipped'""",
    "a_documents",
)
def related_to_skipped(spark, sf_dir):
    """What is related to the documents that reviewers skipped?"""
    d = T(spark, sf_dir).a_documents
    return families.related_to(d.where("review_state = 'skipped'"), d)



_HITS = "hits AS (SELECT doc_id AS pos, pub_key, family_id, publication_date, abstract IS NOT NULL AND language = 'en' AS english FROM a_documents)"
_CHOSEN = (
    _HITS
    + """,
chosen AS (SELECT coalesce('fam:' || family_id, 'pub:' || pub_key) AS family, min(pos) AS first_pos,
  arg_min({'pos': pos, 'pub_key': pub_key, 'd': publication_date, 'f': family_id}, (NOT english, publication_date IS NULL, coalesce(publication_date, DATE '9999-12-31'), pos)) AS s FROM hits GROUP BY 1)"""
)


def _chosen(t: T) -> DataFrame:
    hits = t.a_documents.select(
        F.col("doc_id").alias("pos"), "pub_key", "family_id", "publication_date", (F.col("abstract").isNotNull() & (F.col("language") == "en")).alias("english")
    )
    return corpus.one_per_family(hits)


@query(f"WITH {_CHOSEN} SELECT family, first_pos, s.pos AS pos, s.pub_key AS pub_key, s.d AS publication_date FROM chosen", "a_documents")
def one_per_family(spark, sf_dir):
    return _chosen(T(spark, sf_dir))


_SPLIT = (
    _CHOSEN
    + """,
known AS (SELECT * FROM a_documents WHERE doc_id % 9 = 0),
split AS (SELECT s.pos AS pos, s.pub_key AS pub_key, CASE WHEN s.pub_key IN (SELECT pub_key FROM known) THEN 'duplicate'
  WHEN s.f IN (SELECT family_id FROM known WHERE family_id IS NOT NULL) THEN 'family' ELSE 'new' END AS known_as FROM chosen)"""
)


def _split(t: T) -> DataFrame:
    chosen = _chosen(t).join(t.a_documents.select(F.col("doc_id").alias("pos"), "family_id"), "pos")
    return corpus.split_known(chosen, t.a_documents.where("doc_id % 9 = 0")).select("pos", "pub_key", "known_as")


@query(f"WITH {_SPLIT} SELECT pos, pub_key, known_as FROM split", "a_documents")
def split_known(spark, sf_dir):
    return _split(T(spark, sf_dir))


@query(
    f"""WITH {_SPLIT} SELECT (SELECT count(*) FROM hits) AS scanned, count(*) AS families, count(*) FILTER (WHERE known_as = 'family') AS known_families,
    count(*) FILTER (WHERE known_as = 'duplicate') AS duplicates, count(*) FILTER (WHERE known_as = 'new') AS imported FROM split""",
    "a_documents",
)
def batch_report(spark, sf_dir):
    t = T(spark, sf_dir)
    return corpus.batch_report(t.a_documents, _split(t))


_TIER = "CASE WHEN requested THEN 1 WHEN application_number = request_app THEN 2 ELSE 3 END"
_RANK = f"CASE WHEN {_TIER} < 3 THEN 0 ELSE CASE country WHEN 'WO' THEN 0 WHEN 'US' THEN 1 WHEN 'GB' THEN 2 WHEN 'EP' THEN 3 ELSE 4 END END"


@query(
    f"""SELECT request_id, arg_min(english, ({_TIER}, {_RANK}, pos)) AS text, arg_min(docdb_id, ({_TIER}, {_RANK}, pos)) AS source_docdb_id
    FROM a_candidates WHERE english IS NOT NULL GROUP BY request_id""",
    "a_candidates",
)
def selected_text(spark, sf_dir):
    return corpus.select_text(T(spark, sf_dir).a_candidates)


@query(
    f"""SELECT request_id, arg_min(t.title, ({_TIER}, {_RANK}, pos)) AS text, arg_min(docdb_id, ({_TIER}, {_RANK}, pos)) AS source_docdb_id
    FROM a_candidates c JOIN (SELECT doc_id, CASE WHEN language = 'en' THEN title END AS title FROM a_documents) t ON t.doc_id = c.pos WHERE t.title IS NOT NULL GROUP BY request_id""",
    "a_candidates", "a_documents",
)
def selected_title(spark, sf_dir):
    """The same cascade for the title."""
    t = T(spark, sf_dir)
    titles = t.a_documents.select(F.col("doc_id").alias("pos"), F.when(F.col("language") == "en", F.col("title")).alias("title"))
    return corpus.select_text(t.a_candidates.join(titles, "pos"), "title")


@query(
    f"""SELECT request_id, arg_min(docdb_id, (lower(language) <> 'en', {_TIER}, {_RANK}, pos)) AS source, arg_min(language, (lower(language) <> 'en', {_TIER}, {_RANK}, pos)) AS lang,
    bool_and(lower(language) <> 'en') AS non_english_only FROM a_candidates WHERE language IS NOT NULL GROUP BY request_id""",
    "a_candidates",
)
def selected_fulltext(spark, sf_dir):
    return corpus.select_fulltext(T(spark, sf_dir).a_candidates)


@query(f"SELECT request_id, arg_min(docdb_id, ({_TIER}, {_RANK}, pos)) AS source FROM a_candidates WHERE has_drawings GROUP BY request_id", "a_candidates")
def selected_drawings(spark, sf_dir):
    return corpus.select_drawings(T(spark, sf_dir).a_candidates)


@query(
    f"""SELECT request_id, docdb_id, min({_TIER}) AS tier, min(pos) AS pos FROM a_candidates WHERE NOT requested GROUP BY request_id, docdb_id""", "a_candidates"
)
def candidate_set(spark, sf_dir):
    c = T(spark, sf_dir).a_candidates.select("request_id", "docdb_id", "pos", "requested", "application_number", "request_app")
    return corpus.candidate_set(c.where("application_number = request_app").drop("application_number", "request_app"), c.drop("application_number", "request_app"))


@query(
    f"SELECT DISTINCT request_id FROM a_candidates WHERE request_id NOT IN (SELECT request_id FROM a_candidates WHERE english IS NOT NULL AND {_TIER} < 3)", "a_candidates"
)
def requests_for_family(spark, sf_dir):
    return corpus.needs_family(T(spark, sf_dir).a_candidates)


@query("SELECT request_id, list(DISTINCT split_part(docdb_id, '.', 3) ORDER BY split_part(docdb_id, '.', 3)) AS kinds FROM a_candidates GROUP BY request_id", "a_candidates")
def kind_codes(spark, sf_dir):
    return corpus.kind_codes(T(spark, sf_dir).a_candidates)


@query(
    """SELECT doc_id, pub_key FROM a_documents WHERE (contains(upper(applicant), 'SRC1') OR contains(upper(applicant), 'SRC7')) AND country = 'EP'
    AND publication_date BETWEEN DATE '2012-01-01' AND DATE '2018-12-31'""",
    "a_documents",
)
def applicant_search(spark, sf_dir):
    return corpus.applicant_search(T(spark, sf_dir).a_documents, 'src1; "src7"', "ep", 2012, 2018).select("doc_id", "pub_key")


_RANKED = """r AS (SELECT applicant AS search, doc_id, docdb_id, publication_date, row_number() OVER (PARTITION BY applicant ORDER BY publication_date DESC NULLS LAST, docdb_id) AS rank
  FROM (SELECT *, concat(country, '.', number, '.', kind) AS docdb_id FROM a_documents))"""


def _batch(t: T):
    hits = t.a_documents.select(F.col("applicant").alias("search"), "publication_date", numbers.docdb_id(F.col("country"), F.col("number"), F.col("kind")).alias("docdb_id"))
    state = hits.select("search").distinct().withColumn("next_start", F.lit(11).cast("bigint"))
    return corpus.search_batch(hits, state)


@query(f"WITH {_RANKED} SELECT search, docdb_id, publication_date, rank FROM r WHERE rank BETWEEN 11 AND 110", "a_documents")
def search_batch(spark, sf_dir):
    return _batch(T(spark, sf_dir))[0].select("search", "docdb_id", "publication_date", "rank")


@query(
    f"""WITH {_RANKED}, n AS (SELECT search, count(*) AS total FROM r GROUP BY search), s AS (SELECT search, total, greatest(11, least(111, least(total, 2000) + 1)) AS next_start FROM n)
    SELECT search, next_start, total, next_start > least(total, 2000) AS exhausted, least(next_start - 1, total) AS results_read, total > 2000 AS capped FROM s""",
    "a_documents",
)
def search_progress(spark, sf_dir):
    return _batch(T(spark, sf_dir))[1]


_LINES = r"""
l0 AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS n, unnest(string_split(t, chr(10))) AS line FROM src),
l1 AS (SELECT *, coalesce(sum(length(line) + length(regexp_replace(line, '[^\x{10000}-\x{10FFFF}]', '', 'g')) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM l0),
lines AS (SELECT *, (start + length(line) + length(regexp_replace(line, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::INT AS stop, regexp_replace(line, '^\s+|\s+$', '', 'g') AS body FROM l1 WHERE regexp_replace(line, '\s', '', 'g') <> '')"""
# even lines get a paragraph number
_NUMBERED = """src AS (SELECT doc_id, string_agg(CASE WHEN i % 2 = 0 THEN '[000' || (i % 10) || '] ' || x ELSE x END, chr(10) ORDER BY i) AS t
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL) GROUP BY doc_id)"""
# every line is a claim; of four claims the first depends on none, the others on one or more before them
_CLAIMS = """cl AS (SELECT doc_id, i, concat(CAST(i AS VARCHAR), CASE WHEN i % 2 = 0 THEN ') ' ELSE '. ' END, x, CASE i % 4 WHEN 1 THEN '' WHEN 2 THEN ' of claim ' || (i - 1)
    WHEN 3 THEN ' as in claims ' || (i - 2) || ' or ' || (i - 1) ELSE ' of claims ' || (i - 3) || ' to ' || (i - 1) END) AS line
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL)),
src AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM cl GROUP BY doc_id)"""


def _numbered(t: T) -> DataFrame:
    parts = F.transform(
        F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("[000"), (i % 10).cast("string"), F.lit("] "), x)).otherwise(x)
    )
    return t.documents.where("text IS NOT NULL").select("doc_id", F.array_join(parts, "\n").alias("description"))


def _claims(t: T) -> DataFrame:
    def claim(x, at):
        i = at + 1
        n = [(i - k).cast("string") for k in range(4)]
        ends = (
            F.when(i % 4 == 1, "").when(i % 4 == 2, F.concat(F.lit(" of claim "), n[1])).when(i % 4 == 3, F.concat(F.lit(" as in claims "), n[2], F.lit(" or "), n[1]))
            .otherwise(F.concat(F.lit(" of claims "), n[3], F.lit(" to "), n[1]))
        )
        return F.concat(n[0], F.when(i % 2 == 0, ") ").otherwise(". "), x, ends)

    return t.documents.where("text IS NOT NULL").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), claim), "\n").alias("claims"))


@query(
    rf"""WITH {_NUMBERED}, {_LINES} SELECT doc_id, n::INT AS n, CASE WHEN regexp_matches(line, '^\s*\[[0-9]+\]') THEN 'paragraph'
    WHEN length(body) <= 120 AND NOT regexp_matches(body, '[.,;]$') AND regexp_matches(regexp_extract(body, '\p{{L}}'), '^\p{{Lu}}') THEN 'heading' ELSE 'paragraph' END AS kind,
    nullif(regexp_extract(line, '^\s*\[([0-9]+)\]', 1), '') AS label, start, stop FROM lines"""
)
def description_blocks(spark, sf_dir):
    return outline.description_blocks(_numbered(T(spark, sf_dir)))


@query(
    rf"""WITH {_CLAIMS}, {_LINES}, b AS (SELECT *, nullif(regexp_extract(line, '^\s*([0-9]+)[.)]', 1), '') AS label,
    count(nullif(regexp_extract(line, '^\s*([0-9]+)[.)]', 1), '')) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM lines)
    SELECT doc_id, block, max(label) AS label, min(start) AS start, max(stop) AS stop FROM b GROUP BY doc_id, block"""
)
def claim_blocks(spark, sf_dir):
    return outline.claim_blocks(_claims(T(spark, sf_dir)))


@query(
    rf"""WITH {_CLAIMS}, {_LINES}, c AS (SELECT doc_id, (n + 1)::INT AS claim, stop FROM lines),
    d AS (SELECT *, length(CAST(claim - 1 AS VARCHAR)) AS w1, length(CAST(claim - 2 AS VARCHAR)) AS w2, length(CAST(claim - 3 AS VARCHAR)) AS w3 FROM c)
    SELECT doc_id, claim::BIGINT AS claim, (stop - 6 - w1)::INT AS start, stop::INT AS stop, (claim - 1)::BIGINT AS ref, true AS depends FROM d WHERE claim % 4 = 2
    UNION ALL SELECT doc_id, claim::BIGINT AS claim, (stop - w1)::INT, stop::INT, claim - 1, true FROM d WHERE claim % 4 IN (3, 0)
    UNION ALL SELECT doc_id, claim::BIGINT AS claim, (stop - 11 - w1 - w2)::INT, (stop - 4 - w1)::INT, claim - 2, true FROM d WHERE claim % 4 = 3
    UNION ALL SELECT doc_id, claim::BIGINT AS claim, (stop - 11 - w1 - w3)::INT, (stop - 4 - w1)::INT, claim - 3, true FROM d WHERE claim % 4 = 0
    UNION ALL SELECT doc_id, claim::BIGINT AS claim, NULL, NULL, claim - 2, true FROM d WHERE claim % 4 = 0"""
)
def claim_references(spark, sf_dir):
    return outline.claim_refs(_claims(T(spark, sf_dir)))


@query(
    f"""WITH {_CLAIMS} SELECT doc_id, i::BIGINT AS claim, i % 4 = 1 AS is_independent, ((i - 1) % 4)::INT AS depth, (i - (i - 1) % 4)::BIGINT AS base FROM cl"""
)
def claim_tree(spark, sf_dir):
    return outline.claim_tree(_claims(T(spark, sf_dir)))


_RESOLVED = """SELECT id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 10 WHEN strpos(text, quote) > 0 THEN (SELECT arg_min(p, (abs(p - 10), p)) FROM (SELECT unnest(list_transform(range(1, len(string_split(text, quote))),
      lambda i: CAST(list_sum(list_transform(string_split(text, quote)[1:i], lambda x: length(x))) + (i - 1) * length(quote) AS INT))) AS p)) ELSE 10 END::INT AS new_start,
      CASE WHEN doc_id % 3 = 0 THEN false ELSE strpos(text, quote) = 0 END AS detached FROM a_highlights"""


@query(_RESOLVED, "a_highlights")
def resolved_highlights(spark, sf_dir):
    return outline.resolve_highlights(T(spark, sf_dir).a_highlights).select("id", "doc_id", "new_start", "detached")


@query(
    rf"""WITH src AS (SELECT doc_id, text AS t FROM a_highlights), {_LINES}, h AS ({_RESOLVED}),
    b AS (SELECT doc_id, start, stop, nullif(regexp_extract(line, '^\s*\[([0-9]+)\]', 1), '') AS label, length(body) <= 120 AND NOT regexp_matches(body, '[.,;]$')
      AND regexp_matches(regexp_extract(body, '\p{{L}}'), '^\p{{Lu}}') AND NOT regexp_matches(line, '^\s*\[[0-9]+\]') AS heading FROM lines)
    SELECT h.id, CASE WHEN detached OR b.doc_id IS NULL THEN 'Description' WHEN heading THEN 'Description, heading' WHEN label IS NOT NULL THEN concat('Description [', label, ']') ELSE 'Description' END AS location
    FROM h LEFT JOIN b ON b.doc_id = h.doc_id AND NOT detached AND b.start <= new_start AND new_start < b.stop""",
    "a_highlights",
)
def highlight_places(spark, sf_dir):
    """Where in its description every highlight lies; one in no block, or without its passage, is told by the section."""
    t = T(spark, sf_dir)
    blocks = outline.description_blocks(t.a_highlights, "text").withColumn("section", F.lit("description"))
    return outline.highlight_locations(outline.resolve_highlights(t.a_highlights), blocks).select("id", "location")


@query(
    r"""SELECT doc_id, length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units, CASE WHEN length(text) >= 15 THEN substring(text, 6, 10) END AS slice,
    trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, nullif(trim(lang), '') AS lang FROM documents"""
)
def text_functions(spark, sf_dir):
    d = T(spark, sf_dir).documents
    return d.select(
        "doc_id", text.utf16_len(F.col("text")).cast("bigint").alias("units"), text.utf16_slice(F.col("text"), F.lit(5), F.lit(15)).alias("slice"),
        text.norm_ws(F.col("text")).alias("flat"), text.blank_to_null(F.col("lang")).alias("lang"),
    )


@query(
    """SELECT doc_id, strftime(publication_date, '%Y-%m-%d') AS day, strftime(to_timestamp(doc_id * 86400)::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS at FROM a_documents""", "a_documents"
)
def date_functions(spark, sf_dir):
    d = T(spark, sf_dir).a_documents
    return d.select("doc_id", text.ops_date(F.date_format("publication_date", "yyyyMMdd")).alias("day"), text.iso_utc(F.col("doc_id") * 86400).alias("at"))


@query("SELECT doc_id, [lang, source] AS items FROM documents")
def json_lists(spark, sf_dir):
    d = T(spark, sf_dir).documents
    return d.select("doc_id", text.json_list(F.to_json(F.array("lang", "source"))).alias("items"))


def escaped(c: str) -> F.Column:
    """A text as XML has it."""
    c = F.coalesce(c, F.lit(""))
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _xml(t: T) -> DataFrame:
    d = t.a_documents
    body = F.concat(
        F.lit('<exchange-document country="'), F.col("country"), F.lit('" doc-number="'), F.col("number"), F.lit('" kind="'), F.col("kind"), F.lit('" family-id="'),
        F.coalesce(F.col("family_id").cast("string"), F.lit("")), F.lit('"><bibliographic-data><application-reference><document-id document-id-type="epodoc"><doc-number>'),
        F.col("application_number"), F.lit('</doc-number></document-id></application-reference><invention-title lang="en">'), escaped("title"),
        F.lit('</invention-title></bibliographic-data><abstract lang="en"><p>'), escaped("abstract"), F.lit("</p></abstract></exchange-document>"),
    )
    return d.select(F.col("doc_id").alias("id"), body.alias("xml"))


@query(
    r"""SELECT doc_id AS id, concat(country, '.', number, '.', kind) AS docdb_id, application_number, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title,
    regexp_replace(coalesce(abstract, ''), '^\s+|\s+$', '', 'g') AS abstract FROM a_documents""",
    "a_documents",
)
def parsed_publications(spark, sf_dir):
    p = files.parse_publications(_xml(T(spark, sf_dir)))
    return p.select("id", "docdb_id", "application_number", F.col("titles")["en"].alias("title"), F.col("abstracts")["en"].alias("abstract"))


PAGE = 20


def _written(rows: DataFrame, name: str) -> str:
    """Rows (path, text) as files in a new folder."""
    path = shared_path(rows.sparkSession, name)
    formats.write_text_files(rows, path)
    return path


def _number(col: str = "file") -> F.Column:
    return F.regexp_extract(col, r"([0-9]+)\.[a-z]+$", 1).cast("bigint")


def _pages(t: T) -> DataFrame:
    """Search responses of twenty publications."""
    each = _xml(t).groupBy(F.floor(F.col("id") / PAGE).alias("page")).agg(F.array_sort(F.collect_list(F.struct("id", "xml"))).alias("x"))
    text = F.concat(F.lit('<s total-result-count="'), F.size("x").cast("string"), F.lit('">'), F.array_join("x.xml", ""), F.lit("</s>"))
    return each.select(F.concat(F.col("page").cast("string"), F.lit(".xml")).alias("path"), text.alias("text"))


@query(
    rf"""SELECT doc_id // {PAGE} AS page, concat(country, '.', number, '.', kind) AS docdb_id, application_number, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title,
    regexp_replace(coalesce(abstract, ''), '^\s+|\s+$', '', 'g') AS abstract FROM a_documents""",
    "a_documents",
)
def publication_files(spark, sf_dir):
    """Publications of written response files, read by the data source."""
    p = formats.read_publications(spark, _written(_pages(T(spark, sf_dir)), "publications"))
    return p.select(_number().alias("page"), "docdb_id", "application_number", F.col("titles")["en"].alias("title"), F.col("abstracts")["en"].alias("abstract"))


@query(f"SELECT doc_id // {PAGE} AS page, count(*) AS total FROM a_documents GROUP BY ALL", "a_documents")
def search_page_files(spark, sf_dir):
    totals, _ = formats.read_search_pages(spark, _written(_pages(T(spark, sf_dir)), "pages"))
    return totals.where("error IS NULL").select(_number().alias("page"), "total")


def _fulltexts(t: T) -> DataFrame:
    """A response for each document: what there is, its description and claims, and drawings."""
    d = t.a_documents
    other = F.when(F.col("doc_id") % 3 == 0, "CLAIMS").otherwise("other")
    text = F.concat(
        F.lit('<f><fulltext-instance lang="en" desc="Description"/><fulltext-instance lang="de" desc="'), other, F.lit('"/><document-instance desc="Drawing" link="d/'),
        F.col("doc_id").cast("string"), F.lit('" number-of-pages="'), (F.col("doc_id") % 7).cast("string"),
        F.lit('"/><document-instance desc="Drawing" link="x"/><document-instance desc="Other"/><description lang="EN"><heading>'), escaped("title"),
        F.lit("</heading><p>"), escaped("abstract"), F.lit('</p><p>a<tables/></p></description><claims lang="en"><claim><claim-text>'), escaped("applicant"),
        F.lit("</claim-text></claim></claims></f>"),
    )
    return d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".xml")).alias("path"), text.alias("text"))


@query("SELECT doc_id, 'en' AS lang, 'description' AS part FROM a_documents UNION ALL SELECT doc_id, 'de', 'claims' FROM a_documents WHERE doc_id % 3 = 0", "a_documents")
def fulltext_part_files(spark, sf_dir):
    formats.register_formats(spark)
    path = _written(_fulltexts(T(spark, sf_dir)), "parts")
    return spark.read.format("fulltext_parts_xml").load(path).select(_number().alias("doc_id"), "lang", "part")


@query(
    r"""SELECT doc_id, array_to_string(list_filter([trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')), trim(regexp_replace(coalesce(abstract, ''), '\s+', ' ', 'g'))],
      lambda x: x <> '') || ['[Table 2 not reproduced]'], chr(10)) AS description, trim(regexp_replace(coalesce(applicant, ''), '\s+', ' ', 'g')) AS claims FROM a_documents""",
    "a_documents",
)
def fulltext_text_files(spark, sf_dir):
    path = _written(_fulltexts(T(spark, sf_dir)), "texts")
    described, claimed = (formats.read_texts(spark, path, part, "en").select(_number().alias("doc_id"), F.col("text").alias(part)) for part in ("description", "claims"))
    return described.join(claimed, "doc_id")


@query("SELECT doc_id, 'Drawing' AS desc, 'd/' || doc_id AS link, doc_id % 7 AS pages FROM a_documents", "a_documents")
def drawing_files(spark, sf_dir):
    formats.register_formats(spark)
    return spark.read.format("drawings_xml").load(_written(_fulltexts(T(spark, sf_dir)), "drawings")).select(_number().alias("doc_id"), "desc", "link", "pages")


@query(
    "SELECT line_no // 50 AS file_no, line_no % 50 * 2 AS place, trim(input_raw) AS input_raw FROM a_number_lines WHERE trim(input_raw) <> ''", "a_number_lines"
)
def number_list_files(spark, sf_dir):
    """Lines of written lists of fifty numbers, with Windows line ends and a blank line after each."""
    lists = T(spark, sf_dir).a_number_lines.groupBy(F.floor(F.col("line_no") / 50).alias("n")).agg(F.array_sort(F.collect_list(F.struct("line_no", "input_raw"))).alias("x"))
    text = F.array_join(F.col("x.input_raw"), "\r\n \r\n")
    path = _written(lists.select(F.concat(F.col("n").cast("string"), F.lit(".txt")).alias("path"), text.alias("text")), "lists")
    formats.register_formats(spark)
    rows = spark.read.format("number_list").load(path)
    return rows.select(_number().alias("file_no"), F.col("line_no").bitwiseAND((1 << 33) - 1).alias("place"), "input_raw")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'skipped' ELSE review_state END AS review_state FROM a_documents""", "a_documents"
)
def updated_documents(spark, sf_dir):
    d = T(spark, sf_dir).a_documents
    return labels.apply_document_updates(d, d.where("doc_id % 5 = 0").select("doc_id", F.lit("skipped").alias("review_state"))).select("doc_id", "review_state")
