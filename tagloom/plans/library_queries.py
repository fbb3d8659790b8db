"""Queries of library, exports, tag administration and jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_folder_name, upper_by_letter
from ..operators import automation, exports, labels, library, stored_index, tags
from ..operators.kept import shared_path
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


@query("SELECT doc_id, pub_key FROM a_documents WHERE fetch_status = 'fetched' AND review_state = 'queued'", "a_documents")
def review_queue(spark, sf_dir):
    return library.review_queue(T(spark, sf_dir).a_documents).select("doc_id", "pub_key")


@query(
    """SELECT doc_id, pub_key, title FROM a_documents WHERE fetch_status <> 'not_found' AND (contains(pub_key, 'EP10001') OR contains(lower(title), 'ep 1,0001'))
    ORDER BY (pub_key = 'EP10001')::INT DESC, doc_id DESC LIMIT 20""",
    "a_documents",
)
def found_documents(spark, sf_dir):
    return library.find_documents(T(spark, sf_dir).a_documents, "ep 1,0001", 20)


_FOLD = "strip_accents(lower({}))"
_TOKENS = f"""
t0 AS (SELECT doc_id, 'title' AS section, list_filter(regexp_split_to_array({_FOLD.format('title')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM a_documents WHERE title IS NOT NULL
  UNION ALL SELECT doc_id, 'abstract', list_filter(regexp_split_to_array({_FOLD.format('abstract')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') FROM a_documents WHERE abstract IS NOT NULL),
idx AS (SELECT doc_id, section, unnest(w) AS token, generate_subscripts(w, 1)::INT - 1 AS pos FROM t0)"""


@query(f"WITH {_TOKENS} SELECT token, section, doc_id, list(pos ORDER BY pos) AS positions FROM idx GROUP BY token, section, doc_id", "a_documents")
def term_index(spark, sf_dir):
    return library.build_term_index(T(spark, sf_dir).a_documents)


@query(
    f"""WITH {_TOKENS} SELECT doc_id FROM idx GROUP BY doc_id HAVING bool_or(token = 'the') AND bool_or(token = 'of') AND bool_or(starts_with(token, 'th'))
    AND NOT bool_or(token = 'license') AND doc_id IN (SELECT a.doc_id FROM idx a JOIN idx b ON a.doc_id = b.doc_id AND a.section = b.section AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the')""",
    "a_documents",
)
def text_matches(spark, sf_dir):
    index = library.build_term_index(T(spark, sf_dir).a_documents)
    return library.text_match(index, all_of=("the", "of"), none_of=("license",), phrases=(("of", "the"),), prefixes=("th",))


@query(
    """SELECT d.doc_id, d.pub_key, d.title, d.review_state,
    coalesce((SELECT list(DISTINCT tag_id ORDER BY tag_id) FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND state = 'pos'), []) AS tags,
    EXISTS (SELECT 1 FROM a_drawings r WHERE r.doc_id = d.doc_id AND r.status = 'fetched') AS has_drawings
    FROM a_documents d WHERE fetch_status = 'fetched' AND review_state = 'validated'
    AND EXISTS (SELECT 1 FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND source = 'human')
    AND EXISTS (SELECT 1 FROM a_fulltext f WHERE f.doc_id = d.doc_id AND f.status IN ('fetched', 'non_english_only'))
    AND EXISTS (SELECT 1 FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND state = 'pos' AND tag_id = 0)
    AND NOT EXISTS (SELECT 1 FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND state = 'pos' AND tag_id = 1)""",
    "a_documents", "a_doc_labels", "a_fulltext", "a_drawings",
)
def library_search(spark, sf_dir):
    t = T(spark, sf_dir)
    f = library.LibraryFilters(include_tags=(0,), exclude_tags=(1,), label_source="human", review_state="validated", has_fulltext=True)
    return library.library_search(t.a_documents, t.a_doc_labels, t.a_fulltext, t.a_drawings, f)


@query(
    f"""WITH {_TOKENS} SELECT doc_id FROM idx GROUP BY doc_id HAVING bool_or(token = 'the') AND bool_or(token = 'of') AND bool_or(starts_with(token, 'th'))
    AND NOT bool_or(token = 'license') AND doc_id IN (SELECT a.doc_id FROM idx a JOIN idx b ON a.doc_id = b.doc_id AND a.section = b.section AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the')""",
    "a_documents",
)
def stored_text_matches(spark, sf_dir):
    """The same over a stored index: made of a part of the documents with older titles, then brought up to date."""
    d = T(spark, sf_dir).a_documents.select("doc_id", "title", "abstract")
    old = d.where("doc_id % 3 <> 1").withColumn("title", F.when(F.col("doc_id") % 4 == 0, "of the license and their").otherwise(F.col("title")))
    index = stored_index.StoredIndex.create(old, shared_path(spark, "index"))
    index.upsert(d.where("doc_id % 3 = 1 OR doc_id % 4 = 0"))
    return index.match(all_of=("the", "of"), none_of=("license",), phrases=(("of", "the"),), prefixes=("th",))


@query(
    f"""WITH {_TOKENS} SELECT d.doc_id, d.pub_key, d.title, d.review_state,
    coalesce((SELECT list(DISTINCT tag_id ORDER BY tag_id) FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND state = 'pos'), []) AS tags,
    EXISTS (SELECT 1 FROM a_drawings r WHERE r.doc_id = d.doc_id AND r.status = 'fetched') AS has_drawings
    FROM a_documents d WHERE fetch_status = 'fetched' AND review_state = 'validated'
    AND EXISTS (SELECT 1 FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND source = 'human')
    AND EXISTS (SELECT 1 FROM a_fulltext f WHERE f.doc_id = d.doc_id AND f.status IN ('fetched', 'non_english_only'))
    AND EXISTS (SELECT 1 FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND state = 'pos' AND tag_id = 0)
    AND NOT EXISTS (SELECT 1 FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND state = 'pos' AND tag_id = 1)
    AND EXISTS (SELECT 1 FROM idx WHERE idx.doc_id = d.doc_id AND token = 'the' AND section = 'abstract') AND EXISTS (SELECT 1 FROM idx WHERE idx.doc_id = d.doc_id AND token = 'that' AND section = 'abstract')""",
    "a_documents", "a_doc_labels", "a_fulltext", "a_drawings",
)
def library_search_text(spark, sf_dir):
    """The library search with words of the abstract, looked up in a stored index."""
    t = T(spark, sf_dir)
    index = stored_index.StoredIndex.create(t.a_documents, shared_path(spark, "index"))
    f = library.LibraryFilters(text=("the", "that"), sections=("abstract",), include_tags=(0,), exclude_tags=(1,), label_source="human", review_state="validated", has_fulltext=True)
    return library.library_search(t.a_documents, t.a_doc_labels, t.a_fulltext, t.a_drawings, f, index)


@query(
    r"""WITH s AS (SELECT doc_id, 1 AS place, 'title' AS section, '𝛼 ' || split_part(text, chr(10), 1) AS text FROM documents UNION ALL SELECT doc_id, 3, 'description', text FROM documents),
    p AS (SELECT doc_id, place, section, string_split(lower(text), 'tion') AS p FROM s WHERE contains(lower(text), 'tion')),
    h AS (SELECT doc_id, place, section, p, unnest(range(1, len(p))) AS i FROM p),
    u AS (SELECT *, list_sum(list_transform(p[1:i], lambda x: length(x) + length(regexp_replace(x, '[^\x{10000}-\x{10FFFF}]', '', 'g')))) + (i - 1) * 4 AS start FROM h)
    SELECT doc_id, section, (row_number() OVER (PARTITION BY doc_id ORDER BY place, start))::INT AS n, start::INT AS start, (start + 4)::INT AS stop FROM u"""
)
def places_in_documents(spark, sf_dir):
    """Two sections a document, one with a letter of two UTF-16 units."""
    d = T(spark, sf_dir).documents
    title = d.select("doc_id", F.lit("title").alias("section"), F.concat(F.lit("𝛼 "), F.split_part("text", F.lit("\n"), F.lit(1))).alias("text"))
    return library.find_in_documents(title.unionByName(d.select("doc_id", F.lit("description").alias("section"), "text")), " TION ")


_ROWS = """
rows AS (SELECT d.doc_id, d.pub_key AS publication_number, d.title,
  coalesce((SELECT list(DISTINCT t.name ORDER BY t.name) FROM a_doc_labels l JOIN a_tags t ON t.tag_id = l.tag_id WHERE l.doc_id = d.doc_id AND state = 'pos'), []) AS tags,
  CASE WHEN abstract_source IS NOT NULL THEN [concat('abstract ', abstract_source)] ELSE [] END AS sources FROM a_documents d WHERE fetch_status = 'fetched')"""
_EXPORT = ("a_documents", "a_doc_labels", "a_tags")


def _rows(t: T) -> DataFrame:
    return exports.export_rows(t.a_documents, t.a_doc_labels, t.a_tags).drop("highlights")


def _marks(t: T) -> DataFrame:
    """Two highlights of each marked text, the second one told first."""
    own = t.a_highlights.select("id", "doc_id", "section", "start", "quote", F.lit(None).cast("string").alias("comment"), F.lit("green").alias("color"))
    later = own.select("id", "doc_id", F.lit("claims").alias("section"), F.lit(0).alias("start"), upper_by_letter(F.col("quote")).alias("quote"), F.lit("a note").alias("comment"), F.lit("blue").alias("color"))
    return later.unionByName(own)


@query(
    f"""WITH {_ROWS} SELECT r.doc_id, CASE WHEN h.doc_id IS NULL THEN [] ELSE [h.quote, upper(h.quote)] END AS quotes, CASE WHEN h.doc_id IS NULL THEN [] ELSE ['description', 'claims'] END AS sections,
    CASE WHEN h.doc_id IS NULL THEN [] ELSE [NULL, 'a note'] END AS comments FROM rows r LEFT JOIN a_highlights h ON h.doc_id = r.doc_id""",
    *_EXPORT, "a_highlights",
)
def export_highlights(spark, sf_dir):
    """Highlights of the exported rows, in the order of the text."""
    t = T(spark, sf_dir)
    rows = exports.export_rows(t.a_documents, t.a_doc_labels, t.a_tags, _marks(t))
    return rows.select("doc_id", F.col("highlights.quote").alias("quotes"), F.col("highlights.section").alias("sections"), F.col("highlights.comment").alias("comments"))


@query(f"WITH {_ROWS} SELECT * FROM rows", *_EXPORT)
def export_rows(spark, sf_dir):
    return _rows(T(spark, sf_dir))


_CELL = "CASE WHEN regexp_matches({0}, '[,\"\\n]') THEN concat('\"', replace({0}, '\"', '\"\"'), '\"') ELSE {0} END"


@query(
    f"""WITH {_ROWS} SELECT doc_id, concat({_CELL.format('publication_number')}, ',', {_CELL.format("coalesce(title, '')")}, ',', {_CELL.format("array_to_string(tags, '; ')")}, ',', {_CELL.format("array_to_string(sources, '; ')")}) AS line FROM rows""",
    *_EXPORT,
)
def export_csv_lines(spark, sf_dir):
    return exports.to_csv_lines(_rows(T(spark, sf_dir)))


@query(f"WITH {_ROWS} SELECT * FROM rows WHERE list_contains(tags, 'tag_1')", *_EXPORT)
def export_one_tag(spark, sf_dir):
    return exports.one_tag(_rows(T(spark, sf_dir)), "tag_1")


@query("SELECT DISTINCT l.tag_id, d.pub_key FROM a_doc_labels l JOIN a_documents d ON d.doc_id = l.doc_id WHERE state = 'pos'", "a_documents", "a_doc_labels")
def tag_lists(spark, sf_dir):
    t = T(spark, sf_dir)
    return exports.tag_lists(t.a_doc_labels, t.a_documents)


def _part(col: str, label: str) -> str:
    return f"""CASE WHEN f.status = 'not_available' THEN concat('Full text not available in OPS.', chr(10)) WHEN f.status = 'error' THEN concat('Full text retrieval failed.', chr(10))
    WHEN f.status IN ('fetched', 'non_english_only') AND f.{col} IS NOT NULL THEN concat(CASE WHEN f.status = 'non_english_only' THEN concat('[Non-English text, language: ', f.lang, ']', chr(10)) ELSE '' END, f.{col}, chr(10))
    WHEN f.status IN ('fetched', 'non_english_only') THEN concat('{label} not available for this publication.', chr(10)) ELSE concat('{label} not retrieved.', chr(10)) END"""


@query(
    f"""SELECT d.doc_id, d.pub_key, concat('Publication: ', d.pub_key, ' (', d.kind, ')', chr(10), 'Title: ', coalesce(d.title, 'Not available'), chr(10), 'Applicants: ', d.applicant, chr(10),
    'Publication date: ', coalesce(CAST(d.publication_date AS VARCHAR), 'Not available'), chr(10), 'CPC: Not available', chr(10), 'Tags: None', chr(10), 'Sources: ',
    coalesce(nullif(concat_ws('; ', CASE WHEN f.source IS NOT NULL THEN concat('full text ', f.source) END, CASE WHEN r.source IS NOT NULL THEN concat('drawings ', r.source) END), ''), 'None'), chr(10), chr(10),
    '===== ABSTRACT =====', chr(10), coalesce(d.abstract, 'Not available'), chr(10), '===== DESCRIPTION =====', chr(10), {_part('description', 'Description')},
    '===== CLAIMS =====', chr(10), {_part('claims', 'Claims')}, '===== DRAWINGS =====', chr(10),
    CASE WHEN r.status = 'fetched' AND r.n_pages > 0 THEN concat(array_to_string(list_transform(range(1, r.n_pages + 1), lambda i: concat('page-', i, '.png')), chr(10)), chr(10))
      WHEN r.status = 'not_available' THEN concat('This publication has no drawings.', chr(10)) WHEN r.status = 'error' THEN concat('Drawings retrieval failed.', chr(10)) ELSE concat('Drawings not retrieved.', chr(10)) END) AS text
    FROM a_documents d LEFT JOIN a_fulltext f ON f.doc_id = d.doc_id LEFT JOIN a_drawings r ON r.doc_id = d.doc_id""",
    "a_documents", "a_fulltext", "a_drawings",
)
def rendered_documents(spark, sf_dir):
    t = T(spark, sf_dir)
    none = F.array().cast("array<string>")
    docs = t.a_documents.select(
        "doc_id", "pub_key", F.array("kind").alias("kinds"), "title", F.array("applicant").alias("applicants"), "publication_date", none.alias("cpc"), none.alias("tags"),
        F.lit(None).cast("string").alias("abstract_source"), "abstract",
    )
    pages = F.when(F.col("n_pages") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n_pages")), lambda i: F.concat(F.lit("page-"), i.cast("string"), F.lit(".png"))))
    return exports.render_documents(docs, t.a_fulltext, t.a_drawings.withColumn("paths", pages))


@query(
    """WITH n AS (SELECT l.doc_id, t.name AS folder FROM a_doc_labels l JOIN a_tags t ON t.tag_id = l.tag_id WHERE state = 'pos' AND NOT archived GROUP BY ALL)
    SELECT coalesce(n.folder, '_untagged') AS folder, d.doc_id, d.pub_key FROM a_documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    *_EXPORT,
)
def document_layout(spark, sf_dir):
    t = T(spark, sf_dir)
    return exports.document_layout(t.a_documents, t.a_doc_labels, t.a_tags)


@query(
    """WITH n AS (SELECT l.doc_id, t.name AS folder FROM a_doc_labels l JOIN a_tags t ON t.tag_id = l.tag_id WHERE state = 'pos' AND NOT archived GROUP BY ALL)
    SELECT concat_ws('/', coalesce(n.folder, '_untagged'), d.pub_key, d.pub_key || '.txt') AS path, d.text FROM (SELECT min(doc_id) AS doc_id, pub_key, pub_key || ': ' || min(doc_id) AS text
      FROM a_documents GROUP BY pub_key) d LEFT JOIN n ON n.doc_id = d.doc_id""",
    *_EXPORT,
)
def written_layout(spark, sf_dir):
    """The tree of documents as it lies in files: written, and read back from their paths."""
    t = T(spark, sf_dir)
    docs = t.a_documents.groupBy("pub_key").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.select("doc_id", F.concat("pub_key", F.lit(": "), F.col("doc_id").cast("string")).alias("text"))
    path = shared_path(spark, "layout")
    exports.write_layout(exports.document_layout(docs, t.a_doc_labels, t.a_tags), texts, path)

    def read(place: str) -> DataFrame:
        return spark.read.format("text_files").load(place)

    # a reader takes a folder that begins like this for hidden, unless it is named
    rows = read(path).unionByName(read(f"{path}/{exports.UNTAGGED}"))
    return rows.select(F.array_join(F.slice(F.split("path", "/"), -3, 3), "/").alias("path"), "text")



@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[\x00-\x1f\x7f-\x9f<>:"/\\|?*]', '_', 'g')), '[. ]+$', '') AS c FROM documents),
    b AS (SELECT *, upper(rtrim(split_part(c, '.', 1))) AS stem FROM a)
    SELECT doc_id, CASE WHEN c = '' THEN '_' WHEN stem IN ('CON', 'PRN', 'AUX', 'NUL') OR regexp_matches(stem, '^(COM|LPT)[1-9]$') THEN concat(c, '_') ELSE c END AS folder FROM b"""
)
def safe_folder_names(spark, sf_dir):
    return T(spark, sf_dir).documents.select("doc_id", safe_folder_name(F.col("text")).alias("folder"))


@query(
    """SELECT t.name, t.definition, p.name AS parent, CASE WHEN t.version = 2 THEN 'red' END AS color, CASE WHEN t.auto_enabled THEN chr(CAST(97 + t.tag_id AS INT)) END AS hotkey
    FROM a_tags t LEFT JOIN a_tags p ON p.tag_id = t.parent_id AND NOT p.archived WHERE NOT t.archived""",
    "a_tags",
)
def tag_scheme(spark, sf_dir):
    tags = T(spark, sf_dir).a_tags
    return exports.export_tag_scheme(
        tags.withColumn("color", F.when(F.col("version") == 2, "red")).withColumn("hotkey", F.when(F.col("auto_enabled"), F.char(97 + F.col("tag_id"))))
    )


@query(
    """WITH b AS (SELECT doc_id AS tag_id, concat('Tag: ', source) AS name, concat('Tag_ ', source) AS base FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY tag_id) AS k FROM b)
    SELECT tag_id, CASE WHEN k = 1 THEN base ELSE concat(base, ' (', k, ')') END AS folder FROM n"""
)
def tag_folders(spark, sf_dir):
    """Folder names of tags of which many clash: the documents' sources stand for names."""
    return exports.tag_folder_names(T(spark, sf_dir).documents.select(F.col("doc_id").alias("tag_id"), F.concat(F.lit("Tag: "), F.col("source")).alias("name")))


@query(
    """WITH RECURSIVE act AS (SELECT * FROM a_tags WHERE NOT archived), tree AS (
      SELECT tag_id, 0 AS depth, [concat(lower(name), chr(1), lpad(CAST(tag_id AS VARCHAR), 12, '0'))] AS path FROM act WHERE parent_id IS NULL OR parent_id NOT IN (SELECT tag_id FROM act)
      UNION ALL SELECT a.tag_id, depth + 1, list_append(path, concat(lower(name), chr(1), lpad(CAST(a.tag_id AS VARCHAR), 12, '0'))) FROM act a JOIN tree t ON a.parent_id = t.tag_id)
    SELECT tag_id, depth, row_number() OVER (ORDER BY path) AS position FROM tree""",
    "a_tags",
)
def tag_tree(spark, sf_dir):
    return tags.tag_tree(T(spark, sf_dir).a_tags)


@query(
    """WITH RECURSIVE up AS (SELECT tag_id, parent_id AS ancestor FROM a_tags WHERE parent_id IS NOT NULL
      UNION SELECT u.tag_id, t.parent_id FROM up u JOIN a_tags t ON t.tag_id = u.ancestor WHERE t.parent_id IS NOT NULL) SELECT tag_id, ancestor FROM up""",
    "a_tags",
)
def tag_ancestors(spark, sf_dir):
    return tags.ancestors(T(spark, sf_dir).a_tags)


def _edits(t: T) -> DataFrame:
    return t.a_tags.select(
        "tag_id", F.when(F.col("tag_id") == 3, " ").when(F.col("tag_id") == 4, "tag_5").otherwise(F.concat(F.col("name"), F.lit(" new"))).alias("name"), "definition",
        F.when(F.col("tag_id") == 2, 8).when(F.col("tag_id") == 1, 6).otherwise(F.col("parent_id")).cast("bigint").alias("parent_id"),
        F.lit(None).cast("string").alias("color"), F.when(F.col("tag_id") == 6, "j").when(F.col("tag_id") == 7, "xy").alias("hotkey"), F.lit(False).alias("bump"),
    )


def _full_tags(t: T) -> DataFrame:
    return t.a_tags.withColumn("color", F.lit(None).cast("string")).withColumn("hotkey", F.lit(None).cast("string"))


@query(
    """SELECT tag_id, CASE WHEN archived THEN 'archived' WHEN tag_id = 3 THEN 'empty_name' WHEN tag_id = 4 THEN 'duplicate_name' WHEN tag_id = 7 THEN 'invalid_hotkey' WHEN tag_id = 6 THEN 'reserved_hotkey'
    WHEN tag_id IN (1, 2) THEN 'invalid_parent' END AS reason FROM a_tags WHERE archived OR tag_id IN (1, 2, 3, 4, 6, 7)""",
    "a_tags",
)
def rejected_tag_edits(spark, sf_dir):
    t = T(spark, sf_dir)
    return tags.apply_tag_edits(_full_tags(t), _edits(t))[1]


@query(
    """SELECT tag_id, CASE WHEN tag_id IN (0, 5, 8) THEN concat(name, ' new') ELSE name END AS name, version FROM a_tags""", "a_tags"
)
def edited_tags(spark, sf_dir):
    t = T(spark, sf_dir)
    return tags.apply_tag_edits(_full_tags(t), _edits(t))[0].select("tag_id", "name", "version")


@query("SELECT tag_id, archived OR tag_id = 2 AS archived, CASE WHEN parent_id <> 2 THEN parent_id END AS parent_id FROM a_tags", "a_tags")
def archived_tags(spark, sf_dir):
    t = T(spark, sf_dir).a_tags
    return tags.archive(t, t.where("tag_id = 2").select("tag_id")).select("tag_id", "archived", "parent_id")


_FAILED = "count(*) FILTER (WHERE state = 'failed')"


@query(
    f"""SELECT 'documents' AS what, s.name, coalesce(n, 0) AS n, 0::BIGINT AS failed FROM (SELECT unnest(['queued', 'validated', 'auto_completed', 'skipped']) AS name) s
      LEFT JOIN (SELECT review_state, count(*) AS n FROM a_documents GROUP BY review_state) d ON d.review_state = s.name
    UNION ALL SELECT 'jobs', k.name, coalesce(n, 0), coalesce(failed, 0) FROM (SELECT unnest(['import', 'fulltext', 'drawings']) AS name) k
      LEFT JOIN (SELECT kind, count(*) FILTER (WHERE state IN ('pending', 'running')) AS n, {_FAILED} AS failed FROM a_jobs GROUP BY kind) j ON j.kind = k.name""",
    "a_documents", "a_jobs",
)
def status_summary(spark, sf_dir):
    t = T(spark, sf_dir)
    return exports.status_summary(t.a_documents, t.a_jobs)


@query(
    f"""SELECT kind, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'running') AS running, {_FAILED} AS failed FROM a_jobs GROUP BY ROLLUP (kind) UNION ALL SELECT 'search', 0, 0, 0""", "a_jobs"
)
def job_counts(spark, sf_dir):
    return exports.job_counts(T(spark, sf_dir).a_jobs, ("import", "fulltext", "drawings", "search"))


@query("SELECT id, kind, state FROM a_jobs WHERE kind = 'import' AND state IN ('pending', 'running')", "a_jobs")
def resumable_jobs(spark, sf_dir):
    return exports.jobs_in(T(spark, sf_dir).a_jobs, "import").select("id", "kind", "state")


@query(
    """SELECT j.id, j.kind, j.d AS doc_id, c.c_name AS pub_key FROM (SELECT *, CAST(json_extract_string(payload, '$.doc_id') AS BIGINT) AS d FROM a_jobs WHERE state = 'failed' ORDER BY updated_at DESC, id DESC LIMIT 200) j
    LEFT JOIN customer c ON c.c_custkey = j.d""",
    "a_jobs",
)
def job_details(spark, sf_dir):
    t = T(spark, sf_dir)
    return exports.job_details(t.a_jobs, t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("pub_key")), "failed")


@query(
    """SELECT doc_id FROM a_documents d WHERE fetch_status = 'fetched' AND EXISTS (SELECT 1 FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND state = 'pos' AND tag_id IN (1, 2))
    AND NOT EXISTS (SELECT 1 FROM a_fulltext f WHERE f.doc_id = d.doc_id AND status IN ('fetched', 'non_english_only'))""",
    "a_documents", "a_doc_labels", "a_fulltext",
)
def retrieval_candidates(spark, sf_dir):
    t = T(spark, sf_dir)
    pos = labels.label_sets(t.a_doc_labels).select("doc_id", F.col("pos").alias("tags"))
    done = t.a_fulltext.where("status IN ('fetched', 'non_english_only')")
    return automation.retrieval_candidates(t.a_documents.where("fetch_status = 'fetched'"), pos, done, "after_tagging_selected_tags", (1, 2))


@query(
    """SELECT doc_id, 'fulltext' AS kind FROM a_documents d WHERE fetch_status = 'fetched' AND EXISTS (SELECT 1 FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND state = 'pos' AND tag_id IN (1, 2))
      AND NOT EXISTS (SELECT 1 FROM a_fulltext f WHERE f.doc_id = d.doc_id AND status IN ('fetched', 'non_english_only'))
    UNION ALL SELECT doc_id, 'drawings' FROM a_documents d WHERE fetch_status = 'fetched' AND EXISTS (SELECT 1 FROM a_doc_labels l WHERE l.doc_id = d.doc_id AND state = 'pos' AND tag_id = 0)
      AND NOT EXISTS (SELECT 1 FROM a_drawings r WHERE r.doc_id = d.doc_id AND status = 'fetched')""",
    "a_documents", "a_doc_labels", "a_fulltext", "a_drawings",
)
def retrieval_jobs(spark, sf_dir):
    """Full text of documents of some tags, drawings of those of another."""
    t = T(spark, sf_dir)
    pos = labels.label_sets(t.a_doc_labels).select("doc_id", F.col("pos").alias("tags"))
    config = automation.EngineConfig(fulltext_policy="after_tagging_selected_tags", drawings_policy="after_tagging_selected_tags", fulltext_policy_tags=(1, 2), drawings_policy_tags=(0,))
    return automation.retrieval_jobs(t.a_documents.where("fetch_status = 'fetched'"), pos, t.a_fulltext, t.a_drawings, config)


@query(
    """WITH n AS (SELECT doc_id, 'fetched' AS status, 'en' AS lang FROM documents WHERE doc_id % 4 = 0)
    SELECT doc_id, status, lang FROM a_fulltext f WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""",
    "a_fulltext",
)
def upserted_fulltext(spark, sf_dir):
    t = T(spark, sf_dir)
    new = t.documents.where("doc_id % 4 = 0").select("doc_id", F.lit("fetched").alias("status"), F.lit("en").alias("lang"))
    return labels.upsert(t.a_fulltext.select("doc_id", "status", "lang"), new, ["doc_id"])


@query(
    """WITH p AS (SELECT doc_id, 1 AS page, source, CASE WHEN n_pages > 1 THEN 90 ELSE 0 END AS rotation FROM a_drawings),
    n AS (SELECT doc_id, 1 AS page, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE pub_key END AS source FROM a_documents WHERE doc_id % 2 = 0)
    SELECT doc_id, page, source, rotation FROM p WHERE doc_id NOT IN (SELECT doc_id FROM n)
    UNION ALL SELECT n.doc_id, n.page, n.source, CASE WHEN p.source = n.source THEN p.rotation ELSE 0 END FROM n LEFT JOIN p ON p.doc_id = n.doc_id""",
    "a_documents", "a_drawings",
)
def upserted_pages(spark, sf_dir):
    t = T(spark, sf_dir)
    old = t.a_drawings.select("doc_id", F.lit(1).alias("page"), "source", F.when(F.col("n_pages") > 1, 90).otherwise(0).alias("rotation"))
    new = t.a_documents.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("page"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("pub_key")).alias("source"))
    return labels.upsert_pages(old, new)
