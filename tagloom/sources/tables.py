"""Engine tables derived from the given ones, each defined once as SQL that Spark and other engines read alike.

``{name}`` stands for an input table or another derived one. ``spark_table`` binds them to
DataFrames, so a derived table is an ordinary lazy plan with pushdown to the Parquet scan;
``with_clause`` gives the same definitions as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

INPUTS = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)

TABLES: dict[str, str] = {
    "a_vectors": "SELECT vec_id AS doc_id, 'm1' AS model_id, embedding AS vector, label FROM {embeddings}",
    # ten tags, from the labels of the vectors
    "a_tags": """
        SELECT CAST(k AS BIGINT) AS tag_id, concat('tag_', CAST(k AS STRING)) AS name,
               concat('documents about ', CAST(k AS STRING)) AS definition,
               CAST(0.2 + 0.05 * k AS FLOAT) AS threshold, CAST(0.1 AS FLOAT) AS neg_threshold,
               k % 3 <> 0 AS auto_enabled, CAST(1 + k % 2 AS INT) AS version, k = 9 AS archived,
               CASE WHEN floor(k / 2) > 0 THEN CAST(floor(k / 2) AS BIGINT) END AS parent_id
        FROM (SELECT label AS k FROM {embeddings} GROUP BY label) t""",
    "a_labels": """
        SELECT e.vec_id AS doc_id, t.tag_id,
               CASE WHEN e.vec_id % 2 = 1 OR e.label = t.tag_id THEN 'pos' ELSE 'neg' END AS state,
               CASE WHEN e.vec_id % 2 = 0 THEN 'human' ELSE 'auto' END AS source, 1 AS tag_version
        FROM {embeddings} e CROSS JOIN {a_tags} t
        WHERE (e.vec_id % 2 = 0 AND (e.vec_id + t.tag_id) % 7 <> 0)
           OR (e.vec_id % 2 = 1 AND (e.vec_id + t.tag_id) % 13 = 0)""",
    "a_history": """
        SELECT event_id AS id, user_id AS doc_id,
               CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS tag_id,
               CASE WHEN event_id % 4 = 0 THEN 'human' ELSE 'auto' END AS source,
               CASE WHEN event_id % 3 = 0 THEN 'neg' ELSE 'pos' END AS state
        FROM {events}""",
    "a_predictions": """
        SELECT v.event_id AS id, v.doc_id, v.tag_id,
               CAST(0.3 * CASE WHEN e.label = v.tag_id THEN 1 ELSE 0 END + 0.7 * v.value / (v.value + 20) AS FLOAT) AS score
        FROM (SELECT event_id, (2 * event_id) % 500 AS doc_id, event_id % 10 AS tag_id, value FROM {events}) v
        JOIN {embeddings} e ON e.vec_id = v.doc_id""",
    "a_documents": """
        SELECT doc_id, concat(country, CAST(1000000 + g AS STRING)) AS pub_key, country, CAST(1000000 + g AS STRING) AS number,
               CASE WHEN doc_id % 2 = 0 THEN 'A1' ELSE 'B1' END AS kind,
               concat(country, CAST(1000000 + g AS STRING)) AS application_number,
               CASE WHEN g % 7 <> 0 THEN CAST(floor(g / 3) AS BIGINT) END AS family_id,
               CASE WHEN doc_id % 11 <> 0 THEN CAST(DATE '2010-01-01' + CAST((37 * doc_id) % 4000 AS INT) AS DATE) END AS publication_date,
               split_part(text, chr(10), 1) AS title,
               CASE WHEN doc_id % 6 <> 5 THEN text END AS abstract,
               CASE WHEN doc_id % 6 <> 5 THEN concat(country, '.', CAST(1000000 + g AS STRING), '.A1') END AS abstract_source, lang AS language, source AS applicant,
               CASE WHEN doc_id % 50 = 49 THEN 'not_found' WHEN lang = 'en' THEN 'fetched' ELSE 'no_english_abstract' END AS fetch_status,
               CASE WHEN doc_id % 10 < 4 THEN 'queued' WHEN doc_id % 10 < 8 THEN 'validated'
                    WHEN doc_id % 10 = 8 THEN 'auto_completed' ELSE 'skipped' END AS review_state
        FROM (SELECT doc_id, text, lang, source, CAST(floor(doc_id / 2) AS BIGINT) AS g,
                     CASE CAST(floor(doc_id / 2) AS BIGINT) % 5 WHEN 0 THEN 'EP' WHEN 1 THEN 'US' WHEN 2 THEN 'WO' WHEN 3 THEN 'GB' ELSE 'DE' END AS country
              FROM {documents}) d""",
    "a_number_lines": """
        SELECT doc_id AS line_no, CASE doc_id % 8
                 WHEN 0 THEN concat(country, ' ', number, ' ', kind) WHEN 1 THEN concat(country, '.', number, '.', kind)
                 WHEN 2 THEN concat(country, '/', number, kind) WHEN 3 THEN concat(' ', lower(country), number, lower(kind))
                 WHEN 4 THEN concat(country, number) WHEN 5 THEN concat('JP', number, 'A')
                 WHEN 6 THEN concat(country, '-!?') ELSE '   ' END AS input_raw
        FROM {a_documents}""",
    "a_fulltext": """
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'fetched' WHEN 1 THEN 'non_english_only' WHEN 2 THEN 'not_available' ELSE 'error' END AS status,
               CASE WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 5 = 1 THEN 'de' END AS lang,
               CASE WHEN doc_id % 5 < 2 THEN pub_key END AS source,
               CASE WHEN doc_id % 5 < 2 THEN abstract END AS description,
               CASE WHEN doc_id % 5 < 2 AND doc_id % 3 <> 0 THEN concat('1. ', title) END AS claims
        FROM {a_documents} WHERE doc_id % 5 <> 4""",
    "a_drawings": """
        SELECT doc_id, CASE (doc_id + 1) % 5 WHEN 0 THEN 'fetched' WHEN 1 THEN 'not_available' ELSE 'error' END AS status,
               pub_key AS source, doc_id % 4 AS n_pages
        FROM {a_documents} WHERE (doc_id + 1) % 5 <> 4""",
    "a_doc_labels": """
        SELECT doc_id, 0 AS tag_id, CASE WHEN quality = 1 THEN 'pos' ELSE 'neg' END AS state, 'human' AS source FROM {labels}
        UNION ALL
        SELECT doc_id, 1 AS tag_id, CASE WHEN toxic = 1 THEN 'pos' ELSE 'neg' END AS state, 'human' AS source FROM {labels}
        UNION ALL
        SELECT doc_id, 2 AS tag_id, 'pos' AS state, 'auto' AS source FROM {documents} WHERE doc_id % 3 = 0""",
    "a_candidates": """
        SELECT r.request_id, d.doc_id AS pos, concat(d.country, '.', d.number, '.', d.kind) AS docdb_id, d.country, d.application_number,
               CASE WHEN d.abstract IS NOT NULL AND d.language = 'en' THEN d.abstract END AS english, d.language,
               d.doc_id % 4 > 1 AS has_drawings, d.doc_id = r.request_id AS requested, r.request_app
        FROM (SELECT family_id, request_id, pub_key AS request_app
              FROM (SELECT family_id, min(doc_id) AS request_id FROM {a_documents} WHERE family_id IS NOT NULL GROUP BY family_id) m
              JOIN (SELECT doc_id, pub_key FROM {a_documents}) p ON p.doc_id = m.request_id) r
        JOIN {a_documents} d ON d.family_id = r.family_id""",
    "a_jobs": """
        SELECT o_orderkey AS id, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'import' WHEN '2' THEN 'fulltext' ELSE 'drawings' END AS kind,
               CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'failed' END AS state,
               concat('{{"doc_id": ', CAST(o_custkey AS STRING), '}}') AS payload, o_orderdate AS updated_at
        FROM {orders} WHERE substring(o_orderpriority, 1, 1) IN ('1', '2', '3')""",
    "a_highlights": """
        SELECT doc_id AS id, doc_id, 'description' AS section, 10 AS start, 30 AS stop,
               -- the 20 characters of the text that are marked: a shorter text has none
               substring(text, 11, 20) AS quote,
               CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat('A new first line.', chr(10), text)
                    ELSE replace(text, substring(text, 11, 20), '') END AS text
        FROM {documents} WHERE length(text) >= 30""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def needs(*names: str) -> list[str]:
    """The derived tables that ``names`` build on and themselves, in order of definition."""
    found: list[str] = []

    def add(name: str) -> None:
        if name in TABLES and name not in found:
            for other in _NAME.findall(TABLES[name]):
                add(other)
            found.append(name)

    for name in names:
        add(name)
    return found


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in INPUTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TABLES[name]
    return spark.sql(text, **{n: spark_table(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def with_clause(body: str, *names: str) -> str:
    """SQL of ``body`` with the derived tables it needs as common table expressions."""
    parts = [f"{n} AS ({_NAME.sub(lambda m: m.group(1), TABLES[n]).replace('{{', '{').replace('}}', '}')})" for n in needs(*names)]
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if body.upper().startswith("WITH "):
        body = body[len("WITH RECURSIVE ") if recursive else len("WITH ") :]
        return f"WITH {'RECURSIVE ' * recursive}{', '.join([*parts, body])}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
