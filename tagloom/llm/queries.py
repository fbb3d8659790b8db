"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import overlaps
from .html_text import extract_text
from .language_id import identify_languages
from .line_dedup import MIN_SITES, remove_cross_site_lines
from .merkle import manifest
from .near_dedup import near_duplicates
from .packing import pack
from .quality_rules import quality_rules
from .resampling import resample
from .secret_scan import scan_secrets
from .sharding import shard_by_bytes
from .warc import MIN_BYTES, archive_pages
from .whitening import whiten


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("k")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=85, bands=30, rows=6)


def vocabulary_path() -> str:
    """The tokenizer file of the registered packing query; a parameter of the operator."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_cross_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_cross_site_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_chars", "n_lines", "n_removed"
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).drop("size")


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


OP10_SQL = rf"""
WITH parts AS (
  SELECT doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
         unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT doc_id, source, text, pos, line,
         trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k
  FROM parts
), spread AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k
  HAVING count(DISTINCT source) >= {MIN_SITES} AND count(DISTINCT text) >= {MIN_SITES}
), kept AS (
  SELECT doc_id,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM spread)) AS text,
         count(*) AS n_lines,
         count(*) FILTER (WHERE k IN (SELECT k FROM spread)) AS n_removed
  FROM keyed GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CASE WHEN n_removed > 0 THEN length(coalesce(kept.text, '')) ELSE d.n_chars END AS n_chars,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


# crc32 a bit at a time: -1 stands for a shift
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""


def _encoded(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIDES = """
  SELECT a.g, a.lvl, a.rank, coalesce(string_agg(b.h, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS r
  FROM {0} a JOIN {0} b ON a.g = b.g AND a.lvl = b.lvl AND a.rank // 8 = b.rank // 8
  WHERE a.n > 1 GROUP BY a.g, a.lvl, a.rank"""
_NODES = """
  SELECT g, 0 AS lvl, rank, h, n FROM {0}
  UNION ALL
  SELECT g, lvl + 1, rank // 8, sha256(string_agg(h, '' ORDER BY rank)), (n + 7) // 8 FROM {1} WHERE n > 1 GROUP BY g, lvl, rank // 8, n"""
_FOLDED = """
  SELECT doc_id, leaf, g, 0 AS lvl, rank, h, proof FROM {0}
  UNION ALL
  SELECT f.doc_id, f.leaf, f.g, f.lvl + 1, f.rank // 8, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM {1} f JOIN {2} s ON f.g = s.g AND f.lvl = s.lvl AND f.rank = s.rank"""
OP12_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, sha256({_encoded("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
         CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0
              THEN sha256({_encoded("doc_id", "source", "lang", "n_chars")} || coalesce(strlen({_LOWERED}) || ':' || {_LOWERED}, '-')) END AS other,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM documents
), leaves AS (
  SELECT *, coalesce(other, leaf) AS changed, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY g) AS n
  FROM hashed
), low AS ({_NODES.format("leaves", "low")}
), low_sides AS ({_SIDES.format("low")}
), subroots AS (
  SELECT 0 AS g, g AS rank, h, count(*) OVER () AS n FROM low WHERE n = 1
), top AS ({_NODES.format("subroots", "top")}
), top_sides AS ({_SIDES.format("top")}
), started AS (SELECT doc_id, leaf, g, rank, changed AS h, '' AS proof FROM leaves
), folded AS ({_FOLDED.format("started", "folded", "low_sides")}
), arrived AS (
  SELECT f.doc_id, f.leaf, 0 AS g, f.g AS rank, f.h, f.proof, f.g AS lang_rank
  FROM folded f JOIN (SELECT g, max(lvl) AS height FROM low GROUP BY g) t ON f.g = t.g AND f.lvl = t.height
), finished AS ({_FOLDED.format("arrived", "finished", "top_sides")}
), root AS (SELECT h AS root, lvl AS height FROM top WHERE n = 1)
SELECT f.doc_id, f.leaf, s.h AS subroot, root.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM finished f JOIN root ON f.lvl = root.height
JOIN arrived a ON a.doc_id IS NOT DISTINCT FROM f.doc_id AND a.leaf = f.leaf
JOIN subroots s ON s.rank = a.lang_rank
"""

OP13_SQL = f"""
WITH payload AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), grouped AS (SELECT *, CASE WHEN n >= {MIN_BYTES} THEN min(page_id) OVER (PARTITION BY digest) END AS f FROM payload)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to
FROM grouped
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_benchmark_overlaps": op2_benchmark_overlaps,
        "op3_main_text": op3_main_text,
        "op4_importance_sample": op4_importance_sample,
        "op5_language_id": op5_language_id,
        "op6_quality_rules": op6_quality_rules,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_retrieval_packing": op8_retrieval_packing,
        "op9_balanced_shards": op9_balanced_shards,
        "op10_cross_site_lines": op10_cross_site_lines,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_warc_archives": op13_warc_archives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_cross_site_lines": OP10_SQL, "op12_merkle_manifest": OP12_SQL, "op13_warc_archives": OP13_SQL}
