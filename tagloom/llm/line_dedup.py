"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog, exact near the threshold.

A line's key is the hash of its text with white space at both ends removed. Per
key, a HyperLogLog sketch of the sites (``source``) that hold it is built by
aggregation: sketches of the tasks merge, so a line that is in a third of all
rows costs one small sketch per task. Keys whose estimate is clearly over the
threshold are cross-site; keys within ``margin`` of it get an exact distinct
count; the rest stay. Lines with a cross-site key are removed everywhere. A second
sketch counts the different texts that hold the line, and has to reach the same
number: what spreads only because one document was copied whole is the business
of document deduplication, and its copies must not all lose their text here.

Only DataFrame functions run here: no Python on the executors.

Edge cases: blank lines are never counted or removed. A null source is no site.
A null text stays null and an empty one empty. A document may lose all its lines
and is then empty. Rows are told apart by doc_id and text together, so repeated
rows lose the same lines each and rows with a null doc_id are handled like all
others. A threshold is compared with "or more", so ties stay out. A very
long text is exploded into its lines like any other, and its cuts are one row. Empty tables give empty results.
Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick

MIN_SITES = 10
LG_K = 11


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, r"^[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]+$", ""))


def _lines(docs: DataFrame) -> DataFrame:
    """source, hash of the text, and key of every line that isn't blank."""
    blank = r"^[ \t\r\x0b\x0c]*$"
    return (
        docs.select("source", F.xxhash64("text").alias("t"), F.explode(F.split("text", "\n")).alias("line"))
        .where(~F.col("line").rlike(blank))
        .select("source", "t", _line_hash(F.col("line")).alias("h"))
    )


def cross_site_lines(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = 0.15) -> DataFrame:
    """h, n_rows, sites, texts, exact: keys of lines that ``min_sites`` or more sites hold, in as many different texts."""
    rows = _lines(pick(docs, "text", "source"))
    spread = (
        rows.groupBy("h")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.hll_sketch_agg("source", F.lit(LG_K)).alias("by_site"),
            F.hll_sketch_agg("t", F.lit(LG_K)).alias("by_text"),
        )
        # a line that is in fewer rows than sites asked for can't reach them
        .where(F.col("n_rows") >= min_sites)
        .select(
            "h", "n_rows", F.hll_sketch_estimate("by_site").alias("sites"), F.hll_sketch_estimate("by_text").alias("texts")
        )
    )
    low, high = min_sites * (1 - margin) - 1, min_sites * (1 + margin) + 1
    least = F.least("sites", "texts")
    ws = Workspace(docs.sparkSession, "line-spread")
    spread = ws.keep(spread.where(least >= low), "spread")
    near = spread.where(least <= high).select("h", "n_rows")
    exact = (
        rows.join(near.select("h"), "h", "left_semi")
        .groupBy("h")
        .agg(F.countDistinct("source").alias("sites"), F.countDistinct("t").alias("texts"))
        .where(least >= min_sites)
    )
    counted = near.join(exact, "h").withColumn("exact", F.lit(True))
    clear = spread.where(least > high).withColumn("exact", F.lit(False))
    return ws.result(clear.unionByName(counted))


def remove_cross_site_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The columns of documents plus n_lines and n_removed; text without cross-site lines.

    n_chars becomes the length of the new text where lines were removed.
    """
    base = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    found = cross_site_lines(docs, min_sites).select("h")
    key = F.xxhash64("doc_id", "text")
    keyed = base.select(key.alias("k"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "k", "pos", _line_hash(F.col("line")).alias("h")
    )
    # positions, not texts, go through this shuffle; repeated rows give the same positions twice
    cuts = keyed.join(found, "h", "left_semi").groupBy("k").agg(F.collect_set("pos").alias("cut"))
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda line, i: ~F.array_contains(F.col("cut"), i))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return (
        base.withColumn("k", key)
        .join(cuts, "k", "left")
        .select(
            "doc_id",
            text.alias("text"),
            "lang",
            "source",
            F.when(F.col("cut").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("bigint").alias("n_chars"),
            F.coalesce(F.size(parts), F.lit(0)).cast("bigint").alias("n_lines"),
            F.coalesce(F.size("cut"), F.lit(0)).cast("bigint").alias("n_removed"),
        )
    )
