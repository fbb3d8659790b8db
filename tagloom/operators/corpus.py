"""Corpus side: import lists, families, cascades, searches, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept


def dedupe_numbers(parsed: DataFrame, documents: DataFrame) -> DataFrame:
    """Add result: imported, duplicate (of an earlier line or a known document), or the parse outcome."""
    first = F.row_number().over(Window.partitionBy("pub_key").orderBy("line_no"))
    known = documents.select("pub_key", F.lit(True).alias("known")).distinct()
    good = parsed.where("outcome = 'parsed'").withColumn("rn", first).join(known, "pub_key", "left")
    good = good.withColumn("result", F.when((F.col("rn") > 1) | F.col("known").isNotNull(), "duplicate").otherwise("imported"))
    rest = parsed.where("outcome <> 'parsed'").withColumn("result", F.col("outcome"))
    return good.select(*parsed.columns, "result").unionByName(rest)


def import_report(results: DataFrame) -> DataFrame:
    """result, n: counts per outcome; the lines themselves are the rows of ``results``."""
    return results.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def import_outcomes(outcomes: DataFrame, completed: DataFrame, audited: DataFrame) -> DataFrame:
    """fetched, auto_completed, audited_samples, errors (also those not found) of an import: one row.

    ``outcomes`` has doc_id, fetch_status; ``completed`` and ``audited`` are those of the pass after it (``full_automation``).
    """
    counts = outcomes.agg(F.count_if(F.col("fetch_status") == "fetched").alias("fetched"), F.count_if(F.col("fetch_status").isin("error", "not_found")).alias("errors"))
    done = completed.agg(F.count(F.lit(1)).alias("auto_completed"))
    return counts.join(done).join(audited.agg(F.count(F.lit(1)).alias("audited_samples"))).select("fetched", "auto_completed", "audited_samples", "errors")


def add_pending(documents: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, pub_key of documents to insert: unknown keys, ids after the greatest one by (batch, line) order.

    Ids come from offsets per range of the order, so no task numbers all rows; the ranges are written first, as
    both the offsets and the numbers within them depend on them.
    """
    fresh = new.join(documents.select("pub_key"), "pub_key", "left_anti").groupBy("pub_key").agg(F.min("line_no").alias("line_no"))
    ranged = kept(fresh.repartitionByRange("line_no", "pub_key").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    bases = sizes.select("part", before.alias("base"))
    last = documents.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("last"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("line_no", "pub_key"))
    return (
        ranged.withColumn("rn", inside)
        .join(F.broadcast(bases), "part")
        .join(F.broadcast(last))
        .select((F.col("last") + F.col("base") + F.col("rn")).alias("doc_id"), "pub_key", F.lit("pending").alias("fetch_status"))
    )


def fetch_outcome(selected: DataFrame, failures: DataFrame) -> DataFrame:
    """doc_id, fetch_status: fetched iff an abstract was chosen; a failure of 404 is not_found, another one error."""
    f = failures.select("doc_id", F.col("code").alias("fail"))
    status = (
        F.when(F.col("fail") == 404, "not_found").when(F.col("fail").isNotNull(), "error").when(F.col("abstract").isNotNull(), "fetched").otherwise("no_english_abstract")
    )
    return selected.join(f, "doc_id", "full").select("doc_id", status.alias("fetch_status"))


def related_documents(documents: DataFrame) -> DataFrame:
    """doc_id, related_id, via: other documents of the same application or family (two equi joins, not an OR)."""

    def by(key: str) -> DataFrame:
        own = documents.where(F.col(key).isNotNull()).select("doc_id", F.col(key).alias("k"))
        other = own.select(F.col("doc_id").alias("related_id"), "k")
        return own.join(other, "k").where("doc_id <> related_id").select("doc_id", "related_id", F.lit(key).alias("via"))

    both = by("application_number").unionByName(by("family_id"))
    return both.groupBy("doc_id", "related_id").agg(F.array_sort(F.collect_set("via")).alias("via"))


def country_rank(country: Column) -> Column:
    """WO, US, GB, EP, then others."""
    return F.when(country == "WO", 0).when(country == "US", 1).when(country == "GB", 2).when(country == "EP", 3).otherwise(4)


def one_per_family(hits: DataFrame) -> DataFrame:
    """The best hit of each family, with the order of the family's first appearance.

    ``hits`` has pos, pub_key, family_id, publication_date, english. English abstract first, then dated, then
    oldest, then input order; without a family the key stands for one.
    """
    group = F.coalesce(F.concat(F.lit("fam:"), F.col("family_id").cast("string")), F.concat(F.lit("pub:"), F.col("pub_key")))
    rank = F.struct((~F.col("english")).alias("a"), F.col("publication_date").isNull().alias("b"), F.coalesce("publication_date", F.lit("9999-12-31").cast("date")).alias("c"), "pos")
    return hits.groupBy(group.alias("family")).agg(F.min_by(F.struct("pos", "pub_key", "publication_date"), rank).alias("s"), F.min("pos").alias("first_pos")).select(
        "family", "first_pos", "s.pos", "s.pub_key", "s.publication_date"
    )


def split_known(chosen: DataFrame, documents: DataFrame) -> DataFrame:
    """Add known_as: family (its family is there), duplicate (its key is), or new."""
    fam = documents.where("family_id IS NOT NULL").select("family_id", F.lit(True).alias("f")).distinct()
    key = documents.select("pub_key", F.lit(True).alias("k")).distinct()
    joined = chosen.join(fam, "family_id", "left").join(key, "pub_key", "left")
    return joined.withColumn("known_as", F.when(F.col("k"), "duplicate").when(F.col("f"), "family").otherwise("new")).drop("f", "k")


def batch_report(page: DataFrame, chosen: DataFrame) -> DataFrame:
    """scanned, families, known_families, duplicates, imported of one batch of hits."""
    parts = chosen.agg(
        F.count(F.lit(1)).alias("families"),
        F.count_if(F.col("known_as") == "family").alias("known_families"),
        F.count_if(F.col("known_as") == "duplicate").alias("duplicates"),
        F.count_if(F.col("known_as") == "new").alias("imported"),
    )
    return page.agg(F.count(F.lit(1)).alias("scanned")).join(parts)


def _tier() -> Column:
    return F.when(F.col("requested"), 1).when(F.col("application_number").eqNullSafe(F.col("request_app")), 2).otherwise(3)


def _order() -> Column:
    """Tier, then country for the family tier only, then input order."""
    return F.struct(_tier().alias("tier"), F.when(_tier() == 3, country_rank(F.col("country"))).otherwise(0).alias("rank"), "pos")


def select_text(candidates: DataFrame, field: str = "english") -> DataFrame:
    """request_id, text, source_docdb_id: requested publication, else same application, else family by country."""
    some = candidates.where(F.col(field).isNotNull())
    return some.groupBy("request_id").agg(F.min_by(F.struct(F.col(field).alias("text"), "docdb_id"), _order()).alias("s")).select(
        "request_id", "s.text", F.col("s.docdb_id").alias("source_docdb_id")
    )


def select_fulltext(candidates: DataFrame) -> DataFrame:
    """request_id, source, lang, non_english_only: English by tier, else any language by tier."""
    some = candidates.where("language IS NOT NULL")
    order = F.struct((F.lower("language") != "en").alias("other"), _order().alias("o"), "language")
    return some.groupBy("request_id").agg(F.min_by(F.struct("docdb_id", "language"), order).alias("s")).select(
        "request_id", F.col("s.docdb_id").alias("source"), F.col("s.language").alias("lang"), (F.lower("s.language") != "en").alias("non_english_only")
    )


def select_drawings(candidates: DataFrame) -> DataFrame:
    return candidates.where("has_drawings").groupBy("request_id").agg(F.min_by("docdb_id", _order()).alias("source"))


def candidate_set(siblings: DataFrame, family: DataFrame) -> DataFrame:
    """request_id, docdb_id, tier, pos: union of both without the requested one; a candidate keeps its lowest tier."""
    both = siblings.withColumn("tier", F.lit(2)).unionByName(family.withColumn("tier", F.lit(3)))
    best = both.where("NOT requested").groupBy("request_id", "docdb_id").agg(F.min(F.struct("tier", "pos")).alias("s"))
    return best.select("request_id", "docdb_id", "s.tier", "s.pos")


def needs_family(candidates: DataFrame) -> DataFrame:
    """request_id of requests for which neither the publication nor its application has English text."""
    near = candidates.where((_tier() < 3) & F.col("english").isNotNull()).select("request_id")
    return candidates.select("request_id").distinct().join(near, "request_id", "left_anti")


def kind_codes(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("request_id").agg(F.array_sort(F.collect_set(F.split_part("docdb_id", F.lit("."), F.lit(3)))).alias("kinds"))


def applicant_search(
    pubs: DataFrame, applicant: str, country: str | None = None, year_from: int | None = None, year_to: int | None = None
) -> DataFrame:
    """Publications of an applicant, by any of the name variants between semicolons."""
    names = [" ".join(n.replace('"', "").replace("\\", "").split()) for n in applicant.split(";")]
    names = [n.upper() for n in names if n]
    if not names:
        raise ValueError("an applicant name is needed")
    if country is not None and not (len(country.strip()) == 2 and country.strip().isalpha()):
        raise ValueError("a country has two letters")
    for y in (year_from, year_to):
        if y is not None and not 1000 <= y <= 9999:
            raise ValueError("a year has four digits")
    if year_from is not None and year_to is not None and year_from > year_to:
        raise ValueError("the years are in the wrong order")
    hit = F.lit(False)
    for n in names:
        hit = hit | F.upper("applicant").contains(n)
    out = pubs.where(hit)
    if country:
        out = out.where(F.col("country") == country.strip().upper())
    if year_from is not None:
        out = out.where(F.col("publication_date") >= F.lit(f"{year_from}-01-01").cast("date"))
    if year_to is not None:
        out = out.where(F.col("publication_date") <= F.lit(f"{year_to}-12-31").cast("date"))
    return out


def search_batch(hits: DataFrame, state: DataFrame, page: int = 100, cap: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(rows of the next batch, new state) of many searches at once.

    ``hits`` has search, publication_date, docdb_id; ``state`` search and next_start (from 1). Only the first ``cap``
    hits can be read, so ranking keeps ``cap`` rows per search and task.
    """
    newest = Window.partitionBy("search").orderBy(F.desc_nulls_last("publication_date"), "docdb_id")
    ranked = hits.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= cap).join(state, "search")
    rows = ranked.where((F.col("rank") >= F.col("next_start")) & (F.col("rank") < F.col("next_start") + page)).drop("next_start")
    totals = hits.groupBy("search").agg(F.count(F.lit(1)).alias("total"))
    start = F.least(F.col("next_start") + page, F.least(F.col("total"), F.lit(cap)) + 1)
    new = (
        state.join(totals, "search", "left")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("next_start", F.greatest(F.col("next_start"), start))
        .withColumn("exhausted", F.col("next_start") > F.least(F.col("total"), F.lit(cap)))
        .withColumn("results_read", F.least(F.col("next_start") - 1, F.col("total")))
        .withColumn("capped", F.col("total") > cap)
    )
    return rows, new


def restart_search(state: DataFrame, searches: DataFrame) -> DataFrame:
    again = searches.select("search", F.lit(1).cast("bigint").alias("one"))
    return state.join(again, "search", "left").withColumn("next_start", F.coalesce("one", "next_start")).drop("one")


def delete_searches(state: DataFrame, searches: DataFrame) -> DataFrame:
    """The saved searches without the given ones; what they imported stays."""
    return state.join(searches.select("search"), "search", "left_anti")


def list_searches(state: DataFrame) -> DataFrame:
    """Saved searches by name, case ignored."""
    return state.orderBy(F.lower("search"), "search")
