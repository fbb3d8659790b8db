"""Export rows, document text, layouts and writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_folder_name
from ..sources.formats import write_text_files
from .kept import kept
from .outline import SECTIONS

# fixed values: the folder of untagged documents, and the wording of the document text below
UNTAGGED = "_untagged"


_HIGHLIGHTS = "array<struct<place:int,start:int,id:bigint,section:string,quote:string,comment:string,color:string>>"


def export_rows(documents: DataFrame, labels: DataFrame, tags: DataFrame, highlights: DataFrame | None = None) -> DataFrame:
    """doc_id, publication_number, title, tags (sorted names of positive labels), sources, highlights of fetched documents.

    ``highlights`` has id, doc_id, section, start, quote, comment, color; they come in the order of the text.
    """
    pos = labels.where("state = 'pos'").join(tags.select("tag_id", "name"), "tag_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    source = F.when(F.col("abstract_source").isNotNull(), F.array(F.concat(F.lit("abstract "), F.col("abstract_source")))).otherwise(F.array().cast("array<string>"))
    rows = documents.where("fetch_status = 'fetched'").join(pos, "doc_id", "left")
    none = F.array().cast(_HIGHLIGHTS)
    if highlights is None:
        rows = rows.withColumn("marks", none)
    else:
        place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int").alias("place")
        each = F.struct(place, "start", F.col("id").cast("bigint").alias("id"), "section", "quote", "comment", "color")
        rows = rows.join(highlights.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).cast(_HIGHLIGHTS).alias("marks")), "doc_id", "left")
    return rows.select(
        "doc_id", F.col("pub_key").alias("publication_number"), "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), source.alias("sources"),
        F.transform(F.coalesce("marks", none), lambda m: F.struct(m["section"].alias("section"), m["quote"].alias("quote"), m["comment"].alias("comment"), m["color"].alias("color"))).alias("highlights"),
    )


def _csv(c: Column) -> Column:
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def to_csv_lines(rows: DataFrame) -> DataFrame:
    """doc_id, line: the CSV line of each export row."""
    cells = [F.col("publication_number"), F.coalesce("title", F.lit("")), F.array_join("tags", "; "), F.array_join("sources", "; ")]
    return rows.select("doc_id", F.concat_ws(",", *[_csv(c) for c in cells]).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    flat = rows.select("publication_number", F.coalesce("title", F.lit("")).alias("title"), F.array_join("tags", "; ").alias("tags"), F.array_join("sources", "; ").alias("sources"))
    flat.write.csv(path, header=True, escape='"', emptyValue="")


def write_json(rows: DataFrame, path: str) -> None:
    rows.drop("doc_id").write.json(path)


def one_tag(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.array_contains("tags", name))


def tag_lists(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """tag_id, pub_key of positive labels; one row each, so that no tag's list is one group."""
    return labels.where("state = 'pos'").join(documents.select("doc_id", "pub_key"), "doc_id").select("tag_id", "pub_key").distinct()


def write_tag_lists(lists: DataFrame, path: str) -> None:
    lists.repartitionByRange("tag_id", "pub_key").sortWithinPartitions("tag_id", "pub_key").write.partitionBy("tag_id").text(path)


def _part(status: Column, lang: Column, text: Column, label: str) -> Column:
    head = F.when(status == "non_english_only", F.concat(F.lit("[Non-English text, language: "), F.coalesce(lang, F.lit("unknown")), F.lit("]\n"))).otherwise("")
    return (
        F.when(status == "not_available", "Full text not available in OPS.\n")
        .when(status == "error", "Full text retrieval failed.\n")
        .when(status.isin("fetched", "non_english_only") & text.isNotNull(), F.concat(head, text, F.lit("\n")))
        .when(status.isin("fetched", "non_english_only"), f"{label} not available for this publication.\n")
        .otherwise(f"{label} not retrieved.\n")
    )


def highlight_lines() -> Column:
    """Text of one highlight: its place and quote, then the indented comment."""
    quote = F.trim(F.regexp_replace("quote", r"\s+", " "))
    state = F.when(F.col("detached"), ", passage no longer in the text").otherwise("")
    comment = F.when(
        F.col("comment").isNotNull(),
        F.concat(
            F.array_join(
                F.transform(F.split("comment", "\r?\n"), lambda x, i: F.concat(F.when(i == 0, "  Comment: ").otherwise("           "), F.rtrim(x))), "\n"
            ),
            F.lit("\n"),
        ),
    ).otherwise("")
    return F.concat(F.col("location"), F.lit(" ("), F.col("color"), state, F.lit('): "'), quote, F.lit('"\n'), comment)


def render_documents(docs: DataFrame, fulltext: DataFrame, drawings: DataFrame, highlights: DataFrame | None = None) -> DataFrame:
    """doc_id, pub_key, text.

    ``docs`` has doc_id, pub_key, kinds, title, applicants, publication_date, cpc, tags, abstract_source, abstract;
    ``fulltext`` status, lang, source, description, claims; ``drawings`` status, source, paths; ``highlights``
    doc_id, n, location, color, detached, quote, comment.
    """
    ft = fulltext.select("doc_id", F.col("status").alias("f_status"), F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "description", "claims")
    dr = drawings.select("doc_id", F.col("status").alias("d_status"), F.col("source").alias("d_source"), "paths")
    rows = docs.join(ft, "doc_id", "left").join(dr, "doc_id", "left")
    if highlights is not None:
        each = highlights.select("doc_id", "n", highlight_lines().alias("t"))
        own = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("h"))
        rows = rows.join(own.select("doc_id", F.array_join("h.t", "").alias("marks")), "doc_id", "left")
    else:
        rows = rows.withColumn("marks", F.lit(None).cast("string"))

    def listed(c: str, sep: str, none: str) -> Column:
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, sep)).otherwise(none)

    def named(c: str, word: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(word), F.col(c)))

    sources = F.concat_ws("; ", named("abstract_source", "abstract "), named("f_source", "full text "), named("d_source", "drawings "))
    kinds = F.when(F.coalesce(F.size("kinds"), F.lit(0)) > 0, F.concat(F.lit(" ("), F.array_join("kinds", ", "), F.lit(")"))).otherwise("")
    status = F.coalesce("d_status", F.lit(""))
    pages = (
        F.when((status == "fetched") & (F.coalesce(F.size("paths"), F.lit(0)) > 0), F.concat(F.array_join("paths", "\n"), F.lit("\n")))
        .when(status == "not_available", "This publication has no drawings.\n")
        .when(status == "error", "Drawings retrieval failed.\n")
        .otherwise("Drawings not retrieved.\n")
    )
    na = F.lit("Not available")
    f_status = F.coalesce("f_status", F.lit(""))
    text = F.concat(
        F.lit("Publication: "), F.col("pub_key"), kinds,
        F.lit("\nTitle: "), F.coalesce("title", na),
        F.lit("\nApplicants: "), listed("applicants", "; ", "Not available"),
        F.lit("\nPublication date: "), F.coalesce(F.col("publication_date").cast("string"), na),
        F.lit("\nCPC: "), listed("cpc", ", ", "Not available"),
        F.lit("\nTags: "), listed("tags", "; ", "None"),
        F.lit("\nSources: "), F.when(sources == "", "None").otherwise(sources),
        F.lit("\n\n===== ABSTRACT =====\n"), F.coalesce("abstract", na),
        F.lit("\n===== DESCRIPTION =====\n"), _part(f_status, F.col("f_lang"), F.col("description"), "Description"),
        F.lit("===== CLAIMS =====\n"), _part(f_status, F.col("f_lang"), F.col("claims"), "Claims"),
        F.lit("===== DRAWINGS =====\n"), pages,
        F.when(F.col("marks").isNotNull(), F.concat(F.lit("===== HIGHLIGHTS =====\n"), F.col("marks"))).otherwise(""),
    )
    return rows.select("doc_id", "pub_key", text.alias("text"))


_NUMBERED = r"(?s)^(.*) \(([2-9]|[1-9]\d{1,8})\)$"


def _running(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the sum of ``one`` over the rows of the same key up to each row, from ranges of the order: no task holds a whole key."""
    ranged = kept(rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("key", "part").agg(F.sum("one").alias("ones"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key in each range
    bases = sizes.select("key", "part", F.coalesce(F.sum("ones").over(before), F.lit(0)).alias("sum_before"))
    inside = F.sum("one").over(Window.partitionBy("key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, inside).join(bases, ["key", "part"]).withColumn(name, F.col("sum_before") + F.col(name)).drop("part", "sum_before")


def _meet_numbers(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Which bases like ``x (2)`` lose their own name to the numbering of ``x``; from what number on each of the others shifts it."""
    blocked, lost, gap = 0, [], []
    own = pdf.sort_values("n")
    for n, m, shift in zip(own["n"], own["m"], own["shift"], strict=True):
        lost.append(bool(m >= n - blocked - shift))
        blocked += not lost[-1]
        gap.append(n - blocked)
    return pd.DataFrame({"parent": own["parent"], "child": own["child"], "lost": lost, "gap": gap})


def tag_folder_names(tags: DataFrame) -> DataFrame:
    """tag_id, folder: names unique without regard to case, in the order of ids; those that clash are numbered (2), (3)…

    A tag's number is its rank among those of its name. Where a name is itself like a number of another one (``x (2)`` beside
    ``x``), the number is the other's if that comes to it before the first tag so named, and is skipped else: a row for each such name tells
    which. These names go by levels, as many as numbers follow each other in a name.
    """
    base = safe_folder_name(F.col("name"))
    named = tags.select(F.lower(base).alias("key"), F.col("tag_id").cast("bigint").alias("tag_id"), base.alias("base"))
    keys = named.groupBy("key").agg(F.min("tag_id").alias("tag_id"))
    numbers = keys.select(
        F.col("key").alias("child"), "tag_id", F.regexp_extract("key", _NUMBERED, 1).alias("key"), F.regexp_extract("key", _NUMBERED, 2).alias("n")
    ).where("n <> ''")
    links = kept(numbers.join(keys.select("key"), "key", "left_semi").select("key", "tag_id", F.col("n").try_cast("bigint").alias("n"), "child"))
    asked = named.select("key", "tag_id", "base", F.lit(1).alias("one"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("bigint").alias("n"))
    met = links.select("key", "tag_id", F.lit(None).cast("string").alias("base"), F.lit(0).alias("one"), "child", "n")
    ranks = _running(asked.unionByName(met), ["tag_id", "base"], "rank")
    place = F.col("rank") + (F.col("key") == UNTAGGED).cast("int")
    if links.isEmpty():
        return ranks.select("tag_id", _numbered(place).alias("folder"))
    ranks = kept(ranks)
    known = ranks.where("child IS NOT NULL").select(F.col("key").alias("parent"), "child", "n", F.col("rank").alias("m"))
    level, found = known.join(links.select(F.col("child").alias("parent")), "parent", "left_anti").withColumn("lost", F.lit(False)), None
    while not level.isEmpty():
        shift = (F.col("lost") | (F.col("parent") == UNTAGGED)).cast("int").alias("shift")
        now = level.select("parent", "child", "n", "m", shift).groupBy("parent").applyInPandas(_meet_numbers, "parent string, child string, lost boolean, gap bigint")
        now = kept(now)
        found = now if found is None else found.unionByName(now)
        level = known.join(now.select(F.col("child").alias("parent"), "lost"), "parent")
    lost = found.where("lost").select(F.col("child").alias("key"), F.lit(1).alias("lost"))
    places = ranks.where("one = 1").join(lost, "key", "left").select("key", (place + F.coalesce("lost", F.lit(0))).alias("place"), F.lit(0).alias("one"), "tag_id", "base")
    none = F.lit(None)
    skipped = found.where("NOT lost").select(F.col("parent").alias("key"), F.col("gap").alias("place"), F.lit(1).alias("one"), none.cast("bigint").alias("tag_id"), none.cast("string").alias("base"))
    # a skipped number counts for the places after its gap
    counted = _running(places.unionByName(skipped), ["place", "one"], "skips").where("one = 0")
    return counted.select("tag_id", _numbered(F.col("place") + F.col("skips")).alias("folder"))


def _numbered(number: Column) -> Column:
    return F.when(number == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), number.cast("string"), F.lit(")")))


def document_layout(docs: DataFrame, labels: DataFrame, tags: DataFrame) -> DataFrame:
    """folder, doc_id, pub_key: once per active positive tag, else under the untagged folder."""
    folders = tag_folder_names(tags.where("NOT archived"))
    own = labels.where("state = 'pos'").join(folders, "tag_id").select("doc_id", "folder").distinct()
    return docs.select("doc_id", "pub_key").join(own, "doc_id", "left").select(F.coalesce("folder", F.lit(UNTAGGED)).alias("folder"), "doc_id", "pub_key")


def layout_files(layout: DataFrame, texts: DataFrame) -> DataFrame:
    """path (folder/pub_key/pub_key.txt), text of every document in every folder that it is in."""
    path = F.concat_ws("/", "folder", "pub_key", F.concat("pub_key", F.lit(".txt")))
    return layout.join(texts.select("doc_id", "text"), "doc_id").select(path.alias("path"), "text")


def write_layout(layout: DataFrame, texts: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write the tree of documents, all of it or nothing."""
    write_text_files(layout_files(layout, texts), path, overwrite)


def status_summary(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """what, name, n, failed: documents per review state, and jobs per kind (waiting or running; failed); zeros kept."""
    spark = documents.sparkSession
    states = spark.createDataFrame([(s,) for s in ("queued", "validated", "auto_completed", "skipped")], "name string")
    kinds = spark.createDataFrame([(k,) for k in ("import", "fulltext", "drawings")], "name string")
    by_state = documents.groupBy(F.col("review_state").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_kind = jobs.groupBy(F.col("kind").alias("name")).agg(
        F.count_if(F.col("state").isin("pending", "running")).alias("n"), F.count_if(F.col("state") == "failed").alias("failed")
    )
    zero = F.lit(0).cast("bigint")
    a = states.join(by_state, "name", "left").select(F.lit("documents").alias("what"), "name", F.coalesce("n", zero).alias("n"), zero.alias("failed"))
    b = kinds.join(by_kind, "name", "left").select(F.lit("jobs").alias("what"), "name", F.coalesce("n", zero).alias("n"), F.coalesce("failed", zero).alias("failed"))
    return a.unionByName(b)


def export_tag_scheme(tags: DataFrame) -> DataFrame:
    """name, definition, parent (name of an active one) of active tags, without learned state."""
    active = tags.where("NOT archived")
    parent = active.select(F.col("tag_id").alias("pid"), F.col("name").alias("parent"))
    return active.join(parent, F.col("parent_id") == F.col("pid"), "left").select("name", "definition", "parent", "color", "hotkey").orderBy("name")


JOB_KINDS = ("import", "fulltext", "drawings")


def job_counts(jobs: DataFrame, kinds: tuple[str, ...] = JOB_KINDS) -> DataFrame:
    """kind, pending, running, failed of each of the kinds, zeros kept, with a total row (kind null)."""
    states = ("pending", "running", "failed")
    asked = jobs.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counts = jobs.where(F.col("kind").isin(*kinds)).groupBy("kind").agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))
    rows = asked.join(counts, "kind", "left").select("kind", *(F.coalesce(s, F.lit(0)).alias(s) for s in states))
    return rows.rollup("kind").agg(*(F.sum(s).alias(s) for s in states))


def jobs_in(jobs: DataFrame, kind: str, states: tuple[str, ...] = ("pending", "running")) -> DataFrame:
    return jobs.where((F.col("kind") == kind) & F.col("state").isin(*states)).orderBy("id")


def job_details(jobs: DataFrame, documents: DataFrame, state: str, limit: int = 200) -> DataFrame:
    """Jobs of a state with their document's key, newest first. ``documents`` has doc_id, pub_key."""
    doc = F.get_json_object("payload", "$.doc_id").cast("bigint")
    newest = jobs.where(F.col("state") == state).withColumn("doc_id", doc).orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)
    return newest.join(documents.select("doc_id", "pub_key"), "doc_id", "left").select("id", "kind", "doc_id", "pub_key")
