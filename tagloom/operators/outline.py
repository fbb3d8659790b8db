"""Structure of descriptions and claims: blocks, references, dependency trees, highlights."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import structure
from ..functions.text import utf16_slice


def _rows_of(read: Callable[[str | None], Iterable[tuple]], schema: str):
    """A pass over (doc_id, text) that gives the rows of each text, one text at a time: no shuffle, no group a document."""
    fields = T.StructType.fromDDL(f"doc_id bigint, {schema}")
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += [(doc, *row) for row in read(text.as_py())]
                if len(held) >= BATCH_ROWS:
                    yield _batch(held, arrow)
                    held = []
            yield _batch(held, arrow)

    def frame(docs: DataFrame, col: str) -> DataFrame:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(col).cast("string").alias("text")).mapInArrow(run, fields)

    return frame


BATCH_ROWS = 10_000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def description_blocks(docs: DataFrame, col: str = "description") -> DataFrame:
    """doc_id, n (line), kind, label, start, stop: numbered paragraphs, headings, paragraphs."""
    return _rows_of(structure.description_rows, "n int, kind string, label string, start int, stop int")(docs, col)


def claim_blocks(docs: DataFrame, col: str = "claims") -> DataFrame:
    """doc_id, block, label, start, stop: a numbered line opens a claim, others go on with it."""
    return _rows_of(_claim_rows, "block bigint, label string, start int, stop int")(docs, col)


def _claim_rows(text: str | None) -> Iterator[tuple]:
    return ((c.block, c.label, c.start, c.stop) for c in structure.claims(text))


def claim_refs(docs: DataFrame, col: str = "claims") -> DataFrame:
    """doc_id, claim, start, stop, ref, depends: links to claims, and dependencies without a link (null span)."""
    return _rows_of(structure.reference_rows, "claim bigint, start int, stop int, ref bigint, depends boolean")(docs, col)


def claim_dependencies(refs: DataFrame) -> DataFrame:
    return refs.where("depends").select("doc_id", "claim", F.col("ref").alias("depends_on")).distinct()


def claim_tree(docs: DataFrame, col: str = "claims") -> DataFrame:
    """doc_id, claim, is_independent, depth, base: the longest way down to an independent claim, and that claim."""
    return _rows_of(structure.tree_rows, "claim bigint, is_independent boolean, depth int, base bigint")(docs, col)


@pandas_udf(T.ArrayType(T.IntegerType()))
def occurrences(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    """Start positions (UTF-16 units, from 0) of the non-overlapping occurrences of a quote, in one pass."""

    def places(text: str | None, quote: str | None) -> list[int]:
        out: list[int] = []
        if not text or not quote:
            return out
        units, seen, at = 0, 0, text.find(quote)
        while at >= 0:
            units += structure.units(text[seen:at])
            out.append(units)
            seen, at = at, text.find(quote, at + len(quote))
        return out

    return pd.Series([places(t, q) for t, q in zip(texts, quotes, strict=True)])


def resolve_highlights(highlights: DataFrame) -> DataFrame:
    """Add new_start, new_stop, detached. ``highlights`` has start, stop, quote and the section's present text.

    A quote still in place stays; else its nearest occurrence is taken (the earlier of two); else it is detached.
    Offsets are UTF-16 units.
    """
    here = utf16_slice(F.col("text"), F.col("start"), F.col("stop")) == F.col("quote")
    nearest = F.array_min(F.transform("places", lambda p: F.struct(F.abs(p - F.col("start")).alias("d"), p.alias("p"))))["p"]
    start = F.when(F.coalesce(here, F.lit(False)), F.col("start")).otherwise(F.coalesce(nearest, F.col("start")))
    detached = ~F.coalesce(here, F.lit(False)) & nearest.isNull()
    placed = highlights.withColumn("places", occurrences(F.col("text"), F.col("quote")))
    return placed.select(
        *highlights.columns, start.cast("int").alias("new_start"), (start + F.col("stop") - F.col("start")).cast("int").alias("new_stop"), detached.alias("detached")
    )


def highlight_locations(highlights: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add location: the block around the start, by a range join within (doc_id, section).

    ``blocks`` has doc_id, section, kind, label, start, stop. A highlight outside all blocks, as on a blank line, or
    a detached one is told by its section alone.
    """
    b = blocks.select(
        F.col("doc_id").alias("b_doc"), F.col("section").alias("b_section"), "kind", "label", F.col("start").alias("b0"), F.col("stop").alias("b1")
    )
    around = (
        (F.col("doc_id") == F.col("b_doc")) & (F.col("section") == F.col("b_section")) & ~F.col("detached")
        & (F.col("b0") <= F.col("new_start")) & (F.col("new_start") < F.col("b1"))
    )
    joined = highlights.join(b, around, "left")
    name = F.initcap("section")
    where = (
        F.when(F.col("detached"), name)
        .when(F.col("kind") == "claim", F.coalesce(F.concat(F.lit("Claim "), F.col("label")), name))
        .when(F.col("kind") == "heading", F.concat(name, F.lit(", heading")))
        .when(F.col("label").isNotNull(), F.concat(name, F.lit(" ["), F.col("label"), F.lit("]")))
        .otherwise(name)
    )
    return joined.withColumn("location", where).drop("b_doc", "b_section", "kind", "label", "b0", "b1")


# fixed values: order of the sections of a document
SECTIONS = ("title", "abstract", "description", "claims")


def order_highlights(highlights: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    return highlights.orderBy("doc_id", place, "start", "id")


COLORS = ("yellow", "green", "blue", "pink", "orange")


def add_highlights(highlights: DataFrame, new: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(highlights, rejected): quotes are cut from the text; blank or out-of-range ones and unknown sections or colours are refused."""
    cut = new.join(sections.select("doc_id", "section", "text"), ["doc_id", "section"], "left").withColumn(
        "quote", utf16_slice(F.col("text"), F.col("start"), F.col("stop"))
    )
    ok = F.coalesce(F.col("section").isin(*SECTIONS) & F.col("color").isin(*COLORS) & (F.trim("quote") != ""), F.lit(False))
    good = cut.where(ok).select(*highlights.columns)
    return highlights.unionByName(good), cut.where(~ok).drop("text", "quote")


def edit_highlights(highlights: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(highlights, rejected edits): comment and colour by id; a blank comment is none, the passage stays as it is."""
    known = highlights.select("id")
    ok = edits.where(F.col("color").isin(*COLORS)).join(known, "id", "left_semi")
    comment = F.nullif(F.trim("comment"), F.lit(""))
    new = ok.select("id", comment.alias("new_comment"), F.col("color").alias("new_color"), F.lit(True).alias("hit"))
    after = highlights.join(new, "id", "left").select(
        *[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in ("comment", "color") else F.col(c) for c in highlights.columns]
    )
    return after, edits.join(ok.select("id"), "id", "left_anti")


def delete_highlights(highlights: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(highlights, unknown ids)."""
    return highlights.join(ids.select("id"), "id", "left_anti"), ids.select("id").join(highlights.select("id"), "id", "left_anti")
