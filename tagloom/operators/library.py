"""Library search, term index, document finder, in-document find."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import structure
from .kept import kept
from .outline import SECTIONS

AVAILABLE = ("fetched", "non_english_only")


@dataclass(frozen=True)
class LibraryFilters:
    text: tuple[str, ...] = ()
    include_tags: tuple[int, ...] = ()
    exclude_tags: tuple[int, ...] = ()
    label_source: str | None = None
    review_state: str | None = None
    has_fulltext: bool | None = None
    has_drawings: bool | None = None
    sections: tuple[str, ...] = field(default=("title", "abstract"))


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters that decompose into a letter and marks, their plain forms, and then all combining marks."""
    accented, plain, marks = [], [], []
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif len(parts) > 1 and c == c.lower() and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            accented.append(c)
            plain.append(parts[0])
    return "".join(accented + marks), "".join(plain)


_ACCENTED, _PLAIN = _plain_letters()


def fold(text: Column) -> Column:
    """Lower case without diacritics: marks are dropped, from letters that are one with theirs too."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


WORDS = 1 << 17  # whose positions a task holds at a time, in whole texts


def _few_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of texts of about ``WORDS`` words, a longer text alone."""
    for batch in batches:
        words = np.asarray(batch.column(2).offsets)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(words, words[at] + WORDS, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, section, doc_id, positions from doc_id, section, tokens of a text."""
    for batch in _few_words(batches):
        tokens = batch.column(2)
        flat = tokens.flatten().dictionary_encode()
        sizes = np.diff(np.asarray(tokens.offsets))
        row = np.repeat(np.arange(batch.num_rows), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = np.asarray(flat.indices).astype(np.int64)
        order = np.lexsort((pos, code, row))
        row, code, pos = row[order], code[order], pos[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(row) else np.zeros(0, np.int64)
        at = pa.array(row[first])
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(pos.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [flat.dictionary.take(pa.array(code[first])), batch.column(1).take(at), batch.column(0).take(at), places], names=["token", "section", "doc_id", "positions"]
        )


def build_term_index(docs: DataFrame, sections: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """token, section, doc_id, positions. A text's positions are grouped where it is read: nothing is shuffled."""
    rows = None
    for s in sections:
        words = F.filter(F.split(fold(F.col(s)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
        part = docs.where(F.col(s).isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(s).alias("section"), words.alias("tokens"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.mapInArrow(_positions, "token string, section string, doc_id bigint, positions array<int>")


def text_match(
    index: DataFrame,
    all_of: tuple[str, ...] = (),
    any_of: tuple[str, ...] = (),
    none_of: tuple[str, ...] = (),
    phrases: tuple[tuple[str, ...], ...] = (),
    prefixes: tuple[str, ...] = (),
    sections: tuple[str, ...] | None = None,
) -> DataFrame:
    """doc_id of documents that match all given conditions, in the given sections.

    The index is read once, for the terms that are asked for; what it has of them is kept for all conditions.
    """
    hits = None
    if sections is not None:
        index = index.where(F.col("section").isin(*sections))
    if all_of or any_of or phrases or prefixes:
        asked = F.col("token").isin(*all_of, *any_of, *none_of, *(w for p in phrases for w in p))
        for prefix in prefixes:
            asked = asked | F.col("token").startswith(prefix)
        index = kept(index.where(asked))

    def meet(found: DataFrame) -> None:
        nonlocal hits
        hits = found if hits is None else hits.join(found, "doc_id", "left_semi")

    if all_of:
        own = index.where(F.col("token").isin(*all_of)).groupBy("doc_id").agg(F.countDistinct("token").alias("n"))
        meet(own.where(F.col("n") == len(set(all_of))).select("doc_id"))
    if any_of:
        meet(index.where(F.col("token").isin(*any_of)).select("doc_id").distinct())
    for prefix in prefixes:
        meet(index.where(F.col("token").startswith(prefix)).select("doc_id").distinct())
    for phrase in phrases:
        places = None
        for i, word in enumerate(phrase):
            here = index.where(F.col("token") == word).select("doc_id", "section", F.explode("positions").alias("p")).select("doc_id", "section", (F.col("p") - i).alias("p"))
            places = here if places is None else places.join(here, ["doc_id", "section", "p"], "left_semi")
        meet(places.select("doc_id").distinct())
    if hits is None:
        hits = index.select("doc_id").distinct()
    if none_of:
        hits = hits.join(index.where(F.col("token").isin(*none_of)).select("doc_id"), "doc_id", "left_anti")
    return hits


def review_queue(documents: DataFrame) -> DataFrame:
    return documents.where("fetch_status = 'fetched' AND review_state = 'queued'").orderBy("doc_id")


def find_documents(documents: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Documents by number (separators ignored) or title part; the exact key first, then newest."""
    number = query.upper().translate(str.maketrans("", "", " ./,"))
    found = documents.where("fetch_status <> 'not_found'")
    if number:
        found = found.where(F.col("pub_key").contains(number) | F.contains(F.lower("title"), F.lit(query.strip().lower())))
    exact = (F.col("pub_key") == number).cast("int")
    return found.orderBy(exact.desc(), F.desc("doc_id")).limit(limit).select("doc_id", "pub_key", "title")


def library_search(
    documents: DataFrame, labels: DataFrame, fulltext: DataFrame, drawings: DataFrame, filters: LibraryFilters, index=None
) -> DataFrame:
    """doc_id, pub_key, title, review_state, tags, has_drawings of fetched documents, as semi and anti joins.

    ``index`` is a stored one (``StoredIndex``, which reads the words' parts only) or a frame of postings; without it
    the documents' texts are read.
    """
    out = documents.where("fetch_status = 'fetched'")
    if filters.text:
        if isinstance(index, DataFrame) or index is None:
            found = text_match(build_term_index(documents, filters.sections) if index is None else index, all_of=filters.text)
        else:
            found = index.match(all_of=filters.text, sections=filters.sections)
        out = out.join(found, "doc_id", "left_semi")
    if filters.label_source is not None:
        source = "auto" if filters.label_source == "auto" else "human"
        out = out.join(labels.where(F.col("source") == source), "doc_id", "left_semi")
    if filters.review_state is not None:
        out = out.where(F.col("review_state") == filters.review_state)
    there = drawings.where("status = 'fetched'").select("doc_id").distinct()
    for wanted, have in ((filters.has_fulltext, fulltext.where(F.col("status").isin(*AVAILABLE))), (filters.has_drawings, there)):
        if wanted is not None:
            out = out.join(have.select("doc_id"), "doc_id", "left_semi" if wanted else "left_anti")
    pos = labels.where("state = 'pos'")
    if filters.include_tags:
        own = pos.where(F.col("tag_id").isin(*filters.include_tags)).groupBy("doc_id").agg(F.countDistinct("tag_id").alias("n"))
        out = out.join(own.where(F.col("n") == len(set(filters.include_tags))), "doc_id", "left_semi")
    if filters.exclude_tags:
        out = out.join(pos.where(F.col("tag_id").isin(*filters.exclude_tags)), "doc_id", "left_anti")
    tags = pos.groupBy("doc_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))
    return (
        out.join(tags, "doc_id", "left")
        .join(there.withColumn("d", F.lit(True)), "doc_id", "left")
        .select("doc_id", "pub_key", "title", "review_state", F.coalesce("tags", F.array().cast("array<int>")).alias("tags"), F.col("d").isNotNull().alias("has_drawings"))
    )


def find_in_documents(sections: DataFrame, query: str) -> DataFrame:
    """doc_id, section, n, start, stop: non-overlapping places of a query of two characters or more, case and blanks around it ignored.

    Offsets are UTF-16 units, as those of highlights; n counts a document's places on, in the order of its sections.
    """
    q = query.strip().lower()
    size = structure.units(q)
    if size < 2:
        raise ValueError("the query is too short")
    pattern = re.compile(re.escape(q))

    @pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[int]:
            low = (text or "").lower()
            where = structure.places(low)
            return [where(m.start()) for m in pattern.finditer(low)]

        return texts.map(of)

    found = sections.where("text IS NOT NULL").select("doc_id", "section", F.explode(places("text")).alias("start"))
    # a window holds one document's places
    order = Window.partitionBy("doc_id").orderBy(F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")), "section", "start")
    return found.select("doc_id", "section", F.row_number().over(order).alias("n"), "start", (F.col("start") + size).alias("stop"))
