"""A term index that lies in files and is searched, extended and merged there.

Under the index's folder, ``postings/segment=S/part=P`` has token, section, doc_id, positions, a part being a range of
tokens, and ``documents/segment=S`` the documents that segment S speaks for. A document's latest segment holds: its postings
of earlier ones no longer count. A segment is there once its documents are written, so a failed write leaves
nothing that a search would read. The ranges are cut once, when the index is made, at equal numbers of postings; a token that fills
several of them is cut into files by documents.

A search knows the parts of its words and of its prefixes, so it reads these folders only, and in them the row groups that can hold a word.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kept import kept
from .library import build_term_index, text_match

PARTS = 64
_POSTINGS = "token string, section string, doc_id bigint, positions array<int>, segment int, part int"
_DOCUMENTS = "doc_id bigint, base boolean, segment int"


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    path: str
    bounds: tuple[str, ...]
    sections: tuple[str, ...]

    @classmethod
    def create(cls, docs: DataFrame, path: str, sections: tuple[str, ...] = ("title", "abstract"), parts: int = PARTS) -> StoredIndex:
        """Index documents (doc_id and the sections' columns) in a new folder."""
        spark = docs.sparkSession
        index = kept(build_term_index(docs, sections))
        spread = index.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        # tokens in order, and how many postings lie before them: sums over ranges of the order, a row for each
        ranged = kept(spread.repartitionByRange("token").sortWithinPartitions("token").withColumn("place", F.monotonically_increasing_id()))
        sums = {r.r: r.n for r in ranged.groupBy(F.shiftright("place", 33).alias("r")).agg(F.sum("n").alias("n")).collect()}
        total, before, base = sum(sums.values()), 0, {}
        for r in sorted(sums):
            base[r] = before
            before += sums[r]
        inside = F.sum("n").over(Window.partitionBy(F.shiftright("place", 33)).orderBy("place"))
        start = F.element_at(F.create_map(*[F.lit(x) for r in base for x in (r, base[r])]), F.shiftright("place", 33)) if base else F.lit(0)
        own = F.floor((start + inside - F.col("n")) * F.lit(parts) / F.lit(max(1, total)))
        firsts = ranged.select("token", own.alias("cut")).groupBy("cut").agg(F.min("token").alias("token")).where("cut > 0")
        bounds = tuple(sorted(r.token for r in firsts.collect()))  # fewer than ``parts``
        spark.createDataFrame([(list(bounds), list(sections))], "bounds array<string>, sections array<string>").write.parquet(f"{path}/ranges")
        made = cls(spark, path, bounds, sections)
        made._write(index, docs.select("doc_id"), 0, True)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredIndex:
        row = spark.read.parquet(f"{path}/ranges").first()
        return cls(spark, path, tuple(row.bounds), tuple(row.sections))

    def part_of(self, token: str) -> int:
        return bisect_right(self.bounds, token)

    def _write(self, index: DataFrame, ids: DataFrame, segment: int, base: bool) -> None:
        cuts = F.array(*[F.lit(b) for b in self.bounds]).cast("array<string>")
        part = F.size(F.filter(cuts, lambda b: b <= F.col("token"))).alias("part")
        rows = index.select("token", "section", "doc_id", "positions", part)
        order = ("part", "token", "doc_id")
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{self.path}/postings/segment={segment}")
        ids.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(base).alias("base")).distinct().write.parquet(f"{self.path}/documents/segment={segment}")

    def _documents(self) -> DataFrame:
        """doc_id, segment of every document's latest segment, from the last whole one on."""
        rows = self.spark.read.schema(_DOCUMENTS).parquet(f"{self.path}/documents")
        first = rows.where("base").agg(F.coalesce(F.max("segment"), F.lit(0)).alias("first"))
        return rows.join(F.broadcast(first)).where("segment >= first").groupBy("doc_id").agg(F.max("segment").alias("segment"))

    def _segments(self) -> list[int]:
        rows = self.spark.read.schema(_DOCUMENTS).parquet(f"{self.path}/documents")
        return sorted(r.segment for r in rows.select("segment").distinct().collect())

    def _next(self) -> int:
        return max(self._segments(), default=0) + 1

    def upsert(self, docs: DataFrame) -> None:
        """Index new documents, and known ones anew: what earlier segments have of them counts no more."""
        self._write(build_term_index(docs, self.sections), docs.select("doc_id"), self._next(), False)

    def remove(self, ids: DataFrame) -> None:
        """Forget documents."""
        none = self.spark.createDataFrame([], "token string, section string, doc_id bigint, positions array<int>")
        self._write(none, ids.select("doc_id"), self._next(), False)

    def merge(self) -> None:
        """Rewrite what counts as one segment; the older ones are not read any more, and are deleted."""
        segments = self._segments()
        live = self.postings()
        ids = self._documents().join(live.select("doc_id").distinct(), "doc_id", "left_semi")
        self._write(live, ids, self._next(), True)
        context = self.spark.sparkContext
        for kind in ("documents", "postings"):
            for s in segments:
                place = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/segment={s}")
                place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

    def postings(self, tokens: tuple[str, ...] | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
        """token, section, doc_id, positions that count: of the tokens and prefixes, or all."""
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings").where(F.col("segment").isin(*self._segments()))
        if tokens is not None:
            parts = {self.part_of(t) for t in tokens}
            wanted = F.col("token").isin(*tokens)
            for p in prefixes:
                parts |= set(range(self.part_of(p), self.part_of(p + "\U0010ffff") + 1))
                wanted = wanted | F.col("token").startswith(p)
            rows = rows.where(F.col("part").isin(*sorted(parts)) & wanted)
        return rows.join(self._documents(), ["doc_id", "segment"]).select("token", "section", "doc_id", "positions")

    def match(
        self, all_of: tuple[str, ...] = (), any_of: tuple[str, ...] = (), none_of: tuple[str, ...] = (), phrases: tuple[tuple[str, ...], ...] = (),
        prefixes: tuple[str, ...] = (), sections: tuple[str, ...] | None = None,
    ) -> DataFrame:
        """doc_id of documents that match all given conditions, as ``text_match`` has it."""
        asked = tuple(dict.fromkeys([*all_of, *any_of, *none_of, *(w for p in phrases for w in p)]))
        rows = self.postings(asked, prefixes)
        if all_of or any_of or phrases or prefixes:
            return text_match(rows, all_of, any_of, none_of, phrases, prefixes, sections)
        every = self.postings() if sections is None else self.postings().where(F.col("section").isin(*sections))
        hits = every.select("doc_id").distinct()
        if none_of:
            rows = rows if sections is None else rows.where(F.col("section").isin(*sections))
            hits = hits.join(rows.where(F.col("token").isin(*none_of)).select("doc_id"), "doc_id", "left_anti")
        return hits
