"""A Merkle manifest of a dataset: leaf, root, and every row's proof, by nested rollups.

Each language's leaves get their rank in doc_id order from ranges of the order and the numbers of rows before them.
The rank's base-8 digits are columns. Within a block of 8^4 ranks a rollup groups the digits away one after
the other, lowest first: a node is a struct of its hash and the nested structs of its children, and a block is one row.
The blocks' hashes, ranked by block number, are the leaves of the next rollup, until a language has one block; the
languages' subroots are rolled up likewise. On the way down a transform over the nested structs gives every node the
left and right siblings on its path, and explode emits the proofs: no leaf is ever joined with anything. Only whole
blocks, one row for 4,096 ranks, meet the path of the block above them.

Edge cases: null columns hash as ``-``, also a null doc_id, whose row comes first in its language; such a row is never
tampered with. A null language is a group of its own, the first. Empty texts hash as ``0:``. Very long texts are
read whole where they lie, only digests move. Rows that share a doc_id are ordered by their leaves; repeated rows
are equal leaves side by side, each with its own proof. A language of one row has that leaf as its
subroot, and a table of one language that subroot as its root; such rows have the hash of nothing as their proof. An
empty table gives an empty result. Columns other than the five documented ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, Workspace, pick

ARITY = 8
DIGITS = 4
BLOCK = ARITY**DIGITS
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value with its length in front, so that no two rows read alike."""
    own = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return digest(*[encoded(text if c == "text" else F.col(c)) for c in LEAF_COLUMNS])


def leaves(docs: DataFrame, every: int = 3) -> DataFrame:
    """doc_id, lang, hash, and the hash after tampering where the id's CRC is divided by ``every``, else null."""
    picked = pick(docs, *LEAF_COLUMNS, types=DOCUMENT_COLUMNS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    other = F.when(hit & F.col("text").isNotNull(), leaf_of(F.translate("text", UPPER, UPPER.lower())))
    return picked.select("doc_id", "lang", leaf_of(F.col("text")).alias("hash"), other.alias("tampered"))


def ranked(ws: Workspace, nodes: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The nodes with their rank (from 0) within their group and the group's size, no task holding more than a range.

    Rows that are equal in the order go by their place in the written table, so they can lie in several ranges.
    """
    parts = max(1, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("place")]
    ranges = (
        ws.keep(nodes, f"{name}-nodes")
        .withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        # the range and the row's place in it, in one number that rises with the order
        .withColumn("at", F.monotonically_increasing_id())
        .drop("place")
        .withColumn("part", F.shiftright("at", 33).cast("int"))
    )
    ranges = ws.keep(ranges, f"{name}-ranges")
    ws.drop(f"{name}-nodes")
    # a row for each group in each range
    own = ranges.groupBy(F.col(group).alias("of"), F.col("part").alias("range")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = own.select(
        "of", "range", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(Window.partitionBy("of")).alias("size")
    )
    same = (F.col("part") == F.col("range")) & F.col(group).eqNullSafe(F.col("of"))
    rank = (F.col("base") + F.col("at") - F.col("first")).alias("rank")
    return ranges.join(bases, same).select(*nodes.columns, "size", rank)


def rollup(nodes: DataFrame, group: str, below: int) -> DataFrame:
    """group, block, size, hash, kids: one row for each block of 8^4 ranks, its nodes nested four deep.

    ``nodes`` has group, rank, size (of the group, in nodes of the lowest level), hash and item (what a leaf carries).
    ``below`` is the number of levels under these nodes. Nodes at a level that has but one are not hashed again.
    """
    digits = {f"d{k}": F.pmod(F.floor(F.col("rank") / ARITY**k), F.lit(ARITY)) for k in range(DIGITS)}
    own = nodes.withColumn("block", F.floor(F.col("rank") / BLOCK)).withColumns(digits)
    level = own.select(group, "block", "size", *digits, F.struct(F.col("d0").alias("d"), "hash", "item").alias("node")).repartition(group, "block")
    for k in range(DIGITS):
        rest = [f"d{i}" for i in range(k + 1, DIGITS)]
        # the deal by group and block serves all four groupings
        level = level.groupBy(group, "block", "size", *rest).agg(F.array_sort(F.collect_list("node")).alias("kids"))
        # the level under this one has more than one node
        several = F.col("size") > F.lit(ARITY ** (below + k))
        above = F.when(several, digest(F.array_join("kids.hash", ""))).otherwise(F.get("kids", F.lit(0))["hash"])
        if rest:
            level = level.select(group, "block", "size", *rest, F.struct(F.col(rest[0]).alias("d"), above.alias("hash"), "kids").alias("node"))
        else:
            level = level.select(group, "block", "size", above.alias("hash"), "kids")
    return level


def _down(kids: Column, path: Column, size: Column, level: int, below: int) -> Column:
    """Structs (item, hash, path) of all leaves under ``kids``, whose path ends with ``path``; nearest siblings first."""

    def one(kid: Column, at: Column) -> Column:
        hashes = kids["hash"]
        sides = F.struct(
            F.array_join(F.slice(hashes, F.lit(1), at), "").alias("left"),
            F.array_join(F.slice(hashes, at + 2, F.lit(ARITY)), "").alias("right"),
        )
        own = F.when(size > F.lit(ARITY ** (below + level)), F.concat(F.array(sides), path)).otherwise(path)
        if level == 0:
            return F.struct(kid["item"].alias("item"), kid["hash"].alias("hash"), own.alias("path"))
        return _down(kid["kids"], own, size, level - 1, below)

    found = F.transform(kids, one)
    return F.flatten(found) if level else found


def unrolled(blocks: DataFrame, above: DataFrame, group: str, below: int, carried: list[str]) -> DataFrame:
    """group, size, item, hash, path and carried columns of all leaves of the blocks.

    ``above`` has a row for each block (group, block, path and the carried columns).
    """
    up = above.select(F.col(group).alias("of"), F.col("block").alias("at"), F.col("path").alias("up"), *carried)
    met = blocks.join(up, F.col(group).eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    found = _down(F.col("kids"), F.col("up"), F.col("size"), DIGITS - 1, below)
    return met.select(group, "size", F.explode(found).alias("leaf"), *carried).select(group, "size", "leaf.*", *carried)


_PATH = "array<struct<left: string, right: string>>"


def tree(ws: Workspace, nodes: DataFrame, group: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each rollup, lowest first; group, hash, size of each group's top). ``nodes`` as in ``rollup``."""
    levels = []
    while True:
        blocks = ws.keep(rollup(nodes, group, DIGITS * len(levels)), f"{name}-{len(levels)}")
        levels.append(blocks)
        if blocks.agg(F.max("block")).first()[0] in (None, 0):
            return levels, blocks.select(group, "hash", "size")
        nodes = blocks.select(group, F.col("block").alias("rank"), "size", "hash", F.col("block").alias("item"))


def proofs(levels: list[DataFrame], tops: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """Leaves with their whole paths, from the tops (group, path, carried columns) down."""
    above = tops.withColumn("block", F.lit(0).cast("bigint"))
    for depth in range(len(levels) - 1, 0, -1):
        above = unrolled(levels[depth], above, group, DIGITS * depth, carried).withColumnRenamed("item", "block")
    return unrolled(levels[0], above, group, 0, carried)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, size (rows of the language); see the module."""
    spark = docs.sparkSession
    ws = Workspace(spark, "merkle")
    nodes = ranked(ws, leaves(docs), "lang", ["doc_id", "hash"], "leaves")
    nodes = nodes.select("lang", "rank", "size", "hash", F.struct("doc_id", "tampered").alias("item"))
    levels, tops = tree(ws, nodes, "lang", "documents")
    # languages are ranked and rolled up as rows are
    subroots = ranked(ws, tops.select(F.lit(0).alias("all"), "lang", "hash"), "all", ["lang"], "languages")
    subroots = subroots.select("all", "rank", "size", "hash", F.col("lang").alias("item"))
    upper, top = tree(ws, subroots, "all", "subroots")
    start = top.select("all", F.col("hash").alias("root"), F.array().cast(_PATH).alias("path"))
    by_lang = proofs(upper, start, "all", ["root"]).select(F.col("item").alias("lang"), F.col("hash").alias("subroot"), "path", "root")
    found = proofs(levels, ws.keep(by_lang, "by-language"), "lang", ["subroot", "root"])
    step = lambda h, p: digest(p["left"], h, p["right"])
    folded = F.aggregate("path", F.coalesce("item.tampered", "hash"), step)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    out = found.select("item.doc_id", F.col("hash").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"), "size")
    return ws.result(out.withColumn("verified", F.col("folded_root") == F.col("root")))
