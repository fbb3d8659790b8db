"""Related documents as classes: connected components over shared applications and families.

A document and the application and family it belongs to are nodes of a bipartite graph. Each round every document takes the
smallest label among all members of its groups, the root of its tree is hung under what its tree has found, and
paths are halved; so the number of rounds goes with the logarithm of the longest chain of families. Groups are only ever
reduced to their smallest label, never listed, and the rows of a hot group, root or class stay in their tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import kept

KEYS = ("application_number", "family_id")
HOT_SHARE = 1_000


def memberships(documents: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """doc_id, key of every group that a document belongs to."""
    named = F.array(*[F.concat(F.lit(f"{k}:"), F.col(k).cast("string")) for k in keys])
    return documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(named).alias("key")).where("key IS NOT NULL").distinct()


def look_up(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """Rows with the facts of their key; ``facts`` is a written table of one row a key with the number of its rows in ``n``.

    Keys of more than a thousandth of the rows, so under a thousand of them, are broadcast; the others are joined.
    """
    hot, cold = facts.where(F.col("n") * HOT_SHARE > total), facts.where(F.col("n") * HOT_SHARE <= total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def related_classes(documents: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), n_members of every document with an id."""
    every = memberships(documents, keys)
    sizes = kept(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    links = kept(look_up(every, sizes, "key", total).select("doc_id", "key"))  # of groups that relate anything
    labels = kept(links.select("doc_id").distinct().withColumn("p", F.col("doc_id")))
    n_docs = labels.count()
    changed = total
    while changed:
        rows = kept(links.join(labels, "doc_id"))
        low = kept(rows.groupBy("key").agg(F.min("p").alias("least"), F.count(F.lit(1)).alias("n")))
        own = kept(look_up(rows, low, "key", total).groupBy("doc_id").agg(F.first("p").alias("p"), F.min("least").alias("m")))
        # what any document of a tree has found becomes the parent of the tree's root, and of the whole tree
        hooks = kept(own.groupBy("p").agg(F.min("m").alias("h"), F.count(F.lit(1)).alias("n")))
        hung = kept(look_up(own, hooks, "p", n_docs).select("doc_id", F.col("p").alias("old"), F.least("m", "h").alias("q")))
        tops = hung.groupBy("q").agg(F.count(F.lit(1)).alias("n")).join(hung.select(F.col("doc_id").alias("q"), F.col("q").alias("above")), "q")
        halved = look_up(hung, kept(tops), "q", n_docs)
        labels = kept(halved.select("doc_id", F.least("q", "above").alias("p"), "old"))
        changed = labels.where("p <> old").count()
        labels = labels.drop("old")
    ids = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    classed = ids.join(labels, "doc_id", "left").select("doc_id", F.coalesce("p", "doc_id").alias("class_id"))
    classed = kept(classed)
    counts = kept(classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")))
    return look_up(classed, counts, "class_id", classed.count()).select("doc_id", "class_id", F.col("n").alias("n_members"))


def related_to(asked: DataFrame, documents: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """doc_id, related_id, via: the other documents of the asked ones' applications and families, and only theirs."""
    groups = memberships(documents, keys)
    own = groups.join(asked.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pairs = own.join(groups.select(F.col("doc_id").alias("related_id"), "key"), "key").where("doc_id <> related_id")
    via = F.array_sort(F.collect_set(F.split_part("key", F.lit(":"), F.lit(1)))).alias("via")
    return pairs.groupBy("doc_id", "related_id").agg(via)
