"""Tag administration. Tags are a small dimension: thousands of rows at any corpus size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESERVED_HOTKEYS = ("j", "k", "s", "/")


def tag_tree(tags: DataFrame, max_depth: int = 64) -> DataFrame:
    """tag_id, depth, path of active tags: children below parents, siblings by name, orphans at the root."""
    active = tags.where("NOT archived").select("tag_id", "name", "parent_id")
    roots = active.join(active.select(F.col("tag_id").alias("pid")), F.col("parent_id") == F.col("pid"), "left").where("pid IS NULL")
    step = F.array(F.concat_ws("\u0001", F.lower("name"), F.lpad(F.col("tag_id").cast("string"), 12, "0")))
    level = roots.select("tag_id", F.lit(0).alias("depth"), step.alias("path"))
    out = level
    for depth in range(1, max_depth):
        above = level.select(F.col("tag_id").alias("parent_id"), F.col("path").alias("above"))
        level = active.join(above, "parent_id").select("tag_id", F.lit(depth).alias("depth"), F.concat("above", step).alias("path"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.withColumn("position", F.row_number().over(Window.orderBy("path"))).select("tag_id", "depth", "position")


def ancestors(tags: DataFrame, max_depth: int = 64) -> DataFrame:
    """tag_id, ancestor: the closure of parents."""
    edges = tags.where("parent_id IS NOT NULL").select("tag_id", F.col("parent_id").alias("ancestor"))
    level, out = edges, edges
    for _ in range(max_depth):
        up = edges.select(F.col("tag_id").alias("ancestor"), F.col("ancestor").alias("next"))
        level = level.join(up, "ancestor").select("tag_id", F.col("next").alias("ancestor")).join(out, ["tag_id", "ancestor"], "left_anti").distinct()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.distinct()


def apply_tag_edits(tags: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, rejected with reason, tag_id that need a new vector).

    ``edits`` has tag_id, name, definition, parent_id, color, hotkey, bump. Each is judged against the tags as they are, and then
    against the others of the batch: of several that take one name or hotkey the one of the smallest tag_id stands, and
    those whose new parents close a cycle together all fall.
    """
    e = edits.select("tag_id", F.trim("name").alias("name"), F.trim("definition").alias("definition"), "parent_id", "color", F.nullif(F.trim("hotkey"), F.lit("")).alias("hotkey"), "bump")
    own = tags.select("tag_id", F.col("archived").alias("own_archived"), F.col("name").alias("old_name"), F.col("definition").alias("old_definition"))
    names = tags.select(F.col("name"), F.col("tag_id").alias("name_owner"))
    keys = tags.where("NOT archived AND hotkey IS NOT NULL").groupBy(F.lower("hotkey").alias("key")).agg(F.collect_set("tag_id").alias("key_owners"))
    parents = tags.select(F.col("tag_id").alias("parent_id"), F.col("archived").alias("parent_archived"))
    loops = ancestors(tags).select(F.col("tag_id").alias("parent_id"), F.col("ancestor").alias("tag_id"), F.lit(True).alias("loops"))
    j = (
        e.join(own, "tag_id", "left").join(names, "name", "left").join(keys, F.lower("hotkey") == F.col("key"), "left")
        .join(parents, "parent_id", "left").join(loops, ["parent_id", "tag_id"], "left")
    )
    others = F.size(F.array_remove(F.coalesce("key_owners", F.array().cast("array<bigint>")), F.col("tag_id"))) > 0
    bad_parent = F.col("parent_id").isNotNull() & (
        F.col("parent_archived").isNull() | F.col("parent_archived") | (F.col("parent_id") == F.col("tag_id")) | F.coalesce("loops", F.lit(False))
    )
    reason = (
        F.when(F.col("old_name").isNull(), "not_found").when(F.col("own_archived"), "archived")
        .when(F.col("name") == "", "empty_name").when(F.col("definition") == "", "empty_definition")
        .when(F.col("name_owner").isNotNull() & (F.col("name_owner") != F.col("tag_id")), "duplicate_name")
        .when(F.length("hotkey") != 1, "invalid_hotkey").when(F.lower("hotkey").isin(*RESERVED_HOTKEYS), "reserved_hotkey")
        .when(F.col("hotkey").isNotNull() & others, "hotkey_in_use").when(bad_parent, "invalid_parent")
    )
    judged = j.withColumn("reason", reason)
    alone = F.col("reason").isNull()
    # edits without a hotkey are no group
    same = {"name": F.col("name"), "hotkey": F.coalesce(F.lower("hotkey"), F.concat(F.lit("\0"), F.col("tag_id").cast("string")))}
    turn = {c: F.row_number().over(Window.partitionBy(alone, key).orderBy("tag_id")) for c, key in same.items()}
    judged = judged.withColumns({"name_turn": turn["name"], "hotkey_turn": turn["hotkey"]}).withColumn(
        "reason",
        F.when(~alone, F.col("reason")).when(F.col("name_turn") > 1, "duplicate_name").when(F.col("hotkey").isNotNull() & (F.col("hotkey_turn") > 1), "hotkey_in_use"),
    )
    moved = judged.where("reason IS NULL").select("tag_id", F.col("parent_id").alias("to"), F.lit(True).alias("moved"))
    tree = tags.join(moved, "tag_id", "left").select("tag_id", F.when(F.col("moved"), F.col("to")).otherwise(F.col("parent_id")).alias("parent_id"))
    closed = ancestors(tree).where("tag_id = ancestor").select("tag_id", F.lit(True).alias("closed"))
    judged = judged.join(closed, "tag_id", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("closed"), "invalid_parent").otherwise(F.col("reason")))
    good = judged.where("reason IS NULL")
    changed = good.where(F.col("bump") | (F.col("name") != F.col("old_name")) | (F.col("definition") != F.col("old_definition"))).select("tag_id")
    new = good.select("tag_id", *[F.col(c).alias(f"new_{c}") for c in ("name", "definition", "parent_id", "color", "hotkey")], F.col("bump").cast("int").alias("b"), F.lit(True).alias("hit"))
    after = tags.join(new, "tag_id", "left").select(
        *[
            F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in ("name", "definition", "parent_id", "color", "hotkey")
            else (F.col("version") + F.coalesce("b", F.lit(0))).alias("version") if c == "version" else F.col(c)
            for c in tags.columns
        ]
    )
    return after, judged.where("reason IS NOT NULL").select("tag_id", "reason"), changed


def archive(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """Archive tags; their children move to the root."""
    own = ids.select("tag_id", F.lit(True).alias("hit"))
    up = ids.select(F.col("tag_id").alias("parent_id"), F.lit(True).alias("orphan"))
    out = tags.join(own, "tag_id", "left").join(up, "parent_id", "left")
    return out.select(
        *[
            F.coalesce("hit", "archived").alias(c) if c == "archived" else F.when(F.col("orphan").isNull(), F.col(c)).alias(c) if c == "parent_id" else F.col(c)
            for c in tags.columns
        ]
    )


def restore(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """Restore tags; a hotkey that an active tag has by now is dropped."""
    own = ids.select("tag_id", F.lit(True).alias("hit"))
    taken = tags.where("NOT archived AND hotkey IS NOT NULL").select(F.lower("hotkey").alias("key"), F.lit(True).alias("taken")).distinct()
    out = tags.join(own, "tag_id", "left").join(taken, F.lower("hotkey") == F.col("key"), "left")
    back = F.coalesce("hit", F.lit(False)) & F.col("archived")
    return out.select(
        *[
            F.when(back, False).otherwise(F.col(c)).alias(c) if c == "archived" else F.when(~(back & F.coalesce("taken", F.lit(False))), F.col(c)).alias(c) if c == "hotkey" else F.col(c)
            for c in tags.columns
        ]
    )


def import_tag_scheme(tags: DataFrame, scheme: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new tags, hotkeys dropped, parents dropped). Add-only: known names are left as they are.

    A bad or taken hotkey is dropped. Parents are found by name among old and new active tags. An empty name
    or definition, or a name twice in the scheme, refuses the whole scheme.
    """
    s = scheme.select(F.trim("name").alias("name"), F.trim("definition").alias("definition"), F.trim("parent").alias("parent"), "color", F.nullif(F.trim("hotkey"), F.lit("")).alias("hotkey"))
    invalid = s.where((F.coalesce("name", F.lit("")) == "") | (F.coalesce("definition", F.lit("")) == "")).isEmpty()
    if not invalid or not s.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("the scheme has an invalid entry")
    last = tags.agg(F.coalesce(F.max("tag_id"), F.lit(-1)).alias("last"))
    new = s.join(tags.select("name"), "name", "left_anti").join(last)
    new = new.withColumn("tag_id", F.col("last") + F.row_number().over(Window.orderBy("name"))).drop("last")
    taken = tags.where("NOT archived").select(F.lower("hotkey").alias("k")).where("k IS NOT NULL").distinct().withColumn("taken", F.lit(True))
    first = F.row_number().over(Window.partitionBy(F.lower("hotkey")).orderBy("tag_id"))
    new = new.join(taken, F.lower("hotkey") == F.col("k"), "left").withColumn("turn", first)
    bad = F.col("hotkey").isNotNull() & ((F.length("hotkey") != 1) | F.lower("hotkey").isin(*RESERVED_HOTKEYS) | F.col("taken").isNotNull() | (F.col("turn") > 1))
    dropped = new.where(bad).select("name", "hotkey")
    new = new.withColumn("hotkey", F.when(~F.coalesce(bad, F.lit(False)), F.col("hotkey")))
    active = tags.where("NOT archived").select(F.col("name").alias("parent"), F.col("tag_id").alias("parent_id")).unionByName(
        new.select(F.col("name").alias("parent"), F.col("tag_id").alias("parent_id"))
    )
    placed = new.join(active, "parent", "left")
    cyclic = ancestors(placed.select("tag_id", "parent_id").unionByName(tags.select("tag_id", "parent_id"))).where("tag_id = ancestor").select("tag_id", F.lit(True).alias("loops"))
    placed = placed.join(cyclic, "tag_id", "left")
    lost = F.col("parent").isNotNull() & (F.col("parent_id").isNull() | F.coalesce("loops", F.lit(False)))
    out = placed.select("tag_id", "name", "definition", F.when(~lost, F.col("parent_id")).alias("parent_id"), "color", "hotkey")
    return out, dropped, placed.where(lost).select("name", "parent")


def enable_auto(tags: DataFrame, eligible: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, refused tag_ids): automatic mode with the calibrated threshold, for eligible tags only."""
    ok = ids.join(eligible.where("eligible").select("tag_id", F.col("threshold").alias("t")), "tag_id")
    after = tags.join(ok.withColumn("hit", F.lit(True)), "tag_id", "left")
    return (
        after.select(*[F.coalesce("hit", "auto_enabled").alias(c) if c == "auto_enabled" else F.coalesce("t", "threshold").alias(c) if c == "threshold" else F.col(c) for c in tags.columns]),
        ids.join(ok.select("tag_id"), "tag_id", "left_anti"),
    )
