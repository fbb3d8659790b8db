"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, grouping.

A document's set is its distinct k-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``); with fewer than k words the whole sequence is its one
shingle; without words the set is empty and linked with nothing.

1. One pass over the texts makes a row of numbers per document: set size, a
   128-bit digest of the set and the SuperMinHash signature (Ertl, 2017).
2. Documents with equal sets are one class; only its smallest doc_id goes on, so
   a group of thousands of copies costs one row per copy and no pairs.
3. Signatures are cut into bands; nodes that agree in a band share a bucket.
   Buckets are merged into candidate clusters by comparing signatures and set
   sizes with pivots (no all-pairs product; the sift leaves a margin of over five
   standard deviations). A cluster is cut into blocks of bounded size, and links
   are confirmed on the full sets, block against block: the first block against
   all others, then only what that left outside the cluster's largest component.
4. Components of the confirmed links are found by distributed union-find.

With ``bands`` bands of ``rows`` components a pair of similarity s is missed with
probability (1 - s**rows)**bands: 6e-7 at 0.8 with the defaults. Longer bands keep
pairs that share a common passage only out of the buckets.

Edge cases: a null doc_id can't be named in a result, so such rows are linked with
nothing, are their own component (null) and are kept. Every row comes back; rows
that repeat a doc_id with another text are documents of their own. A null text is
an empty one. A very long text is one row of numbers like any other; where it has candidates, a task holds its
whole set. Ties between equal ids don't matter: they name the same component. Empty tables give empty results. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_spread, lean, pick
from .components import connected_components
from .text_arrays import mix, ngrams, text_chunks, words

_GOLD = np.uint64(0x9E3779B97F4A7C15)
# buckets of more nodes are taken as one candidate cluster without comparing signatures
CROWD = 64


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and the sorted distinct shingle hashes of each text, chunk by chunk."""
    for chunk in text_chunks(column):
        w = words(chunk, lower=True)
        at, h = ngrams(w, range(k))
        bounds = np.searchsorted(at, w.bounds)
        counts = np.diff(w.bounds)
        sets = []
        for i in range(len(chunk)):
            if counts[i] >= k:
                sets.append(np.unique(h[bounds[i] : bounds[i + 1]]))
            elif counts[i]:
                one = np.array([counts[i]], np.uint64)
                for x in w.hashes[w.bounds[i] : w.bounds[i + 1]]:
                    one = mix(one * _GOLD + x)
                sets.append(one)
            else:
                sets.append(np.zeros(0, np.uint64))
        yield chunk.first, sets


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of ``m`` components each, as float64 (empty sets: all infinite).

    Element x meets the positions in the order of a random permutation of its own;
    the one at rank j gets j plus a random fraction, and a position keeps the least
    value. Ranks are taken one after the other for all sets at once, and a set drops
    out (early stopping) as soon as all its positions are filled, as later ranks
    can only give larger values.
    """
    n = len(sets)
    out = np.full((n, m), np.inf)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    flat = out.reshape(-1)
    permutation = None
    with np.errstate(over="ignore"):
        for j in range(m):
            bits = mix(x + np.uint64(j + 1) * _GOLD)
            fraction = (bits >> np.uint64(32)).astype(np.float64) * 2.0**-32
            step = ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            if j == 0:
                place = step
                first = step
            else:
                rows = np.arange(len(x))
                place = permutation[rows, j + step]
                permutation[rows, j + step] = permutation[rows, j]
                permutation[rows, j] = place
            np.minimum.at(flat, owner * m + place, j + fraction)
            if j + 1 == m:
                break
            open_sets = ~np.isfinite(out).all(axis=1)
            active = open_sets[owner]
            if not active.any():
                break
            if j == 0:
                x, owner, first = x[active], owner[active], first[active]
                permutation = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
                rows = np.arange(len(x))
                permutation[rows, first] = 0
                permutation[rows, 0] = first
            elif not active.all():
                x, owner, permutation = x[active], owner[active], permutation[active]
    return out


def _digest(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Size and two 64-bit sums of each set: equal for equal sets, whatever their order."""
    d1 = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64)
    d2 = np.array([int(mix(s ^ _GOLD).sum(dtype=np.uint64)) for s in sets], np.uint64)
    return pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))


def _signature_batches(k: int, bands: int, rows: int):
    m = bands * rows
    names = [c.split()[0] for c in _SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, sets in shingle_sets(batch.column(1), k):
                for lo in range(0, len(sets), 128):
                    part = sets[lo : lo + 128]
                    values = super_minhash(part, m)
                    with np.errstate(over="ignore"):
                        keys = mix((values * 2.0**40).astype(np.uint64)) if m else values
                        keys[~np.isfinite(values)] = 0
                        folded = np.zeros((len(part), bands), np.uint64)
                        cells = keys.reshape(len(part), bands, rows)
                        for r in range(rows):
                            folded = mix(folded * _GOLD + cells[:, :, r] + np.uint64(r + 1))
                        n, d1, d2 = _digest(part)
                    low16 = np.ascontiguousarray((keys & np.uint64(0xFFFF)).astype("<u2"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(first + lo, len(part)),
                            batch.column(2).slice(first + lo, len(part)),
                            n,
                            d1,
                            d2,
                            pa.array([row.tobytes() for row in low16], pa.binary()),
                            pa.ListArray.from_arrays(
                                pa.array(np.arange(len(part) + 1) * bands, pa.int32()), pa.array(folded.view(np.int64).ravel())
                            ),
                        ],
                        names=names,
                    )

    return run


_SIGNED = "doc_id bigint, h bigint, n_shingles bigint, d1 bigint, d2 bigint, signature binary, bands array<bigint>"


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (of the text), n_shingles, digest (d1, d2), 16 bits of each signature component, band keys."""
    rows_of = pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows_of.mapInArrow(lean(_signature_batches(k, bands, rows)), _SIGNED)


def _sift(threshold: int, min_equal: int):
    """Drop pairs whose sizes or signatures rule the similarity out; one row per pair of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.asarray(batch.column(i), np.int64) for i in (2, 3))
            small, large = np.minimum(a, b), np.maximum(a, b)
            ok = 100 * small >= threshold * large
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(len(a), -1) for i in (4, 5))
            ok &= (sa == sb).sum(axis=1) >= min_equal
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


_COLUMNS = 1024  # shingles that are multiplied out at a time


def _similar(left: list[np.ndarray], right: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which left and right sets are similar, as a table of flags.

    Only shingles that both sides have are multiplied out, ``_COLUMNS`` at a time, so memory goes with
    the number of sets on the sides.
    """
    sizes = [np.array([len(x) for x in part], np.int64) for part in (left, right)]
    values = [np.concatenate(part) for part in (left, right)]
    common = np.intersect1d(*(np.unique(v) for v in values), assume_unique=True)
    cells = []
    for v, size in zip(values, sizes, strict=True):
        at = np.minimum(np.searchsorted(common, v), max(0, len(common) - 1))
        hit = common[at] == v if len(common) else np.zeros(len(v), bool)
        row, col = np.repeat(np.arange(len(size)), size)[hit], at[hit]
        order = np.argsort(col, kind="stable")
        cells.append((row[order], col[order]))
    both = np.zeros((len(left), len(right)), np.float32)
    bits = [np.zeros((len(part), _COLUMNS), np.float32) for part in (left, right)]
    for lo in range(0, len(common), _COLUMNS):
        for (row, col), flags in zip(cells, bits, strict=True):
            flags[:] = 0
            i, j = np.searchsorted(col, [lo, lo + _COLUMNS])
            flags[row[i:j], col[i:j] - lo] = 1
        both += bits[0] @ bits[1].T
    # 100 * both >= threshold * (left + right - both); sizes and counts are exact in these types
    return (100 + threshold) * both.astype(np.float64) >= threshold * (sizes[0][:, None] + sizes[1][None, :])


def _confirm(threshold: int):
    """Links of the components that the similar sets of each block pair make.

    Rows come sorted by their key (cluster, left block, right block) and hold node,
    side (0 left, 1 right, 2 both) and set. What goes out is a star for each component of the block pair's
    links, one row a node, and not the pairs.
    """

    def links(nodes: list[int], sides: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        left = np.array([i for i, x in enumerate(sides) if x != 1], int)
        right = np.array([i for i, x in enumerate(sides) if x != 0], int)
        if not len(left) or not len(right):
            return []
        similar = _similar([sets[i] for i in left], [sets[i] for i in right], threshold)
        new = np.ones(len(nodes), bool)
        out = []
        for seed in left[similar.any(axis=1)]:
            if not new[seed]:
                continue
            new[seed] = False
            front = np.zeros(len(nodes), bool)
            front[seed] = True
            while front.any():
                reached = np.zeros(len(nodes), bool)
                reached[right] |= similar[front[left]].any(axis=0)
                reached[left] |= similar[:, front[right]].any(axis=1)
                front = reached & new
                new &= ~front
                out += [(nodes[seed], nodes[i]) for i in np.flatnonzero(front)]
        return out

    def table(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, ([], [], [])
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for (*at, node, side), blob in zip(zip(*columns, strict=True), batch.column(5), strict=True):
                if at != key:
                    if len(rows[0]) > 1:
                        out += links(*rows)
                    key, rows = at, ([], [], [])
                rows[0].append(node)
                rows[1].append(side)
                rows[2].append(np.frombuffer(blob.as_py(), "<u8"))
            yield table(out)
        if len(rows[0]) > 1:
            yield table(links(*rows))

    return run


def _stored_sets(k: int):
    """Rows text to (digest, set), for texts looked up by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), k):
                with np.errstate(over="ignore"):
                    n, d1, d2 = _digest(sets)
                blobs = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([n, d1, d2, blobs], names=["n_shingles", "d1", "d2", "items"])

    return run


def candidate_clusters(ws: Workspace, heads: DataFrame, threshold: int, min_equal: int, max_rounds: int = 40) -> DataFrame:
    """node, cluster: any two nodes that share a band and pass the sift are in one cluster.

    A bucket of more than ``CROWD`` nodes is in one cluster as it is. No smaller one is multiplied
    out either: a pivot is compared with the bucket's other members, on signatures only. Buckets
    whose members are not all in one cluster by then go on, with more pivots each round, until each
    pair was compared or shares a cluster.
    """
    facts = heads.select("node", "n_shingles", "signature")
    exploded = heads.select("node", F.posexplode("bands").alias("band", "key")).select(
        "node", F.xxhash64("band", "key").alias("bucket")
    )
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a")).where("n > 1")
    shared = ws.keep(shared, "shared")
    placed = ws.keep(join_spread(exploded, shared, ["bucket"], "n", exploded.count()), "in_buckets")
    edges = placed.where((F.col("n") > CROWD) & (F.col("a") != F.col("node"))).select("a", F.col("node").alias("b")).distinct()
    edges = ws.keep(edges, "crowds")
    cluster = connected_components(edges)
    members = placed.where(F.col("n") <= CROWD).select("bucket", "node")
    for n in range(max_rounds):
        placed = members.join(cluster, "node", "left").select("bucket", "node", F.coalesce("component_id", "node").alias("c"))
        mixed = placed.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("bucket")
        placed = ws.keep(placed.join(mixed, "bucket"), f"placed{n}")
        if placed.isEmpty():
            return cluster.withColumnRenamed("component_id", "cluster")
        crowd = placed.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("in_c"))
        # one pivot for each of 8**n parts of a bucket, from its smallest cluster, else by a hash of
        # bucket and node, so that the bands of a group have different ones
        pivots = (
            placed.join(crowd, ["bucket", "c"])
            .groupBy("bucket", F.pmod(F.xxhash64("node", "bucket", F.lit(n)), F.lit(8**n)).alias("part"))
            .agg(F.min(F.struct("in_c", F.xxhash64("bucket", "node").alias("turn"), "node", "c")).alias("p"))
            .select("bucket", F.col("p.node").alias("p"), F.col("p.c").alias("pc"))
        )
        pivots = ws.keep(pivots, f"pivots{n}")
        pairs = (
            placed.join(pivots, "bucket")
            .where("c <> pc")
            .select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))
            .distinct()
        )
        fa = facts.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
        fb = facts.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
        likely = (
            pairs.join(fa, "a")
            .join(fb, "b")
            .select("a", "b", "na", "nb", "sa", "sb")
            .mapInArrow(_sift(threshold, min_equal), "a bigint, b bigint")
        )
        likely = ws.keep(likely, f"likely{n}")
        done = pivots.select("bucket", F.col("p").alias("node"))
        members = ws.keep(placed.select("bucket", "node").join(done, ["bucket", "node"], "left_anti"), f"members{n + 1}")
        if not likely.isEmpty():
            edges = edges.unionByName(likely)
            cluster = connected_components(edges)
    raise RuntimeError(f"buckets were not compared in {max_rounds} rounds")


def _links(ws: Workspace, sets: DataFrame, left: DataFrame, right: DataFrame, threshold: int, name: str) -> DataFrame:
    """Confirmed links between left and right nodes of a cluster.

    Both frames have cluster, node, block and blocks (their number in the cluster, for the
    frame). Each left block meets each right block once, in a task that holds these two only.
    """
    spans = right.groupBy("cluster").agg(F.max("blocks").alias("other"))
    l_rows = left.join(spans, "cluster").select(
        "cluster", F.col("block").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("other") - 1)).alias("rb"), "node", F.lit(0).alias("side")
    )
    spans = left.groupBy("cluster").agg(F.max("blocks").alias("other"))
    r_rows = right.join(spans, "cluster").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("other") - 1)).alias("lb"), F.col("block").alias("rb"), "node", F.lit(1).alias("side")
    )
    rows = (
        l_rows.unionByName(r_rows)
        .groupBy("cluster", "lb", "rb", "node")
        # on both sides of its block pair: 2
        .agg(F.when(F.count(F.lit(1)) > 1, F.lit(2)).otherwise(F.max("side")).alias("side"))
        .join(sets, "node")
        .select("cluster", "lb", "rb", "node", "side", "items")
        .repartition("cluster", "lb", "rb")
        .sortWithinPartitions("cluster", "lb", "rb", "node")
    )
    return ws.keep(rows.mapInArrow(lean(_confirm(threshold)), "a bigint, b bigint"), name)


def _grouped(ws: Workspace, docs: DataFrame, k: int, threshold: int, bands: int, rows: int, block_items: int, block_nodes: int) -> DataFrame:
    """doc_id, h, n_shingles of every row, with its set's group (null if alone) and the smallest doc_id there."""
    m = bands * rows
    share = threshold / 100
    min_equal = int(m * share - 5.5 * (m * share * (1 - share)) ** 0.5)
    node = F.xxhash64("n_shingles", "d1", "d2").alias("node")
    signed = ws.keep(signatures(docs, k, bands, rows).withColumn("node", node), "signed")
    # equal sets are one node from here on
    heads = ws.keep(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", "bands"))),
        "heads",
    )
    clusters = candidate_clusters(ws, heads, threshold, min_equal)
    placed = clusters.join(heads.select("node", "rep", "n_shingles"), "node")
    size = placed.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / block_items), F.ceil(F.count(F.lit(1)) / block_nodes)).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = ws.keep(placed.join(size, "cluster").withColumn("block", block), "clusters")
    sets = ws.keep(
        pick(docs, "doc_id", "text")
        .join(placed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select("text")
        .mapInArrow(_stored_sets(k), "n_shingles bigint, d1 bigint, d2 bigint, items binary")
        .select(node, "items")
        .groupBy("node")
        .agg(F.first("items").alias("items")),
        "sets",
    )
    layout = placed.select("cluster", "node", "block", "blocks")
    # the first block of every cluster meets all of it; most clusters have no other
    first = layout.where("block = 0").withColumn("blocks", F.lit(1))
    links = _links(ws, sets, first, layout, threshold, "links0")
    large = layout.where("blocks > 1")
    if not large.isEmpty():
        # then what is outside its cluster's largest component by now meets the rest
        so_far = large.join(connected_components(links), "node", "left").select(
            "cluster", "node", "block", "blocks", F.coalesce("component_id", "node").alias("c")
        )
        so_far = ws.keep(so_far, "so_far")
        largest = (
            so_far.groupBy("cluster", "c")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("cluster")
            .agg(F.max(F.struct("n", "c")).alias("top"))
            .select("cluster", F.col("top.c").alias("c"))
        )
        apart = so_far.where("block > 0").join(largest, ["cluster", "c"], "left_anti").select("cluster", "node", "block", "blocks")
        links = links.unionByName(_links(ws, sets, apart, large.where("block > 0"), threshold, "links1"))
    component = connected_components(links)
    reps = heads.select("node", "rep").join(component, "node", "left")
    tops = reps.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min("rep").alias("top"))
    named = reps.join(tops, "component_id", "left").select("node", F.coalesce("component_id", "node").alias("g"), F.coalesce("top", "rep").alias("top"))
    named_row = F.col("doc_id").isNotNull()
    return signed.select("doc_id", "h", "n_shingles", "node").join(named, "node", "left").select(
        "doc_id", "h", "n_shingles", F.when(named_row, F.col("g")).alias("g"), F.when(named_row, F.coalesce("top", "doc_id")).alias("top")
    )


def near_duplicates(
    docs: DataFrame, k: int = 5, threshold: int = 80, bands: int = 36, rows: int = 5, block_items: int = 200_000, block_nodes: int = 2_000
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; ``threshold`` is a percentage.

    A task holds two blocks at a time, each of about ``block_items`` shingles over all its sets and
    of about ``block_nodes`` sets at most.
    """
    ws = Workspace(docs.sparkSession, "near-dedup")
    grouped = _grouped(ws, docs, k, threshold, bands, rows, block_items, block_nodes)
    return ws.result(grouped.select("doc_id", "n_shingles", F.col("top").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept")))


def drop_near_duplicates(
    docs: DataFrame, k: int = 5, threshold: int = 80, bands: int = 36, rows: int = 5, block_items: int = 200_000, block_nodes: int = 2_000
) -> DataFrame:
    """The columns of documents, one document of each group: that of the smallest doc_id, then of the smallest hash of its text.

    A document is a doc_id with a text: of rows that are equal in both one stays, and rows with one doc_id and
    unlike texts all stay. Rows with a null doc_id or without words all stay.
    """
    ws = Workspace(docs.sparkSession, "drop-near")
    base = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    grouped = ws.keep(_grouped(ws, base, k, threshold, bands, rows, block_items, block_nodes).where("g IS NOT NULL").select("doc_id", "h", "g"), "grouped")
    first = grouped.groupBy("g").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    # what is to go, and rows that repeat, without their texts; written, so that texts are only shuffled where these are too many to be broadcast
    odd = (
        grouped.join(first, "g")
        .groupBy(F.xxhash64("doc_id", "h").alias("k"))
        .agg(F.bool_or(F.expr("first <> struct(doc_id, h)")).alias("gone"), F.count(F.lit(1)).alias("n"))
        .where("gone OR n > 1")
    )
    marked = base.withColumn("k", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.xxhash64("text")))).join(ws.keep(odd, "odd"), "k", "left")
    once = marked.where("n IS NULL").unionByName(marked.where("n > 1 AND NOT gone").dropDuplicates(["k"]))
    return ws.result(once.select("doc_id", "text", "lang", "source", "n_chars"))
