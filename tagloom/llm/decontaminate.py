"""Benchmark decontamination with spaced seeds and substitution-tolerant verification.

Fixed masks pick the word positions of a window that are hashed, so a window that
differs from a benchmark item at ignored positions still has the item's hash. Seed
hashes of the test items and of the training texts are joined; around each hit the
aligned words are compared, and the pair counts as overlap if, along that
alignment, a run of at least ``min(item words, window)`` words has at least
``min_same`` percent of equal words. Items of seven and eight words may differ in one word only and
shorter ones in none, as further substitutions there leave too often no place for any mask (tests hold the masks to
nine of ten for every length).

Training texts are read once. Their seeds are sifted in the reading tasks by a
bit table of the test seeds, two bits per seed in 2**26 bits: its size (8 MB) does not
depend on either table, and a larger benchmark only lets more seeds through to
the join, which decides. Documents with a surviving seed go on with their seeds
and word hashes; the others end there.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and ASCII punctuation at both ends
left out. Items shorter than the shortest mask are found as whole items if the text
has exactly their words at a run.

Edge cases: null or empty texts hit nothing. Null ids stay null in the result. A
repeated row gives its hits again only if its text differs (rows of the same doc_id
and text count once). Equal items are each reported. Empty tables give an empty
result. A very long text is read whole, and each of its runs goes on by itself. Of stretches that are equally equal, the one in
the most words and then at the earliest place is told. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick
from .text_arrays import Pieces, mix, ngrams, text_chunks, words

# fixed values: spaced-seed masks, 1 for a position that is hashed (weight 5, span 5 to 9)
MASKS = ("11111", "111011", "110111", "1101011", "1110101", "1011011", "11001101", "10110011", "110100011")
WINDOW = 24
MIN_SAME = 75
MIN_WORDS = 8  # of an item whose overlap removes a document
EXACT_BELOW = 7  # words of an item that has to be met in all of them
ONE_BELOW = 9  # words of an item that may differ in one
_BITS = 26


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seeds(w: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text index, word position in the text, hash of every seed."""
    text, pos, out = [], [], []
    for number, mask in enumerate(MASKS):
        at, h = ngrams(w, _offsets(mask))
        text.append(w.text[at])
        pos.append(at - w.bounds[w.text[at]])
        out.append(mix(h + np.uint64(number)))
    return np.concatenate(text), np.concatenate(pos), np.concatenate(out)


def _short_seeds(w: Pieces, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, h = ngrams(w, range(length))
    return w.text[at], at - w.bounds[w.text[at]], mix(h + np.uint64(1000 + length))


_SHORTEST = min(len(m) for m in MASKS)
_LONGEST = max(len(m) for m in MASKS)
_ITEM_SCHEMA = "rid bigint, id bigint, pos array<int>, seed array<bigint>, words binary"
_RUN_SCHEMA = "run bigint, k bigint, id bigint, start bigint, before int, pos array<int>, seed array<bigint>, words binary"


def _by_text(texts: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((columns[1], columns[0], texts))
    return texts[order], *(c[order] for c in columns)


def _lists(starts: np.ndarray, pos: np.ndarray, seeds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    offsets = pa.array(np.append(starts, len(pos)), pa.int32())
    return (
        pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32))),
        pa.ListArray.from_arrays(offsets, pa.array(seeds.view(np.int64))),
    )


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column(2)):
            w = words(chunk, lower=True, bare=True)
            n = np.diff(w.bounds)
            text, pos, seeds = _seeds(w)
            parts = [(text, pos, seeds)]
            for length in range(1, _SHORTEST):
                t, p, s = _short_seeds(w, length)
                own = n[t] == length
                parts.append((t[own], p[own], s[own]))
            text, pos, seeds = (np.concatenate(x) for x in zip(*parts, strict=True))
            text, pos, seeds = _by_text(text, pos, seeds)
            own, starts = np.unique(text, return_index=True)
            blobs = [w.hashes[w.bounds[i] : w.bounds[i + 1]].astype("<u8").tobytes() for i in own]
            at = pa.array(own + chunk.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *_lists(starts, pos, seeds), pa.array(blobs, pa.binary())],
                names=["rid", "id", "pos", "seed", "words"],
            )


def _slots(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bit positions of a seed."""
    return (seeds >> np.uint64(64 - _BITS)).astype(np.int64), (mix(seeds) >> np.uint64(64 - _BITS)).astype(np.int64)


def _bit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            seeds = np.asarray(batch.column(0), np.int64).view(np.uint64)
            bits = np.unique(np.concatenate(_slots(seeds)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"]
            )


def _document_runs(table, short_lengths: list[int], window: int):
    """Runs of surviving seeds at neighbouring positions, with the words around them.

    A run's key is a hash of its seeds and their places in it, so a passage that many
    documents share is the same run in all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value.view(np.uint64)

        def there(at: np.ndarray) -> np.ndarray:
            return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                w = words(chunk, lower=True, bare=True)
                parts = []
                for one in [None, *short_lengths]:
                    t, p, s = _seeds(w) if one is None else _short_seeds(w, one)
                    a, b = _slots(s)
                    hit = there(a)
                    hit[hit] = there(b[hit])
                    parts.append((t[hit], p[hit], s[hit]))
                text, pos, seeds = _by_text(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                if not len(text):
                    continue
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (pos[1:] > pos[:-1] + 1)
                starts = np.flatnonzero(new)
                first = pos[starts]
                inside = pos - np.repeat(first, np.diff(np.append(starts, len(pos))))
                keys = np.add.reduceat(mix(seeds + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)
                own = text[starts]
                last = pos[np.append(starts[1:], len(pos)) - 1]
                lo = np.maximum(0, first - window)
                hi = np.minimum(w.bounds[own + 1] - w.bounds[own], last + _LONGEST + window)
                blobs = [w.hashes[i:j].astype("<u8").tobytes() for i, j in zip(w.bounds[own] + lo, w.bounds[own] + hi, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.view(np.int64)),
                        batch.column(2).take(pa.array(own + chunk.first)),
                        batch.column(0).take(pa.array(own + chunk.first)),
                        pa.array(first),
                        pa.array((first - lo).astype(np.int32)),
                        *_lists(starts, inside, seeds),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["run", "k", "id", "start", "before", "pos", "seed", "words"],
                )

    return run


def least_same(length: int, min_same: int = MIN_SAME) -> int:
    """How many words of a stretch of ``length`` have to be equal."""
    least = -(-min_same * length // 100)
    return max(least, length - (0 if length < EXACT_BELOW else 1)) if length < ONE_BELOW else least


def best_run(same: np.ndarray, length: int) -> tuple[int, int]:
    """Start of the window of ``length`` flags with the most set, and their number."""
    total = np.concatenate([[0], np.cumsum(same)])
    counts = total[length:] - total[:-length]
    at = int(np.argmax(counts))
    return at, int(counts[at])


def _verify(window: int, min_same: int):
    """For a run of seeds and an item: the best stretch along one of the alignments, if it is equal enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, id_, item, start, before, shifts, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, test = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                need = min(len(test), window)
                best = None
                for shift in sorted(shifts):
                    shift += before  # place of the item's first word among the words around the run
                    lo, hi = max(0, -shift), min(len(test), len(doc) - shift)
                    if hi - lo < need:
                        continue
                    at, n = best_run(test[lo:hi] == doc[lo + shift : hi + shift], need)
                    if n >= least_same(need, min_same) and (best is None or n > best[3]):
                        best = (start - before + lo + at + shift, lo + at, need, n)
                if best:
                    out.append((key, id_, item, *best))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)],
                names=["k", "doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"],
            )

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_same: int = MIN_SAME) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words, n_same: one row per contaminated pair.

    It tells the pair's best run: the word positions where it starts, its words, and how many of them are equal.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    best = F.max(F.struct("n_same", "n_words", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("b")
    return ws.result(
        _pairs(ws, docs, benchmark, window, min_same)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id", "item_id", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), "b.n_words", "b.n_same"
        )
    )


def _pairs(ws: Workspace, docs: DataFrame, benchmark: DataFrame, window: int, min_same: int) -> DataFrame:
    """k (hash of doc_id and text) and the columns of ``overlaps``, for every verified run and item."""
    spark = docs.sparkSession
    types = {"doc_id": "bigint", "item_id": "bigint", "text": "string"}
    items = pick(benchmark, "item_id", "text", types=types).select(
        F.xxhash64("item_id", "text").alias("rid"), F.col("item_id").alias("id"), "text"
    )
    items = ws.keep(items.mapInArrow(_item_seeds, _ITEM_SCHEMA), "items")
    set_words = (
        items.select(F.explode("seed").alias("seed"))
        .mapInArrow(_bit_words, "word bigint, bits bigint")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toPandas()  # at most 2**20 rows, whatever the tables' sizes
    )
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    bits[set_words["word"].to_numpy(np.int64)] = set_words["bits"].to_numpy(np.int64)
    short = items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(F.col("n") < _SHORTEST).distinct()
    lengths = sorted(r.n for r in short.collect())  # fewer than the length of the shortest mask
    table = spark.sparkContext.broadcast(bits)
    found = ws.keep(
        pick(docs, "doc_id", "text", types=types)
        .select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
        .mapInArrow(_document_runs(table, lengths, window), _RUN_SCHEMA),
        "found",
    )
    table.destroy()
    # each different run meets the items once, however many documents have it
    runs = found.groupBy("run").agg(F.first("pos").alias("pos"), F.first("seed").alias("seed"))

    def flat(df: DataFrame, key: str, at: str) -> DataFrame:
        return df.select(key, F.explode(F.arrays_zip("pos", "seed")).alias("x")).select(
            key, F.col("x.pos").alias(at), F.col("x.seed").alias("seed")
        )

    hits = (
        flat(runs, "run", "dp")
        .join(flat(items, "rid", "ip"), "seed")
        .groupBy("run", "rid")
        .agg(F.collect_set(F.col("dp") - F.col("ip")).alias("shifts"))
    )
    hits = ws.keep(hits, "hits")
    item_words = items.select("rid", F.col("id").alias("item"), F.col("words").alias("item_words"))
    return (
        found.select("run", "k", "id", "start", "before", "words")
        .join(hits, "run")
        .join(item_words, "rid")
        .select("k", "id", "item", "start", "before", "shifts", "words", "item_words")
        .mapInArrow(
            _verify(window, min_same),
            "k bigint, doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_words bigint, n_same bigint",
        )
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_same: int = MIN_SAME, min_words: int = MIN_WORDS
) -> DataFrame:
    """The columns of documents, without the documents that overlap an item of ``min_words`` words or more.

    A document is a doc_id, null or not, with a text. Shorter items are everyday phrases: ``overlaps`` reports
    them, but they remove nothing.
    """
    ws = Workspace(docs.sparkSession, "decontaminated")
    base = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    bad = _pairs(ws, base, benchmark, window, min_same).where(F.col("n_words") >= min_words).select("k").distinct()
    bad = ws.keep(bad, "bad")  # its size is known then, and texts are only shuffled where it is large
    return ws.result(base.withColumn("k", F.xxhash64("doc_id", "text")).join(bad, "k", "left_anti").drop("k"))
