"""Quality rules: base counts of words and lines, and byte n-gram perplexity bands per language.

The language model is an interpolated modified Kneser-Ney model (Chen and Goodman,
1999) over the UTF-8 bytes of the texts, of order 5, one per language. White
space is one blank byte and A-Z are lower-cased for the model. All n-grams of all
texts are counted in Spark: tasks send the distinct n-grams of their texts
with counts. Lower orders, their
continuation counts and discounts are derived from the counted
table by groupings on n-grams, which are integers of at most 5 bytes.

A text is scored by the counts of all other texts: its own n-grams, and those of its exact
copies, are subtracted at every order, and what is then unseen backs off; so a text that
only repeats itself is not expected. The discounts are those of the whole language.

The counts of every order lie in sorted arrays, whatever their size: Spark sorts them into files in the
shared folder, and an executor copies them from there once, into its own Spark folder; its tasks map this copy
into memory and look n-grams up by bisection, so a task holds no table of its own and a new executor makes
a new copy. The tasks read the shared folder as Arrow does (file, hdfs, s3 and gs addresses).

A document's verdict compares its log perplexity with a lower and an upper bound
of its language, the quartiles ``width`` quartile distances out, from the exact
histogram of all documents of the language in steps of a thousandth.

Edge cases: a null text has no words and fails the base rules; its lang does not
matter. A null lang is a language of its own. Every row comes back, repeated rows and null ids too.
Ties don't matter: equal texts of a language get equal scores. A very long text is read whole, as a chunk
of its own. Empty tables give empty results. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import Workspace, lean, pick
from .text_arrays import SPACE, Chunk, lines, mix, ngrams, text_chunks, words

ORDER = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words in repeated windows
WIDTH = 6.0
_FILE_ROWS = 4_000_000  # of the sorted counts in one file

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_PAD = 2
_MODEL_BYTE = np.arange(256, dtype=np.uint8)
_MODEL_BYTE[65:91] += 32
_MODEL_BYTE[:33] = 32
_FOLD = _MODEL_BYTE.tobytes()


def repeated_words(text_of: np.ndarray, at: np.ndarray, hashes: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Flags of the words that lie in a window of ``size`` words found twice or more in its text."""
    key = mix(hashes + text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    same = key[order][1:] == key[order][:-1]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n_words + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + size, -1)
    return np.cumsum(cover)[:n_words] > 0


def base_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = words(chunk, lower=False)
    n = len(chunk)
    data = chunk.data
    starts_char = (data & 0xC0) != 0x80
    at, h = ngrams(w, range(5))
    flags = repeated_words(w.text, at, h, 5, len(w.starts))
    l = lines(chunk)
    with_word = np.searchsorted(w.starts, l.ends) > np.searchsorted(w.starts, l.starts)
    key = mix(l.hashes + l.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[with_word]
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return {
        "n_words": np.diff(w.bounds),
        "word_chars": chunk.per_text(starts_char & ~SPACE[data]),
        "n_symbols": chunk.per_text(_SYMBOL[data]),
        "n_dup_lines": np.bincount(l.text[with_word][later], minlength=n),
        "n_repeat_words": np.bincount(w.text[flags], minlength=n),
    }


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column(1)):
            c = base_counts(chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, len(chunk)), *(pa.array(x.astype(np.int64)) for x in c.values())],
                names=["doc_id", *c],
            )


def _grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """All ORDER-grams of a chunk as integers, and the text of each: a byte with its predecessors, padded at the start."""
    raw = chunk.data.tobytes().translate(_FOLD)
    pad = bytes([_PAD]) * (ORDER - 1)
    joined = np.frombuffer(pad + pad.join(raw[a:b] for a, b in zip(chunk.starts, chunk.ends, strict=True)), np.uint8)
    gram = np.zeros(len(joined) - ORDER + 1, np.int64)
    for i in range(ORDER):
        gram = (gram << 8) | joined[i : len(joined) - ORDER + 1 + i]
    real = joined[ORDER - 1 :] != _PAD
    return gram[real], np.repeat(np.arange(len(chunk)), chunk.ends - chunk.starts)


def _by_language(batch: pa.RecordBatch, text: int, lang: int) -> Iterator[tuple[str | None, np.ndarray, pa.Array]]:
    codes = batch.column(lang).dictionary_encode()
    index = np.asarray(codes.indices.fill_null(-1))
    for code in np.unique(index):
        rows = np.flatnonzero(index == code)
        yield (None if code < 0 else codes.dictionary[int(code)].as_py()), rows, batch.column(text).take(pa.array(rows))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


_FLUSH = 1_000_000
_GRAM_BYTES = 1 << 18  # of text at a time: a byte becomes an n-gram in some twenty arrays


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: distinct n-grams with counts, combined over the batches of a task up to a bounded table."""
    tables: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(lang: str | None) -> Iterator[pa.RecordBatch]:
        keys, counts = _merge(tables.pop(lang))
        for i in range(0, len(keys), 200_000):
            k = keys[i : i + 200_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(counts[i : i + 200_000])], names=["lang", "gram", "n"]
            )

    for batch in batches:
        for lang, _, texts in _by_language(batch, 0, 1):
            for chunk in text_chunks(texts, _GRAM_BYTES):
                gram = np.sort(_grams(chunk)[0])
                if not len(gram):
                    continue
                first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
                parts = tables.setdefault(lang, [])
                parts.append((gram[first], np.diff(np.append(first, len(gram)))))
                if sum(len(k) for k, _ in parts) > _FLUSH:
                    tables[lang] = [_merge(parts)]
                    if len(tables[lang][0][0]) > _FLUSH // 2:
                        yield from out(lang)
    for lang in list(tables):
        yield from out(lang)


def _orders(ws: Workspace, counts: DataFrame) -> DataFrame:
    """k, lang, g, n of the n-grams of every order: below the highest, n is the number of different bytes before the gram."""
    level = counts.select("lang", F.col("gram").alias("g"), "n")
    every = level.select(F.lit(ORDER).alias("k"), "lang", "g", "n")
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << (8 * k)) - 1
        level = ws.keep(level.groupBy("lang", F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count(F.lit(1)).alias("n")), f"order{k}")
        every = every.unionByName(level.select(F.lit(k).alias("k"), "lang", "g", "n"))
    return every


def _discounts(seen: list[int]) -> np.ndarray:
    """Discounts of counts 0 to 3 and more, from the numbers of grams counted once to four times."""
    n1, n2 = seen[:2]
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = [0.0]
    for i in (1, 2, 3):
        d = i - (i + 1) * y * seen[i] / seen[i - 1] if seen[i - 1] else i * 0.5
        out.append(max(0.05, min(i - 0.05, d)) if seen[i - 1] else d)
    return np.array(out)


class Model:
    """Sorted n-grams with counts, and sorted contexts with sums, of every order and language.

    ``grams`` has the columns g, n and ``contexts`` ctx, total, c1, c2, c3 (numbers of its grams counted once, twice,
    more often); ``places`` tells for an order and a language where its grams and contexts begin and end, and
    its discounts.
    """

    def __init__(self, grams: dict[str, np.ndarray], contexts: dict[str, np.ndarray], places: dict):
        self.grams, self.contexts, self.places = grams, contexts, places

    def of(self, k: int, lang: str | None, grams: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Counts of grams; total and numbers of grams counted once, twice, more often of contexts; discounts. All were counted."""
        (a, b), (c, d), discounts = self.places[k, lang]
        own = a + np.searchsorted(self.grams["g"][a:b], grams)
        at = c + np.searchsorted(self.contexts["ctx"][c:d], contexts)
        return self.grams["n"][own], [self.contexts[x][at] for x in ("total", "c1", "c2", "c3")], discounts


_GRAMS = ("g", "n")
_CONTEXTS = ("ctx", "total", "c1", "c2", "c3")


def _mapped(paths: list[str], columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The columns of files in the shared folder, one after the other, mapped from a copy that this executor's tasks share."""
    name = hashlib.sha256(" ".join(paths).encode()).hexdigest()[:32]
    folder = os.path.join(SparkFiles.getRootDirectory(), f"arrays-{name}")
    with open(f"{folder}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(folder):
            os.makedirs(f"{folder}.part", exist_ok=True)
            with contextlib.ExitStack() as opened:
                outs = [opened.enter_context(open(f"{folder}.part/{c}", "wb")) for c in columns]
                for path in paths:
                    system, place = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
                    with system.open_input_file(place) as source:
                        for batch in pq.ParquetFile(source).iter_batches(columns=list(columns)):
                            for c, out in zip(columns, outs, strict=True):
                                out.write(np.ascontiguousarray(batch.column(c), np.int64))
            os.rename(f"{folder}.part", folder)
    return {c: np.memmap(f"{folder}/{c}", np.int64, "r") if os.path.getsize(f"{folder}/{c}") else np.zeros(0, np.int64) for c in columns}


def _hand_out(ws: Workspace, rows: DataFrame, key: str, name: str) -> tuple[list[str], list[Row]]:
    """Sort rows (k, lang, a key and numbers) into shared files: their addresses in order, and the rows of every order and language."""
    rows = ws.keep(rows, f"{name}-rows")
    sizes = rows.groupBy("k", "lang").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(rows.columns[3]) == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
    sizes = sizes.orderBy("k", "lang").collect()  # a row per order and language
    files = -(-sum(r.n for r in sizes) // _FILE_ROWS)
    order = ("k", "lang", key)
    ordered = ws.keep(rows.repartitionByRange(max(1, files), *order).sortWithinPartitions(*order), name)
    return sorted(ordered.inputFiles(), key=lambda path: path.rsplit("/", 1)[1]), sizes


def _model(ws: Workspace, counts: DataFrame) -> tuple[list[str], list[str], dict]:
    """Addresses of the files of n-grams and of contexts, and the places of orders and languages in them."""
    orders = ws.keep(_orders(ws, counts), "orders")
    grams, sizes = _hand_out(ws, orders.select("k", "lang", "g", "n"), "g", "grams")
    sums = orders.groupBy("k", "lang", F.shiftright("g", 8).alias("ctx")).agg(
        F.sum("n").alias("total"), *(F.count_if(c).alias(x) for c, x in ((F.col("n") == 1, "c1"), (F.col("n") == 2, "c2"), (F.col("n") > 2, "c3")))
    )
    contexts, spans = _hand_out(ws, sums, "ctx", "contexts")
    places, a, c = {}, 0, 0
    for own, span in zip(sizes, spans, strict=True):
        places[own.k, own.lang] = ((a, a + own.n), (c, c + span.n), _discounts([own.n1, own.n2, own.n3, own.n4]))
        a, c = a + own.n, c + span.n
    return grams, contexts, places


def left_out(text: np.ndarray, gram: np.ndarray, own: np.ndarray, copies: np.ndarray, of) -> np.ndarray:
    """Log probability of every (text, n-gram), under the counts without those of the text and its copies.

    The pairs are different ones, sorted by text and gram; ``own`` is how often a gram is in
    its text, ``copies`` how many rows have the text. ``of(k, grams, contexts)`` gives the counts of order k.
    A gram that only the text had is gone, and no longer counts for its ending in the next lower order.
    """
    keys = (text << (8 * ORDER)) | gram
    gone = own * copies
    steps = []
    for k in range(ORDER, 0, -1):
        mask = (1 << (8 * k)) - 1
        context = keys >> 8 if k > 1 else keys >> 8 << 8
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        group = np.cumsum(np.append(False, context[1:] != context[:-1]))
        n, sums, discounts = of(k, keys & mask, (keys[first] & mask) >> 8)
        left = n - gone
        total = sums[0] - np.add.reduceat(gone, first)
        before, after = np.minimum(n, 3), np.minimum(left, 3)
        mass = np.zeros(len(first))
        for i in (1, 2, 3):
            mass += discounts[i] * (sums[i] + np.add.reduceat((after == i).astype(np.int64) - (before == i), first))
        some = np.maximum(total, 1)
        steps.append(((left - discounts[after]) / some[group], np.where(total > 0, mass / some, 1.0)[group]))
        if k > 1:
            # to the grams without their first byte
            short = ((keys >> (8 * k)) << (8 * (k - 1))) | (keys & ((1 << (8 * (k - 1))) - 1))
            order = np.argsort(short)
            ordered = short[order]
            fresh = np.append(True, ordered[1:] != ordered[:-1])
            back = np.empty(len(short), np.int64)
            back[order] = np.cumsum(fresh) - 1
            keys = ordered[fresh]
            gone = np.bincount(back, left == 0, minlength=len(keys)).astype(np.int64)
            steps[-1] += (back,)
    p = steps[-1][0] + steps[-1][1] / 256.0
    for seen, rest, back in reversed(steps[:-1]):
        p = seen + rest * p[back]
    return np.log(p)


def _pairs(gram: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, gram) in order, and how often each occurs."""
    keys = np.sort((text.astype(np.int64) << (8 * ORDER)) | gram)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, n = keys[first], np.diff(np.append(first, len(keys)))
    return keys >> (8 * ORDER), keys & ((1 << (8 * ORDER)) - 1), n


_SCORES = "doc_id bigint, lang string, log_ppl double, k bigint"


def _score(grams: list[str], contexts: list[str], places: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(_mapped(grams, _GRAMS), _mapped(contexts, _CONTEXTS), places)
        for batch in batches:
            total = np.zeros(batch.num_rows)
            size = np.zeros(batch.num_rows, np.int64)
            copies = np.asarray(batch.column(4), np.int64)
            for lang, rows, texts in _by_language(batch, 1, 2):
                for chunk in text_chunks(texts, _GRAM_BYTES):
                    own = rows[chunk.first : chunk.first + len(chunk)]
                    gram, text = _grams(chunk)
                    if not len(gram):
                        continue
                    text, gram, n = _pairs(gram, text)
                    logp = left_out(text, gram, n, copies[own][text], lambda k, g, c, lang=lang: model.of(k, lang, g, c))
                    total[own] = np.bincount(text, logp * n, minlength=len(chunk))
                    size[own] = chunk.ends - chunk.starts
            with np.errstate(invalid="ignore", divide="ignore"):
                value = np.where(size > 0, -total / size, np.nan)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(value, mask=size == 0), batch.column(3)],
                names=["doc_id", "lang", "log_ppl", "k"],
            )

    return run


def log_perplexity(ws: Workspace, docs: DataFrame) -> DataFrame:
    """doc_id, lang, log_ppl (per byte, natural log; null without bytes), k (key of the row) for every row.

    A text is scored by the counts of the others: its own are left out, with those of its exact copies.
    """
    rows = pick(docs, "doc_id", "text", "lang").withColumn("k", F.xxhash64("doc_id", "text", "lang"))
    counts = (
        rows.select("text", "lang")
        .mapInArrow(lean(_count), "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    grams, contexts, places = _model(ws, ws.keep(counts, "counts"))
    same = F.xxhash64("text", "lang")
    copied = rows.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = (
        rows.withColumn("same", same)
        .join(ws.keep(copied, "copied"), "same", "left")
        .select("doc_id", "text", "lang", "k", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
    )
    return rows.mapInArrow(lean(_score(grams, contexts, places)), _SCORES)


def perplexity_bands(scores: DataFrame, width: float = WIDTH) -> DataFrame:
    """lang, low, high: quartiles of log perplexity, ``width`` quartile distances out (0.05 at least)."""
    steps = scores.where("log_ppl IS NOT NULL").groupBy("lang", F.round(F.col("log_ppl") * 1000).cast("int").alias("step")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bands = steps.groupBy("lang").agg(
        F.percentile("step", F.lit(0.25), F.col("n")).alias("q1"), F.percentile("step", F.lit(0.75), F.col("n")).alias("q3")
    )
    reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(50.0)) * width
    return bands.select(
        F.col("lang").alias("bl"), ((F.col("q1") - reach) / 1000).alias("low"), ((F.col("q3") + reach) / 1000).alias("high")
    )


def quality_rules(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, log_ppl, k."""
    ws = Workspace(docs.sparkSession, "quality")
    scores = ws.keep(log_perplexity(ws, docs), "scores")
    bands = perplexity_bands(scores, width)
    verdict = scores.join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("bl")), "left").select(  # a row per language
        "k", "lang", "log_ppl", F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True)).alias("in_band")
    )
    verdict = verdict.groupBy("k").agg(F.first("lang").alias("lang"), F.first("log_ppl").alias("log_ppl"), F.bool_and("in_band").alias("in_band"))
    rows = pick(docs, "doc_id", "text", "lang").withColumn("k", F.xxhash64("doc_id", "text", "lang"))
    base = rows.select("k", "text", "doc_id").mapInArrow(
        lean(_base_with_id),
        "k bigint, doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return ws.result(
        base.join(verdict, "k")
        .withColumn("base_failed", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & F.col("in_band")).alias("kept"), "lang", "log_ppl", "k",
        )
    )


def _base_with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for out in _base([batch]):
            ids = batch.column(2).slice(at, out.num_rows)
            at += out.num_rows
            yield pa.RecordBatch.from_arrays([out.column(0), ids, *out.columns[1:]], names=["k", "doc_id", *out.schema.names[1:]])


def keep_good(docs: DataFrame) -> DataFrame:
    """The columns of documents, of the documents that the rules keep."""
    base = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    ws = Workspace(docs.sparkSession, "quality-kept")
    # written, so that texts are only shuffled where these are too many to be broadcast
    bad = ws.keep(quality_rules(base).where("NOT kept").select("k").distinct(), "bad")
    return base.join(bad, F.xxhash64(base["doc_id"], base["text"], base["lang"]) == bad["k"], "left_anti")
