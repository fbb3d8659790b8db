"""Language identification by a byte convolutional network, in numpy.

Filters of several widths slide over the bytes of a fixed-length window; their
outputs are max-pooled over the window and a softmax over the languages follows. A
filter of width w is a table of 256 rows per offset, so a convolution is w table
look-ups and sums, and training only touches the bytes under each maximum.

Training is one small fit on a bounded sample of labelled rows: for each language the
``train_per_language`` rows that come first by a hash. Counts of hash ranges tell how far these reach, so only
rows in reach are ranked; from each the tasks cut ``WINDOWS_PER_TEXT`` windows at random places
of its whole text. Scoring cuts every whole text into windows of
``WINDOW`` bytes (overlapping by the widest filter) in the tasks; a text's prediction is
the language of the greatest mean log probability, weighted by window length.

Edge cases: a null text or one without a letter (any character of a letter category; digits, number forms and
signs are none) is ``und`` with score 0. Rows
with a null lang or doc_id are scored but not learned from. Every row comes back, repeated
rows too. Without any row to learn from everything is ``und``. Ties go to the first
language in order. A very long text is scored whole, in chunks of windows. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, pick
from .text_arrays import text_chunks

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
TRAIN_PER_LANGUAGE = 600
WINDOWS_PER_TEXT = 3

# A-Z lower-cased, white space and digits made blank: they tell nothing about a language
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:33] = 32
_FOLD[48:58] = 32


class ByteNet:
    """Tables of the filters per width, their biases, and the softmax layer."""

    def __init__(self, languages: list[str], rng: np.random.Generator):
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.bias, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray, at: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled, rectified filter outputs of windows (n, WINDOW); with ``at``, where the maxima are."""
        maxima, places = [], []
        for table, bias, width in zip(self.tables, self.bias, WIDTHS, strict=True):
            n = windows.shape[1] - width + 1
            total = table[0][windows[:, :n]]
            for k in range(1, width):
                total += table[k][windows[:, k : k + n]]
            if at:
                place = total.argmax(axis=1)
                places.append(place)
                top = np.take_along_axis(total, place[:, None], axis=1)[:, 0]
            else:
                top = total.max(axis=1)
            maxima.append(np.maximum(top + bias, 0))
        return np.concatenate(maxima, axis=1), places

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows)[0] @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        hidden, places = self.pooled(windows, at=True)
        z = hidden @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p /= len(labels)
        back = (p @ self.out.T) * (hidden > 0)
        tables, biases = [], []
        column = np.arange(FILTERS)
        for i, width in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(self.tables[i])
            for k in range(width):
                byte = np.take_along_axis(windows, places[i] + k, axis=1)
                np.add.at(grad[k], (byte, column[None, :]), g)
            tables.append(grad)
            biases.append(g.sum(axis=0))
        return [*tables, *biases, hidden.T @ p, p.sum(axis=0)]


def cut_windows(text: bytes, rng: np.random.Generator) -> np.ndarray:
    """Folded windows at random places of a text, filled up with blanks."""
    data = _FOLD[np.frombuffer(text, np.uint8)]
    out = np.full((WINDOWS_PER_TEXT, WINDOW), 32, np.uint8)
    for row in out:
        # shorter windows too, as short texts have nothing else
        size = int(rng.choice((WINDOW, WINDOW, WINDOW // 2, WINDOW // 4)))
        start = int(rng.integers(0, max(1, len(data) - size + 1)))
        part = data[start : start + size]
        row[: len(part)] = part
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, turn, windows of labelled rows."""
    for batch in batches:
        cut = [
            cut_windows(text.as_py().encode("utf-8"), np.random.default_rng(turn.as_py() & 0xFFFFFFFF)).tobytes()
            for turn, text in zip(batch.column(1), batch.column(2), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.binary())], names=["lang", "turn", "windows"])


def train(windows: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Fit with Adam on labelled windows."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = ByteNet(languages, rng)
    y = np.array([languages.index(label) for label in labels])
    parameters = net.parameters()
    m = [np.zeros_like(p) for p in parameters]
    v = [np.zeros_like(p) for p in parameters]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        speed = rate * (1 - epoch / epochs) + rate / 20
        for i in range(0, len(y), batch):
            own = order[i : i + batch]
            step += 1
            for p, g, a, b in zip(parameters, net.gradients(windows[own], y[own]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


_STEP = WINDOW - max(WIDTHS) + 1


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: ByteNet | None = shared.value
        for batch in batches:
            n = batch.num_rows
            names, scores = ["und"] * n, np.zeros(n)
            if net is not None:
                for chunk in text_chunks(batch.column(1), 1 << 18):
                    data = _FOLD[chunk.data]
                    sizes = chunk.ends - chunk.starts
                    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - max(WIDTHS) + 1) // _STEP)), 0)
                    owner = np.repeat(np.arange(len(chunk)), counts)
                    first = np.cumsum(counts) - counts
                    begin = chunk.starts[owner] + (np.arange(len(owner)) - first[owner]) * _STEP
                    length = np.minimum(WINDOW, chunk.ends[owner] - begin)
                    total = np.zeros((len(chunk), len(net.languages)))
                    for i in range(0, len(owner), 512):
                        b, size = begin[i : i + 512, None], length[i : i + 512, None]
                        at = np.arange(WINDOW)[None, :]
                        windows = np.where(at < size, data[np.minimum(b + at, len(data) - 1)], np.uint8(32))
                        np.add.at(total, owner[i : i + 512], net.log_probabilities(windows) * size)
                    mean = total / np.maximum(sizes, 1)[:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = mean.argmax(axis=1)
                    for j in np.flatnonzero(sizes):
                        row = chunk.first + int(j)
                        if any(map(str.isalpha, batch.column(1)[row].as_py())):
                            names[row], scores[row] = net.languages[best[j]], p[j, best[j]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def identify_languages(docs: DataFrame, train_per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; see the module."""
    spark = docs.sparkSession
    ws = Workspace(spark, "language")
    rows = pick(docs, "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    turn = F.xxhash64("doc_id", F.lit("language id"))
    labelled = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("lang", turn.alias("turn"), F.shiftright(turn, 48).alias("slot"), "text")
    # ranges of the hash that hold the first rows of each language, from at most 2**16 counts a language
    before = Window.partitionBy("lang").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = labelled.groupBy("lang", "slot").agg(F.count(F.lit(1)).alias("n"))
    reach = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where(F.col("before") < train_per_language)
        .groupBy("lang")
        .agg(F.max("slot").alias("reach"))
    )
    order = Window.partitionBy("lang").orderBy("turn", "windows")
    sample = (
        labelled.join(F.broadcast(ws.keep(reach, "reach")), "lang")  # a row per language
        .where(F.col("slot") <= F.col("reach"))
        .select("lang", "turn", "text")
        .mapInArrow(_cut, "lang string, turn bigint, windows binary")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= train_per_language)
        .orderBy("lang", "rank")
        .collect()  # train_per_language rows a language
    )
    net = None
    if sample:
        windows = np.frombuffer(b"".join(bytes(r.windows) for r in sample), np.uint8).reshape(-1, WINDOW)
        net = train(windows, [r.lang for r in sample for _ in range(WINDOWS_PER_TEXT)])
    shared = spark.sparkContext.broadcast(net)
    out = ws.result(
        rows.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
            _predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double"
        )
    )
    shared.destroy()
    return out
