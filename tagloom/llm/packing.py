"""Lexical retrieval packing: BM25 neighbours fill each seed document's window.

1. Texts are tokenised once and stored as 16-bit ids (a document ends with
   ``end_id``). Full windows at a document's start are sequences of their own; what
   is left, its tail, is packed with others.
2. Document frequencies of all token ids are counted in Spark: one row per id of
   the fixed vocabulary.
3. A tail's lexical key is its token of the greatest BM25 weight. Keys get
   adjoining ranges of one token axis in proportion to their tails' tokens, and the
   axis is cut into shards of about ``shard_tokens``. A tail lies in its key's range at
   the place that its hash picks, so a key with a third of all tokens spreads over many
   shards, and no shard depends on anything but counts per key.
4. Each shard builds its inverted index in memory and packs: the first unused
   tail is the seed, its ``QUERY_TERMS`` terms of the greatest weight query the index (the others where
   these find nothing), unused
   neighbours follow by BM25 score until the window is full, and the rest of the last
   one is the next seed. All windows but a shard's last are full; the last is cut
   into powers of two, so nothing is padded.

Edge cases: a null or empty text is the end id alone. Repeated rows and null ids are
documents of their own and packed like any other. Ties in scores go to the earlier
tail of the shard (order of doc_id, then text). The strings of special tokens in a text are
these tokens, or plain text without ``special``. A very long text is cut into full windows, so only its tail
is indexed; its ids are one row. Empty tables give empty results. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lean, pick
from .text_arrays import _hashed, text_chunks

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 32
K1, B = 1.2, 0.75
_CACHE_UNITS = 1_000_000
_PART_BYTES = 2 << 20


class WordTokenizer:
    """Ids of texts, encoding each different word once.

    The tokenizer drops white space and never merges over it, nor over the border between
    letters and the punctuation behind them, so a text's ids are those of its words in order, and a
    word's are those of its letters and of its trailing punctuation: its two units. Units of letters only
    end with one id that is marked as a word end in the vocabulary: many are encoded in one call and told
    apart by these marks.

    Known units are kept in the order of a hash of their bytes, each with its place in the pool of ids; a
    unit that is looked up is compared with the one found, so a clash of hashes only costs its encoding.
    """

    # punctuation that may be cut off; the apostrophe has rules of its own and is not in it
    TAIL = ".,;:!?*#%$&"

    def __init__(self, path: str, special: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(path)
        # as the file has it, the strings of special tokens in a text are these tokens; else they are plain text
        self._encoder.encode_special_tokens = not special
        if self.vocabulary() > 1 << 16:
            raise ValueError(f"ids are stored in 16 bits; {path} has {self.vocabulary()} of them")
        self._is_end = np.zeros(self.vocabulary(), bool)
        self._is_end[[i for t, i in self._encoder.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Drop all known units."""
        self._hashes = np.zeros(0, np.uint64)
        self._numbers = np.zeros(0, np.int64)  # of the units in the order of their hashes
        self._units = pa.array([], pa.string())
        self._pool = np.zeros(0, np.uint16)
        self._starts = np.zeros(0, np.int64)
        self._sizes = np.zeros(0, np.int64)

    def vocabulary(self) -> int:
        return self._encoder.get_vocab_size(with_added_tokens=True)

    def _encode_units(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The order in which the units were encoded, their ids in that order, and how many each has."""
        plain = [i for i, u in enumerate(units) if u.isalpha()]
        odd = [i for i, u in enumerate(units) if not u.isalpha()]
        order: list[int] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for part, e in zip(groups, self._encoder.encode_batch_fast([" ".join([units[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            own = np.array(e.ids, np.uint16)
            ends = np.flatnonzero(self._is_end[own]) + 1
            if len(ends) == len(part) and ends[-1] == len(own):
                order += part
                ids.append(own)
                sizes.append(np.diff(ends, prepend=0))
            else:  # a letter that lower case or normalisation takes apart
                odd += part
        for i in range(0, len(odd), 1000):
            part = odd[i : i + 1000]
            lists = [e.ids for e in self._encoder.encode_batch_fast([units[k] for k in part], add_special_tokens=False)]
            order += part
            ids += [np.array(x, np.uint16) for x in lists]
            sizes.append(np.array([len(x) for x in lists], np.int64))
        return order, np.concatenate(ids), np.concatenate(sizes)

    def _look_up(self, units: pa.Array) -> np.ndarray:
        """Number of each of the different units; new ones are encoded and kept."""
        whole = next(text_chunks(units, limit=1 << 40), None)
        if whole is None:
            return np.zeros(0, np.int64)
        h = _hashed(whole.data, whole.starts, whole.ends)
        order = np.argsort(h, kind="stable")
        at = np.minimum(np.searchsorted(self._hashes, h[order]), max(0, len(self._hashes) - 1))
        numbers = np.full(len(h), -1, np.int64)
        if len(self._hashes):
            numbers[order] = self._numbers[at]
            same = pc.equal(units, self._units.take(pa.array(numbers)))
            numbers[~np.asarray(same)] = -1
        new = np.flatnonzero(numbers < 0)
        if len(new):
            order, ids, sizes = self._encode_units(units.take(pa.array(new)).to_pylist())
            new = new[order]
            numbers[new] = len(self._units) + np.arange(len(new))
            self._starts = np.append(self._starts, len(self._pool) + np.cumsum(sizes) - sizes)
            self._sizes = np.append(self._sizes, sizes)
            self._pool = np.concatenate([self._pool, ids])
            self._units = pa.concat_arrays([self._units, units.take(pa.array(new))])
            new = new[np.argsort(h[new], kind="stable")]
            place = np.searchsorted(self._hashes, h[new])
            self._hashes = np.insert(self._hashes, place, h[new])
            self._numbers = np.insert(self._numbers, place, numbers[new])
        return numbers

    def _two_units(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Letters (or the whole word, if it is not of letters only) and cut off punctuation of each word."""
        core = pc.utf8_rtrim(words, characters=self.TAIL)
        letters = pc.utf8_is_alpha(core)
        whole = next(text_chunks(words, limit=1 << 40), None)
        if whole is None:
            return words, words
        # the bytes behind the core, of words whose core is letters
        size = whole.ends - whole.starts - np.asarray(pc.binary_length(core))
        size = np.where(np.asarray(letters), size, 0)
        total = np.cumsum(size)
        data = whole.data[np.repeat(whole.ends - total, size) + np.arange(total[-1])]
        tails = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(np.append(0, total).astype(np.int32)), pa.py_buffer(data)])
        return pc.if_else(letters, pc.ascii_lower(core), words), tails

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, one after the other, and where each text ends."""
        if len(self._units) > _CACHE_UNITS:
            self.forget()
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        flat = parts.flatten().dictionary_encode()
        cores, tails = (c.dictionary_encode() for c in self._two_units(flat.dictionary))
        units = pa.concat_arrays([cores.dictionary, tails.dictionary]).dictionary_encode()
        numbers = self._look_up(units.dictionary)[np.asarray(units.indices)]
        # two units a word
        pair = np.stack([numbers[np.asarray(cores.indices)], numbers[len(cores.dictionary) + np.asarray(tails.indices)]], axis=1)
        unit = pair[np.asarray(flat.indices)].ravel()
        lengths = self._sizes[unit]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self._pool[np.repeat(self._starts[unit] - total[:-1], lengths) + np.arange(total[-1])]
        ends = total[2 * offsets[1:]]
        return np.insert(ids, ends, np.uint16(end_id)), ends + np.arange(1, len(ends) + 1)


_tokenizers: dict[tuple[str, bool], WordTokenizer] = {}


def _tokenizer(path: str, special: bool) -> WordTokenizer:
    if (path, special) not in _tokenizers:
        _tokenizers[path, special] = WordTokenizer(path, special)
    return _tokenizers[path, special]


def _terms(ids: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tail length of each text; text, id and number of its different (text, id) pairs in the tails, in order."""
    sizes = np.diff(ends, prepend=0)
    tail = sizes % window
    text = np.repeat(np.arange(len(ends)), tail)
    at = np.arange(len(text)) + np.repeat(ends - np.cumsum(tail), tail)
    pairs = np.sort((text.astype(np.uint32) << 16) | ids[at]) if len(ends) <= 1 << 16 else np.sort((text << 16) | ids[at])
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    return tail, (pairs[first] >> 16).astype(np.int64), (pairs[first] & 0xFFFF).astype(np.int64), np.diff(np.append(first, len(pairs)))


def _tokenise(path: str, special: bool, end_id: int, window: int):
    """Rows of ids, and at the end of a task one row with its document frequencies, number of tails and of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(path, special)
        names = ["doc_id", "h", "ids", "counts"]
        df = np.zeros(encoder.vocabulary() + 2, np.int64)
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + _PART_BYTES, "right")))
                part = batch.slice(i, j - i)
                i = j
                ids, ends = encoder.encode(part.column(1), end_id)
                tail, _, term, _ = _terms(ids, ends, window)
                df[:-2] += np.bincount(term, minlength=len(df) - 2)
                df[-2:] += (np.count_nonzero(tail), tail.sum())
                data = ids.astype("<u2")
                blobs = pa.Array.from_buffers(
                    pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), blobs, pa.nulls(len(ends), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary())], names=names
        )

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n: sums of the tasks' counts, of what is not zero."""
    total = None
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            one = np.frombuffer(blob, np.int64)
            total = one.copy() if total is None else total + one
    some = np.flatnonzero(total) if total is not None else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some] if len(some) else some)], names=["id", "n"])


def _keys(idf: np.ndarray, mean: float, window: int):
    """Each text's key, its tail's id of the greatest weight (the smallest of equal ones; -1 without a tail), and tail length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(2)), np.int64) // 2
            ids = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2")
            tail, text, term, tf = _terms(ids, np.cumsum(sizes), window)
            keys = np.full(batch.num_rows, -1, np.int64)
            if len(text):
                weight = _weights(tf, idf[term], tail[text], mean)
                first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                top = np.repeat(np.maximum.reduceat(weight, first), np.diff(np.append(first, len(text))))
                best = np.flatnonzero(weight == top)
                own, at = np.unique(text[best], return_index=True)
                keys[own] = term[best[at]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(keys), pa.array(tail)], names=["doc_id", "h", "ids", "key", "tail"]
            )

    return run


def _weights(tf: np.ndarray, idf: np.ndarray, length: np.ndarray | int, mean: float) -> np.ndarray:
    return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))).astype(np.float32)


class ShardIndex:
    """BM25 inverted index of a shard's tails."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(tails)
        sizes = np.array([len(t) for t in tails])
        doc = np.repeat(np.arange(self.n, dtype=np.int64), sizes)
        pair, tf = np.unique(np.concatenate(tails).astype(np.int64) * self.n + doc, return_counts=True)
        term, self.doc = pair // self.n, (pair % self.n).astype(np.int32)
        self.weight = _weights(tf, idf[term], sizes[self.doc], mean)
        self.starts = np.searchsorted(term, np.arange(len(idf) + 1))
        # the terms of a document, those of the greatest weight first
        by_doc = np.lexsort((term, -self.weight, self.doc))
        self.doc_terms = term[by_doc]
        self.doc_starts = np.searchsorted(self.doc[by_doc], np.arange(self.n + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents with a score, the best first; ties in index order.

        The query is the ``QUERY_TERMS`` terms of the seed with the greatest weights, or, where no unused
        document has one of these, the others.
        """
        a, b = self.doc_starts[seed], self.doc_starts[seed + 1]
        found = self._ranked(self.doc_terms[a : min(b, a + QUERY_TERMS)], unused)
        return found if len(found) or b - a <= QUERY_TERMS else self._ranked(self.doc_terms[a + QUERY_TERMS : b], unused)

    def _ranked(self, terms: np.ndarray, unused: np.ndarray) -> np.ndarray:
        a, b = self.starts[terms], self.starts[terms + 1]
        lengths = b - a
        total = np.cumsum(lengths)
        at = np.repeat(a - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)
        score = np.bincount(self.doc[at], self.weight[at], minlength=self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        if len(found) > 64:
            # only the best can fit into a window; more are asked for if they were too short to fill it
            found = found[np.argpartition(-score[found], 63)[:64]]
            found.sort()
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, start in it, length). All but the last few are full windows; those are powers of two."""
    out: list[list[tuple[int, int, int]]] = []
    unused = np.ones(len(tails), bool)
    index = ShardIndex(tails, idf, mean)
    sequence: list[tuple[int, int, int]] = []
    room = window
    next_seed = 0
    seed, start = -1, 0  # a document that is begun and goes on in the next window
    left = len(tails)

    def place(doc: int, begin: int) -> int:
        nonlocal room
        n = min(room, len(tails[doc]) - begin)
        sequence.append((doc, begin, n))
        room -= n
        return begin + n

    while left or seed >= 0:
        if seed < 0:
            while not unused[next_seed]:
                next_seed += 1
            seed, start = next_seed, 0
            unused[seed] = False
            left -= 1
        query, start = seed, place(seed, start)
        if start == len(tails[seed]):
            seed = -1
        while room and left:
            found = index.neighbours(query, unused)
            if not len(found):
                # nothing shares a term with the seed: the next unused document is as good as any
                while not unused[next_seed]:
                    next_seed += 1
                found = [next_seed]
            for doc in found:
                doc = int(doc)
                unused[doc] = False
                left -= 1
                done = place(doc, 0)
                if done < len(tails[doc]):
                    seed, start = doc, done
                if not room:
                    break
        if not room:
            out.append(sequence)
            sequence, room = [], window
    # the last window: powers of two from the largest
    while sequence:
        size = 1 << (sum(n for _, _, n in sequence).bit_length() - 1)
        own, rest, room = [], [], size
        for doc, begin, n in sequence:
            k = min(n, room)
            if k:
                own.append((doc, begin, k))
            if n > k:
                rest.append((doc, begin + k, n - k))
            room -= k
        out.append(own)
        sequence = rest
    return out


_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=names)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pack(idf: np.ndarray, mean: float, window: int):
    def shard_rows(shard: int, docs: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        rows, base = [], shard << 32
        serial = 0
        for doc_id, ids in docs:
            for a in range(0, len(ids) // window * window, window):
                rows.append((doc_id, a, window, _crc(ids[a : a + window]), len(ids), base + serial, 0))
                serial += 1
        tailed = [(doc_id, ids, len(ids) // window * window) for doc_id, ids in docs if len(ids) % window]
        if tailed:
            for sequence in pack_shard([ids[a:] for _, ids, a in tailed], idf, mean, window):
                offset = 0
                for doc, begin, n in sequence:
                    doc_id, ids, a = tailed[doc]
                    rows.append((doc_id, a + begin, n, _crc(ids[a + begin : a + begin + n]), len(ids), base + serial, offset))
                    offset += n
                serial += 1
        return _pieces(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs = None, []
        for batch in batches:
            for at, doc_id, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at != shard and docs:
                    yield shard_rows(shard, docs)
                    docs = []
                shard = at
                docs.append((doc_id, np.frombuffer(blob, "<u2")))
        if docs:
            yield shard_rows(shard, docs)

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, special: bool = True
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; see the module.

    With ``special`` the strings of special tokens in a text are these tokens, as the tokenizer file
    has it; without, they are plain text.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    rows = pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text", "doc_id").alias("h"))
    stored = ws.keep(rows.mapInArrow(lean(_tokenise(tokenizer_path, special, end_id, window)), "doc_id bigint, h bigint, ids binary, counts binary"), "ids")
    ids = stored.where("ids IS NOT NULL").select("doc_id", "h", "ids")
    vocabulary = _tokenizer(tokenizer_path, special).vocabulary()
    counts = (
        stored.where("counts IS NOT NULL").select("counts").mapInArrow(_frequencies, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = dict(zip(counts["id"].tolist(), counts["n"].tolist(), strict=True))  # a row per id of the vocabulary
    n_tails, n_tokens = counts.pop(vocabulary, 0), counts.pop(vocabulary + 1, 0)
    df = np.zeros(vocabulary)
    df[list(counts)] = list(counts.values())
    idf = np.log1p((n_tails - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = max(1.0, n_tokens / max(1, n_tails))
    keyed = ids.mapInArrow(_keys(idf, mean, window), "doc_id bigint, h bigint, ids binary, key bigint, tail bigint")
    per_key = (
        ids.mapInArrow(_keys(idf, mean, window), "doc_id bigint, h bigint, ids binary, key bigint, tail bigint")
        .groupBy("key")
        .agg(F.sum(F.col("tail") + 1).alias("n"))
        .toPandas()
        .sort_values("key")
    )
    # one row per id of the vocabulary: where each key's range begins on the axis of tokens
    begins = per_key["n"].cumsum() - per_key["n"]
    total = int(per_key["n"].sum())
    shards = max(1, round(total / shard_tokens))
    ranges = spark.createDataFrame(
        [(int(k), float(b), float(n)) for k, b, n in zip(per_key["key"], begins, per_key["n"], strict=True)], "key bigint, begin double, span double"
    )
    unit = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shard = F.least(F.lit(shards - 1), F.floor((F.col("begin") + unit * F.col("span")) * shards / F.lit(float(max(1, total))))).cast("bigint")
    placed = keyed.join(F.broadcast(ranges), "key").select(shard.alias("shard"), "doc_id", "ids", "h")
    return ws.result(
        placed.repartition(max(1, shards), "shard")
        .sortWithinPartitions("shard", "doc_id", "h")
        .select("shard", "doc_id", "ids")
        .mapInArrow(lean(_pack(idf, mean, window)), _SCHEMA)
    )
