"""Secrets in texts: fixed patterns, and random-looking tokens by a randomness test battery.

Base kinds (leftmost, not overlapping within a kind): ``assign``, ``access``, ``hex``.
The method adds ``random``: maximal runs of 20 or more characters of
``[A-Za-z0-9+/_-]`` (with ``=`` padding) that mix letters and digits. The smallest encoding that
holds all characters of a token (hex, base 32, base 36, base 62, base 64) is
inferred; under it three tests of uniform independent draws run:

* chi-squared of the counts of the alphabet's classes (lower, upper, digit,
  symbol) and of its single symbols against uniform shares,
* a runs test on values above and below the middle of the alphabet,
* a lag-1 serial correlation test of the values.

Their p-values are combined by Fisher's method into one score; random strings
score uniformly in (0, 1), text scores near 0. Every text gives one decoy: words
from a place that its hash picks, joined by single digits to a token of one of the
length classes in turn. Decoys go through the same tests and give the null
distribution of a length class; a class with few takes in those of shorter ones (tests
on fewer characters are weaker, so they are on the safe side). Histograms of the
scores of tokens and decoys per length class are counted over all texts in Spark;
the least score at which the expected share of false discoveries is at most
``fdr`` is the threshold of a length class. A class without enough decoys to
bound that share finds nothing.

Edge cases: a null text is an empty one; without findings ``spans`` is empty. Every
row comes back, repeated rows and null ids too. A very long text is scanned whole, and gives one decoy like any other. Spans
that start at the same place are told in the order of the kinds; equal scores share a bin and are taken or left together. Empty tables give empty results.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick

# fixed values: the base patterns
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 20
FDR = 0.01
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN)
ENOUGH_DECOYS = 100
_WORD = re.compile(r"[A-Za-z]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
# scores are binned by -4 log10(score); at 48 and beyond is one bin
_BINS = 48
# scores below 0.001: one random string in a thousand
_TEXT_BIN = 12
# least lengths of the length classes
_LENGTHS = np.array([20, 24, 28, 32, 40, 48, 64, 96])

_ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_VALUES = {}
for _name, _alphabet in _ENCODINGS.items():
    _row = np.full(128, -1, np.int16)
    _row[[ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
    _VALUES[_name] = _row
_CLASS = np.full(128, 3, np.int8)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")):
    _CLASS[[ord(c) for c in _chars]] = _i
_SHARES = {
    n: np.bincount(_CLASS[[ord(c) for c in a]], minlength=4) / len(a) for n, a in _ENCODINGS.items()
}


def _two_sided(z: float) -> float:
    """Tail of the normal distribution beyond -z and z."""
    from math import erfc, sqrt

    return max(erfc(abs(z) / sqrt(2)), 1e-300)


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution for small whole df."""
    from math import erfc, exp, pi, sqrt

    if df <= 0 or x <= 0:
        return 1.0
    if df % 2:
        term, total = sqrt(2 * x / pi) * exp(-x / 2), erfc(sqrt(x / 2))
        for k in range(3, df + 1, 2):
            total += term
            term *= x / k
        return max(total, 1e-300)
    term = total = exp(-x / 2)
    for k in range(2, df, 2):
        term *= x / k
        total += term
    return max(total, 1e-300)


def infer_encoding(codes: np.ndarray) -> str | None:
    """The first (smallest) encoding that has all characters; trailing ``=`` are padding and left out before."""
    for name, values in _VALUES.items():
        if (values[codes] >= 0).all():
            return name
    return None


def randomness(token: str) -> float:
    """Combined p-value of the battery under the token's encoding; 0 if no encoding fits."""
    codes = np.frombuffer(token.rstrip("=").encode("ascii"), np.uint8)
    name = infer_encoding(codes)
    if name is None or len(codes) < 8:
        return 0.0
    n, size = len(codes), len(_ENCODINGS[name])
    expected = _SHARES[name] * n
    counts = np.bincount(_CLASS[codes], minlength=4)
    some = expected > 0
    p = [_chi_tail(float((((counts - expected) ** 2)[some] / expected[some]).sum()), int(some.sum()) - 1)]
    values = _VALUES[name][codes].astype(np.float64)
    high = values >= size / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n0 and n1:
        mean = 2 * n0 * n1 / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        p.append(_two_sided((runs - mean) / variance**0.5) if variance > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    centred = values - values.mean()
    spread = float((centred**2).sum())
    p.append(_two_sided((float((centred[1:] * centred[:-1]).sum()) / spread + 1 / n) * n**0.5) if spread else 1e-300)
    # single symbols: letters of words repeat more than draws do
    each = np.bincount(codes, minlength=1)
    p.append(_chi_tail(size / n * float((each.astype(np.float64) ** 2).sum()) - n, size - 1))
    return _chi_tail(-2 * sum(float(np.log(x)) for x in p), 2 * len(p))


def _bin(score: float) -> int:
    return _BINS if score <= 0 else min(_BINS, int(-4 * np.log10(score)))


def _length_class(n: int) -> int:
    return int(np.searchsorted(_LENGTHS, n, "right")) - 1


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of all candidate tokens."""
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            yield m.start(), m.end()


def decoy(text: str) -> str:
    """Words of the text joined by digits, of a length that the text's hash picks; empty if it is too short."""
    h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    n = int(_LENGTHS[h % len(_LENGTHS)])
    at = h // len(_LENGTHS) % max(1, len(text) - 4 * n)
    out = ""
    for i, w in enumerate(_WORD.findall(text[at : at + 4 * n])):
        if len(out) >= n:
            return out[:n]
        out += w + str((h >> i % 24) % 10)
    return out[:n] if len(out) >= n else ""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in the order of starts, then kinds."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a maximal run of 24 or more is the same match as the pattern's, without the short ones
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its base spans and candidate tokens with scores; decoys only as a histogram row at the end of a batch."""
    for batch in batches:
        base, starts, ends, bins = [], [], [], []
        decoys: dict[int, int] = {}
        for text in batch.column(1).to_pylist():
            text = text or ""
            base.append(_joined(base_spans(text)))
            row = []
            for a, b in tokens(text):
                row.append((a, b, _bin(randomness(text[a:b]))))
            if token := decoy(text):
                key = _length_class(len(token)) * (_BINS + 1) + _bin(randomness(token))
                decoys[key] = decoys.get(key, 0) + 1
            starts.append([x[0] for x in row])
            ends.append([x[1] for x in row])
            bins.append([x[2] for x in row])
        n = batch.num_rows
        flags = [False] * n
        ids = batch.column(0).to_pylist()
        extra = sorted(decoys.items())
        # the histogram rides in rows of its own
        ids += [None] * bool(extra)
        base += [""] * bool(extra)
        flags += [True] * bool(extra)
        if extra:
            starts.append([k for k, _ in extra])
            ends.append([v for _, v in extra])
            bins.append([])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(flags, pa.bool_()),
                pa.array(base, pa.string()),
                *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends, bins)),
            ],
            names=["doc_id", "decoys", "base", "starts", "ends", "bins"],
        )


def thresholds(found: np.ndarray, decoys: np.ndarray, fdr: float) -> np.ndarray:
    """Largest accepted bin per length class (-1: none), from counts by class and bin.

    The number of tokens that are text is estimated from the bins where random
    strings hardly come (Storey's adaptive step-up), with one added for safety.
    """
    out = np.full(len(found), -1)
    for i, row in enumerate(found):
        first = i
        while first and decoys[first : i + 1].sum() < ENOUGH_DECOYS:
            first -= 1
        null = decoys[first : i + 1].sum(axis=0)
        if not null.sum() or not row.sum():
            continue
        share = (1 + np.cumsum(null)) / (1 + null.sum())  # bins count downwards in score: bin 0 is the most random
        texts = min(row.sum(), (row[_TEXT_BIN:].sum() + 1) / max(1e-9, null[_TEXT_BIN:].sum() / null.sum()))
        accepted = np.cumsum(row)
        ok = np.flatnonzero((accepted > 0) & (texts * share <= fdr * accepted))
        ok = ok[ok < _TEXT_BIN]
        if len(ok):
            out[i] = ok[-1]
    return out


def _finish(limits: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for base, starts, ends, bins in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                own = []
                for part in base.split(",") if base else []:
                    kind, a, b = part.split(":")
                    own.append((int(a), KINDS.index(kind), int(b)))
                extra = [(a, 3, b) for a, b, s in zip(starts, ends, bins, strict=True) if s <= limits[_length_class(b - a)]]
                for i in range(3):
                    counts[i].append(sum(k == i for _, k, _ in own))
                counts[3].append(len(extra))
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(_joined(sorted(own + extra)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    return run


def scan_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random; see the module."""
    ws = Workspace(docs.sparkSession, "secrets")
    scanned = ws.keep(
        pick(docs, "doc_id", "text").mapInArrow(
            _scan, "doc_id bigint, decoys boolean, base string, starts array<bigint>, ends array<bigint>, bins array<bigint>"
        ),
        "scanned",
    )
    slots = _BINS + 1
    of_token = F.explode(F.arrays_zip("starts", "ends", "bins")).alias("x")
    edges = F.array(*[F.lit(int(x)) for x in _LENGTHS])
    length_class = F.size(F.filter(edges, lambda e: e <= F.col("x.ends") - F.col("x.starts"))) - 1
    targets = (
        scanned.where("NOT decoys")
        .select(of_token)
        .select((length_class * slots + F.col("x.bins")).cast("bigint").alias("key"), F.lit(1).alias("n"))
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
    )
    nulls = (
        scanned.where("decoys")
        .select(F.explode(F.arrays_zip("starts", "ends")).alias("x"))
        .groupBy(F.col("x.starts").alias("key"))
        .agg(F.sum("x.ends").alias("n"))
    )
    table = np.zeros((2, len(_LENGTHS) * slots), np.int64)
    # one row per length class and bin at most
    for which, rows in enumerate((targets.collect(), nulls.collect())):
        for r in rows:
            table[which, r.key] = r.n
    found, decoys = table.reshape(2, len(_LENGTHS), slots)
    limits = thresholds(found, decoys, fdr).tolist()
    return ws.result(
        scanned.where("NOT decoys")
        .select("doc_id", "base", "starts", "ends", "bins")
        .mapInArrow(
            _finish(limits),
            "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint",
        )
    )
