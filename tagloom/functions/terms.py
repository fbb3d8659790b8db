"""Words of many texts at once, as numbers: for embedders that need no neural model."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and 32-bit hash of every word, in order: each different word of the texts is hashed once."""
    lists = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    words = lists.flatten()
    row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    codes = words.dictionary_encode()
    hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in codes.dictionary.to_pylist()], np.int64)
    some = np.asarray(pc.not_equal(words, ""))
    return row[some], hashes[np.asarray(codes.indices)[some]] if len(hashes) else np.zeros(0, np.int64)


def term_counts(texts: list[str], features: int) -> np.ndarray:
    """How often each of the hashed features is in each text."""
    row, h = hashed_words(texts)
    return np.bincount(row * features + h % features, minlength=len(texts) * features).reshape(len(texts), features)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length, of damped counts times the inverse document frequencies."""
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class LearnedTerms:
    """Embedder of the axes that ``fit_terms`` found: weighted terms, projected, of unit length."""

    def __init__(self, axes: np.ndarray, idf: np.ndarray, name: str = "terms"):
        self.axes, self.idf = axes, idf
        self.dim = axes.shape[1]
        self.model_id = f"{name}-{self.dim}-{zlib.crc32(axes.astype('<f4').tobytes()):08x}"

    def embed(self, texts: list[str]) -> np.ndarray:
        x = weighted(term_counts(texts, len(self.idf)), self.idf) @ self.axes
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(norm > 0, norm, 1)).astype(np.float32)
