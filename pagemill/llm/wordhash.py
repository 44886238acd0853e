"""Words as 64-bit hashes, for whole runs of documents at once.

Hashes stand for words in windows and shingles; two different words of a corpus share one with
a chance of about (number of distinct words)^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ([^\\x20\\x09-\\x0D]+) of all texts, one after another, and where each text's begin (and the
    last's end). Null counts as empty. lower: A to Z are lower-cased."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = cut.flatten()
    if lower:
        flat = pc.ascii_lower(flat)
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    if not words:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))[coded.indices.to_numpy()]
    at = cut.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return h, at
    return h[full], np.concatenate([[0], np.cumsum(full)])[at].astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the ordered pairs."""
    return mixed(a * ODD[0] + (b ^ (b >> U(29))) * ODD[1] + ODD[2])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries (by halves), len(h) - n + 1 of them; across texts too, so callers skip those."""
    if len(h) < n:
        return np.zeros(0, U)
    if n == 1:
        return h
    a = n // 2
    left, right = grams(h, a), grams(h, n - a)
    return paired(left[: len(h) - n + 1], right[a:])
