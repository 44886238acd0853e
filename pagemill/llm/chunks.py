"""Cutting texts at places where tokenizers always cut, and caches of what the pieces give.

Corpora repeat words, so the operators that tokenize look each piece up and call the
library for new pieces only. All caches are per Python worker and bounded.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space for Python's or the tokenizers' \s, besides the four characters of PIECE.
ODD_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200C)))
PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
ODD_PIECE = re.compile(r".+?(?:(?<=\S)(?= )|\Z)", re.S)
CACHE_ENTRIES = 300_000


def pieces(text: str) -> list[str]:
    """text cut before white space that follows other characters.

    A piece is white space, then the characters up to the next white space. Byte-level BPE
    pre-tokenizers match no piece of text that has white space after other characters, so
    they cut there too, and look-aheads see the same characters. Texts with unusual white
    space are cut before plain spaces only.
    """
    if any(c in text for c in ODD_SPACE):
        return ODD_PIECE.findall(text)
    return PIECE.findall(text)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=1)
def byte_signs() -> list[str]:
    """The characters that byte-level pre-tokenizers write for bytes: printable ones stand for themselves, the others for the next unused code points."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def latin(word: str) -> bool:
    """Letters of the Latin blocks only: one match for every pre-tokenizer, and composed already."""
    return word.isalpha() and max(word) < "\u0250"


def byte_level(text: str) -> str:
    return text if text.isascii() and " " not in text else "".join(map(byte_signs().__getitem__, text.encode()))


def encode_pieces(path: str, keys: list[str], as_model):
    """Token ids of each key. The library's pre-tokenizers leave Latin words whole, so those go to its BPE
    model directly, as_model(word) being the word as the pre-tokenizer writes it (None: not such a word)."""
    found = tokenizer(path)
    one, ids = found.model.tokenize, [None] * len(keys)
    rest = []
    for i, k in enumerate(keys):
        if (w := as_model(k)) is not None:
            ids[i] = [t.id for t in one(w)]
        else:
            rest.append(i)
    for i, x in zip(rest, found.encode_batch_fast([keys[i] for i in rest], add_special_tokens=False), strict=True):
        ids[i] = x.ids
    return ids


@lru_cache(maxsize=4)
def sentencepiece(path: str):
    import sentencepiece as sp

    return sp.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def tiktoken_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def tiktoken_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=tiktoken_ranks(path), special_tokens={})


def peel(piece):
    """(rest, last character) if the piece ends in a letter and a full stop or comma, else None.

    Tokenizers part letters from punctuation, so both can be encoded by themselves; but some normalise texts first, and then a
    letter can end in a mark (U+0130 in lower case, U+0958 composed), which they may take together with punctuation. So Latin letters only.
    """
    if len(piece) > 1 and piece[-1] in ".," and piece[-2] < "\u0250" and piece[-2].lower().isalpha():
        return piece[:-1], piece[-1]
    return None


class Cache:
    """What make(list of new keys) gave for each key, in two generations of CACHE_ENTRIES entries:
    when the younger is full it becomes the older one, and entries used again move back."""

    def __init__(self, make, peel=None):
        self.make, self.peel, self.young, self.old = make, peel, {}, {}

    def values(self, keys: list) -> list:
        """The values of distinct keys. With peel, a key's value is the sum of its parts' values."""
        if len(self.young) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        young, old, peel = self.young, self.old, self.peel
        out = list(map(young.get, keys))
        new, whole, plain = {}, [], []
        for i in [i for i, v in enumerate(out) if v is None]:
            k = keys[i]
            if (v := old.get(k)) is not None:
                out[i] = young[k] = v
            elif peel is not None and (cut := peel(k)):
                whole.append((i, k, cut))
                for x in cut:
                    if x not in young:
                        if (v := old.get(x)) is None:
                            new[x] = None
                        else:
                            young[x] = v
            else:
                new[k] = None
                plain.append((i, k))
        if new:
            young.update(zip(new, self.make(list(new)), strict=True))
        for i, k in plain:
            out[i] = young[k]
        for i, k, (a, b) in whole:
            out[i] = young[k] = young[a] + young[b]
        return out

    def of(self, keys) -> dict:
        keys = list(keys)
        return dict(zip(keys, self.values(keys), strict=True))


@lru_cache(maxsize=1)
def _trim():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Give freed memory back to the system, as workers are kept from task to task."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def runs(batch: pa.RecordBatch, text_column: int, most: int = 12 << 20):
    """Slices of a batch with about `most` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
        release()


def arrow_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """pieces() of all texts one after another, and the number of the first of each (and the end); null counts as empty."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, f"[{ODD_SPACE}\\x00]")).as_py():
        cut = [pieces(t) for t in texts.to_pylist()]
        return pa.array([p for c in cut for p in c], pa.string()), np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
    marked = pc.replace_substring_regex(texts, "([^ \\t\\n\\r])([ \\t\\n\\r])", "\\1\x00\\2")
    cut = pc.split_pattern(marked, "\x00")
    return cut.flatten(), cut.offsets.to_numpy().astype(np.int64)


def gather(values: pa.Array, indices: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of values[indices] one after another, and where each begins (and the last ends)."""
    got = values.take(indices)
    if not len(got):
        return memoryview(b""), np.zeros(1, np.int64)
    ends = np.frombuffer(got.buffers()[1], np.int32)[got.offset : got.offset + len(got) + 1]
    return memoryview(got.buffers()[2] or b""), ends.astype(np.int64)
