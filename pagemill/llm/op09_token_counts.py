"""Token counts: Arrow functions that return lengths only.

Each Arrow batch is dealt again into runs of about as many bytes. Their texts are cut at safe
boundaries (chunks.pieces), so a text of any length is encoded in short pieces; the distinct
pieces of a run are looked up once, and those that the worker has not seen yet go to the
library in one batch. No shuffle.

Null texts count as empty: 0 bytes, 0 tokens. Empty tables give no rows, repeated rows give
a row each, and other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.chunks import Cache, arrow_pieces, byte_level, encode_pieces, latin, peel, runs, sentencepiece
from pagemill.llm.shared import table

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def as_byte_level(piece: str) -> str | None:
    """A Latin word, maybe after a space, as byte-level pre-tokenizers write it."""
    return byte_level(piece) if latin(piece[1:] if piece[:1] == " " else piece) else None


@lru_cache(maxsize=4)
def _lengths(path: str) -> Cache:
    return Cache(lambda keys: map(len, encode_pieces(path, keys, as_byte_level)), peel)


def lengths(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text, as the library gives them without begin, end or added special tokens.

    path: a byte-level BPE in a .json file, or a sentencepiece .model.
    """
    if path.endswith(".model"):  # sentencepiece sees the whole text: its pieces may span white space
        return np.array([len(x) for x in sentencepiece(path).encode(pc.fill_null(texts, "").to_pylist(), num_threads=1)], np.int64)
    flat, at = arrow_pieces(texts)
    coded = flat.dictionary_encode()
    n = np.array(_lengths(path).values(coded.dictionary.to_pylist()), np.int64)
    sums = np.concatenate([[0], np.cumsum(n[coded.indices.to_numpy()])]) if len(flat) else np.zeros(1, np.int64)
    return sums[at[1:]] - sums[at[:-1]]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens > limit, a row for each row of docs."""

    def count(batches):
        for whole in batches:
            for b in runs(whole, 1):
                n = pa.array(lengths(tokenizer_path, b.column(1)), pa.int64())
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(count, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
