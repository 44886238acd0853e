"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are taken in blocks of about BLOCK_CHARS characters. A block is exploded into
pre-tokens with positions: its distinct pre-tokens in order of appearance, and for each
document the numbers of its pre-tokens, in order. The distinct pre-tokens of all blocks are
shuffled by their hash, so that each distinct word of the corpus is encoded once, in one task;
their ids are shuffled back to the blocks, joined to the numbers and so put together by
position. Decoding joins the ids with the table of token bytes.

The distinct words of a block go out as arrays, a row for each bucket of the hash that has any of them, and their ids come back so; a run of
documents is a row of packed numbers. No row holds more than a block, no task more than one block and
the distinct words of a bucket; a word that every text repeats counts once a block, and the work for a block depends on its own
words only, however many blocks and buckets there are. The
blocks are made twice, alike, from the input; it must give its rows in the same order again, as
files do (written() first, if they come from a shuffle). A block that differs raises an error.

Null texts count as empty; empty texts give 0 tokens; rows with equal ids are kept apart; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.chunks import arrow_pieces, gather, runs, tiktoken_encoding, tiktoken_ranks
from pagemill.llm.shared import CHANGED, parts, table

BLOCK_BYTES = 40 << 20
#: Bytes of documents in a row of numbers.
RUN_BYTES = 4 << 20
#: Buckets of words for each partition of their shuffle.
SPREAD = 4

@lru_cache(maxsize=2)
def _find(pattern: str):
    import regex

    return regex.compile(pattern).findall


def split_words(pattern: str, texts: pa.Array, latin: bool = True) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The distinct matches of pattern with their numbers, in order of appearance; the numbers of all texts' matches
    in order; and where each text's begin (and the last's end).

    latin: pattern takes letters with a space before them as one match, and punctuation apart, like
    the byte-level BPE patterns in use; pieces of this kind are then cut without it.
    """
    find = _find(pattern)
    flat, at = arrow_pieces(texts)
    coded = flat.dictionary_encode()
    words: dict[str, int] = {}
    number, numbers, counts = words.setdefault, [], []
    for p in coded.dictionary.to_pylist():
        w = p[1:] if p[:1] == " " else p
        if latin and w.isalpha():
            numbers.append(number(p, len(words)))
            counts.append(1)
        elif latin and w[-1:] in (".", ",") and w[:-1].isalpha():
            numbers.append(number(p[:-1], len(words)))
            numbers.append(number(p[-1], len(words)))
            counts.append(2)
        else:
            own = find(p)
            numbers += [number(x, len(words)) for x in own]
            counts.append(len(own))
    by_piece = joined(np.array(numbers, "<u4"), np.array(counts, np.int64))
    data, ends = gather(by_piece, coded.indices)
    return words, np.frombuffer(data, "<u4", count=int(ends[-1]) // 4), ends[at] // 4


def joined(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose row i holds the next counts[i] values."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def blocks(batches):
    """(number, ids of rows, texts) of each block of a partition; numbers differ between partitions."""
    number, held, size = None, [], 0

    def block():
        return number, [k for b in held for k in b.column(0).to_pylist()], pa.concat_arrays([b.column(1) for b in held]).fill_null("")

    for whole in batches:
        for b in runs(whole, 1, BLOCK_BYTES // 2):
            if number is None:
                number = b.column(2)[0].as_py() << 32
            held.append(b)
            size += b.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield block()
                number, held, size = number + 1, [], 0
    if held:
        yield block()


def squeeze(x) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def unsqueeze(x: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


#: What goes to a block: how many ids the words of a bucket have, and these ids (kind 0), or a run of documents (1).
ROW = "block long, kind int, number int, sizes array<int>, data binary"


def batch(rows: list[tuple], names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, result, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """result: Digests, Tokens or another class with the same functions; prepare() gets what the words of a
    block consist of, rows() the documents of a run as numbers of words."""
    # the task's own partition number differs between the two uses (one stands in a union), this one doesn't
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), (F.spark_partition_id() + 1).cast("long").alias("part"))
    n = parts(d)
    buckets = n * SPREAD

    def in_buckets(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each word, and the words' numbers in order of buckets."""
        to = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % np.uint32(buckets)
        return to, np.argsort(to, kind="stable")

    def words_of(batches):
        for number, _, texts in blocks(batches):
            words, _, _ = split_words(pattern, texts)
            if words:
                to, order = in_buckets(words)
                bucket, first = np.unique(to[order], return_index=True)
                listed = pa.array(list(words), pa.string()).take(pa.array(order))
                rows = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), listed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), number)), pa.array(bucket.astype(np.int32)), rows], names=["block", "bucket", "words"])

    def numbers_of(batches):
        for number, keys, texts in blocks(batches):
            words, numbers, at = split_words(pattern, texts)
            _, order = in_buckets(words)
            rank = np.empty(len(order), "<u4")  # a word's place when the buckets come one after another
            rank[order] = np.arange(len(order), dtype="<u4")
            placed = rank[numbers] if len(numbers) else numbers
            start = k = 0
            for run in runs(pa.record_batch([texts], names=["text"]), 0, RUN_BYTES):
                stop = start + run.num_rows
                planes = np.ascontiguousarray(placed[at[start] : at[stop]].view(np.uint8).reshape(-1, 4).T).tobytes()  # bytes of like weight together compress better
                data = squeeze((len(words), keys[start:stop], np.diff(at[start : stop + 1]), planes))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([1], pa.int32()), pa.array([k], pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.array([data], pa.binary())], names=["block", "kind", "number", "sizes", "data"])
                start, k = stop, k + 1

    def encode_words(batches):
        """Sorted by bucket: each distinct word of a bucket is encoded when it comes first."""
        enc = tiktoken_encoding(ranks_path, pattern)
        one, seen, last = enc._core_bpe.encode_single_piece, {}, None
        for b in batches:
            sizes, data = [], []
            for bucket, words in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != last:
                    last, seen = bucket, {}
                ids = []
                for w in words:
                    if (x := seen.get(w)) is None:
                        x = seen[w] = np.array(one(w.encode()), "<u4").tobytes()
                    ids.append(x)
                sizes.append([len(x) // 4 for x in ids])
                data.append(b"".join(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(len(data), np.int32)), b.column(1), pa.array(sizes, pa.list_(pa.int32())), pa.array(data, pa.binary())], names=["block", "kind", "number", "sizes", "data"])

    def put_together(batches):
        vocabulary = tiktoken_ranks(ranks_path)
        size = max(vocabulary.values()) + 1
        texts, shown = [b""] * size, [b"%d " % i for i in range(size)]
        for x, i in vocabulary.items():
            texts[i] = x
        tables = pa.array(texts, pa.binary()), pa.array(shown, pa.binary())  # as large as the vocabulary
        block, held, words = None, [], None
        for b in batches:
            at, of = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])])).tolist() if len(at) else []
            for a, z in zip(edge, [*edge[1:], len(at)], strict=True):
                if at[a] != block:
                    block, held, words = int(at[a]), [], None
                if of[a] == 0:
                    held.append((b.column(3)[a:z].flatten().to_numpy(), b"".join(b.column(4)[a:z].to_pylist())))
                    continue
                if words is None:
                    sizes = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in held)]).astype(np.int64)
                    words = result.prepare(sizes, np.frombuffer(b"".join(x for _, x in held), "<u4"), *tables)
                    n_words, held = len(sizes), []
                for x in b.column(4)[a:z].to_pylist():
                    expected, keys, sizes, planes = unsqueeze(x)
                    if n_words != expected:
                        raise RuntimeError(CHANGED)
                    numbers = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
                    yield result.rows(keys, numbers, np.concatenate([[0], np.cumsum(sizes)]), words)

    words = d.mapInArrow(words_of, "block long, bucket int, words array<string>").repartition(n, "bucket").sortWithinPartitions("bucket")
    both = words.mapInArrow(encode_words, ROW).unionByName(d.mapInArrow(numbers_of, ROW))
    return both.repartition(n, "block").sortWithinPartitions("block", "kind", "number").mapInArrow(put_together, schema)


def by_word(table: pa.Array, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    """For each word, the table's entries of its ids joined."""
    data, ends = gather(table, pa.array(ids, pa.int32()))
    at = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(data)])


class Digests:
    """Digests of the ids and of the decoded bytes."""

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    @staticmethod
    def prepare(counts, ids, texts, shown):
        return counts, by_word(shown, counts, ids), by_word(texts, counts, ids)

    @staticmethod
    def rows(keys, numbers, at, words):
        counts, shown, texts = words
        sums = np.concatenate([[0], np.cumsum(counts[numbers])]) if len(numbers) else np.zeros(1, np.int64)
        (a, a_ends), (b, b_ends) = (gather(x, pa.array(numbers, pa.int32())) for x in (shown, texts))
        n, x, y = np.diff(sums[at]), a_ends[at].tolist(), b_ends[at].tolist()
        ids = [hashlib.sha256(a[p : max(p, q - 1)]).hexdigest() for p, q in zip(x[:-1], x[1:], strict=True)]  # without the last space
        decoded = [hashlib.sha256(b[p:q]).hexdigest() for p, q in zip(y[:-1], y[1:], strict=True)]
        return batch(list(zip(keys, n.tolist(), ids, decoded, strict=True)), ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), (pa.int64(), pa.int64(), pa.string(), pa.string()))


class Tokens:
    """The ids themselves and the decoded bytes."""

    schema = "doc_id long, ids array<int>, decoded binary"

    @staticmethod
    def prepare(counts, ids, texts, shown):
        return joined(ids, counts), by_word(texts, counts, ids)

    @staticmethod
    def rows(keys, numbers, at, words):
        (a, a_ends), (b, b_ends) = (gather(x, pa.array(numbers, pa.int32())) for x in words)
        x, y = a_ends[at].tolist(), b_ends[at].tolist()
        rows = [(k, np.frombuffer(a[x[i] : x[i + 1]], "<u4").tolist(), bytes(b[y[i] : y[i + 1]])) for i, k in enumerate(keys)]
        return batch(rows, ("doc_id", "ids", "decoded"), (pa.int64(), pa.list_(pa.int32()), pa.binary()))


def tokens(docs: DataFrame, ranks_path: str, pattern: str, **cols) -> DataFrame:
    """doc_id, ids and decoded bytes of each row of docs."""
    return encode_decode(docs, ranks_path, pattern, Tokens, Tokens.schema, **cols)


def digests(docs: DataFrame, ranks_path: str, pattern: str, **cols) -> DataFrame:
    return encode_decode(docs, ranks_path, pattern, Digests, Digests.schema, **cols)


def decode(ids: DataFrame, ranks_path: str, key: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """key and text bytes of each row of ids: ids are exploded by position and joined with the table
    of token bytes, which is as large as the vocabulary, then put together in order."""
    spark = ids.sparkSession
    rows = [(i, b) for b, i in tiktoken_ranks(ranks_path).items()]
    bytes_of = F.broadcast(spark.createDataFrame(rows, "token int, bytes binary"))
    named = ids.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(ids_col).alias("ids"))
    one = named.select("key", "row", F.posexplode_outer("ids").alias("pos", "token")).join(bytes_of, "token", "left")
    back = one.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "bytes")))).alias("x"))
    return back.select(F.col("key").alias(key), F.concat(F.lit(b""), F.aggregate("x.bytes", F.lit(b""), lambda a, b: F.concat(a, b))).alias("decoded"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
