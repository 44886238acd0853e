"""Token ids in files with Elias-Fano encoded document boundaries.

Format of a shard (little-endian), the ids of consecutive documents one after another:

    magic "PMEFIDS1", then as 8-byte integers: documents n, ids u, bytes of an id w, low bits l,
    and the byte lengths of the sections
    keys      n 8-byte document ids
    valid     n bits, 0 where the document's id is null
    low       l low bits of each of the n + 1 boundaries
    high      bit (boundary >> l) + i is set for boundary i
    samples   the position in `high` of every SAMPLE-th set bit, 4 bytes each
    ids       u ids of w bytes

The boundaries take about 2 + log2(u / n) bits each; select(i) finds one from a sample and a
short scan, and no table of 64-bit offsets is kept.

Documents are range-partitioned and sorted by id before they are encoded, each partition
streams into shards of about SHARD_BYTES, and a manifest of one row per shard is written with
them. What is read back comes from the files, each document between select(i) and select(i + 1); running sums over the manifest (a small row
for each shard), by parts and within them, give the ids before each shard. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.chunks import Cache, byte_level, encode_pieces, gather, latin, peel, runs, tokenizer
from pagemill.llm.shared import new_path, parts, table, write_atomic, written

MAGIC = b"PMEFIDS1"
HEAD = struct.Struct("<8s9q")
SAMPLE = 64
SHARD_BYTES = 8 << 20


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        l = max(0, (top // max(n, 1)).bit_length() - 1)  # noqa: E741
        low = values & np.uint64((1 << l) - 1)
        bits = (low[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
        at = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, l, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        word = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8], "little")
        return (word >> a % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i: from the sample before it, whole bytes of `high` are skipped by their counts."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = self.high[byte] >> at % 8 << at % 8
        while (found := bits.bit_count()) <= left:
            left -= found
            byte += 1
            bits = self.high[byte]
        for _ in range(left):
            bits &= bits - 1
        return (byte * 8 + (bits & -bits).bit_length() - 1 - i << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """Every value, in one pass over the bits."""
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        at = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        return (at - np.arange(self.n) << self.low_bits) | low

    def nbytes(self) -> int:
        return len(self.low) + len(self.high) + self.samples.nbytes


def pack(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The bytes of a shard; ids: for each document its ids, `width` bytes each."""
    bounds = np.concatenate([[0], np.cumsum([len(x) // width for x in ids], dtype=np.int64)])
    ef = EliasFano.of(bounds)
    sections = [
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.packbits([k is not None for k in keys], bitorder="little").tobytes(),
        ef.low, ef.high, ef.samples.tobytes(),
    ]
    head = HEAD.pack(MAGIC, len(keys), int(bounds[-1]), width, ef.low_bits, *map(len, sections))
    return b"".join([head, *sections, *ids])


class Shard:
    """Reader of a shard: document i has the ids from select(i) up to select(i + 1)."""

    def __init__(self, data):
        data = memoryview(data).cast("B")
        magic, self.n, self.u, self.width, low_bits, *sizes = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        cut, at = [], HEAD.size
        for s in sizes:
            cut.append(data[at : at + s])
            at += s
        valid = np.unpackbits(np.frombuffer(cut[1], np.uint8), bitorder="little")[: self.n]
        self.keys = [k if v else None for k, v in zip(np.frombuffer(cut[0], "<i8").tolist(), valid.tolist(), strict=True)]
        self.bounds = EliasFano(self.n + 1, low_bits, cut[2], cut[3], np.frombuffer(cut[4], "<u4"))
        self.body = data[at:]

    def document(self, i: int) -> tuple[int, np.ndarray]:
        """(ids before it in the shard, its ids)."""
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        return a, np.frombuffer(self.body[a * self.width : b * self.width], f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        return self.document(i)[1]


@lru_cache(maxsize=4)
def _word_ids(path: str, width: int) -> Cache:
    code = "H" if width == 2 else "I"

    def as_model(word):
        word = word.lower()
        return byte_level(word) if latin(word) else None

    def make(keys):
        for ids in encode_pieces(path, keys, as_model):
            yield struct.pack(f"<{len(ids)}{code}", *ids)

    return Cache(make, peel)


def encode(path: str, width: int, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The ids of all texts one after another, and the byte at which each text's begin (and the last's end).

    The tokenizer drops white space and never joins what it parts, so texts are cut at ASCII white
    space, and each distinct word of the run is looked up, or encoded, once. It lower-cases, so
    A to Z are lower-cased first unless that could make a special token of other text.
    """
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = cut.flatten()
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        flat = pc.ascii_lower(flat)
    coded = flat.dictionary_encode()
    data, ends = gather(pa.array(_word_ids(path, width).values(coded.dictionary.to_pylist()), pa.binary()), coded.indices)
    return data, ends[cut.offsets.to_numpy()]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below path/ids in ascending order of id, then of text; returns the manifest
    (shard, part, seq, n_docs, n_ids), itself written. Null ids come first, null texts count as
    empty, rows with the same id stand side by side, an empty table writes no shard."""
    width = 2 if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    end = b"" if end_id is None else int(end_id).to_bytes(width, "little")

    def write(batches):
        from pyspark import TaskContext

        part, seq, rows = TaskContext.get().partitionId(), 0, []
        keys, ids, size = [], [], 0

        def flush():
            nonlocal seq, keys, ids, size
            name = f"part-{part:06d}-{seq:06d}.ids"
            write_atomic(f"{path}/ids/{name}", pack(keys, ids, width))
            rows.append((name, part, seq, len(keys), size // width))
            seq, keys, ids, size = seq + 1, [], [], 0

        for b in (r for whole in batches for r in runs(whole, 1)):
            data, at = encode(tokenizer_path, width, b.column(1))
            at = at.tolist()
            for i, k in enumerate(b.column(0).to_pylist()):
                keys.append(k)
                ids.append(bytes(data[at[i] : at[i + 1]]) + end)
                size += len(ids[-1])
                if size >= SHARD_BYTES:
                    flush()
            del data
        if keys:
            flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["shard", "part", "seq", "n_docs", "n_ids"])

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    sorted_docs = d.repartitionByRange(parts(d), *order[:2]).sortWithinPartitions(*order)
    return written(sorted_docs.mapInArrow(write, "shard string, part long, seq long, n_docs long, n_ids long"), "token-manifest")


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids before the document), n_tokens, ids_crc32 (of the ids as 32-bit integers)."""

    def read(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(memoryview(data.as_buffer()))
                at, n, crc = [], [], []
                for i in range(s.n):
                    a, ids = s.document(i)
                    at.append(a)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * s.n), pa.array(s.keys, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    # ids before each part (one row a part), then before each shard in its part
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = manifest.select("shard", "part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("at_part"))
    bases = within.join(of_parts, "part").select("shard", (F.col("before") + F.col("at_part")).alias("base"))
    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(f"{path}/ids")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(read, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    manifest = write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path, manifest)
