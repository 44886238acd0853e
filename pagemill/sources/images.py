"""Image files as tables: metadata (a row for each page of a file) and decoded gray planes.

spark.read.format("binaryFile") lists and reads; headers are parsed with struct. PNG (not interlaced), PGM and TIFF in strips
(gray, palette or RGB of 1 to 16 bits a sample; uncompressed, LZW, deflate or PackBits) are decoded to gray; JPEG gives metadata.
What can't be read gives a row with `error` and nulls.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "file_path string, page int, width int, height int, dpi_x int, dpi_y int, error string"
PLANES = "file_path string, page int, height int, width int, data binary, error string"
PNG, INCH_M = b"\x89PNG\r\n\x1a\n", 0.0254


def _dots(per_metre: float) -> int:
    return int(per_metre * INCH_M + 0.5)


def png_metadata(data: bytes) -> list[tuple[int, int, int, int]] | None:
    if not data.startswith(PNG):
        return None
    w, h = struct.unpack_from(">2I", data, 16)
    at, dpi = 8, (0, 0)
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"pHYs":
            x, y, unit = struct.unpack_from(">2IB", data, at + 8)
            dpi = (_dots(x), _dots(y)) if unit == 1 else (0, 0)
        if kind in (b"IDAT", b"IEND"):
            break
        at += 12 + n
    return [(w, h, *dpi)]


def jpeg_metadata(data: bytes) -> list[tuple[int, int, int, int]] | None:
    if not data.startswith(b"\xff\xd8"):
        return None
    at, dpi = 2, (0, 0)
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            break
        kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if kind == 0xE0 and data[at + 4 : at + 9] == b"JFIF\0":
            unit, x, y = struct.unpack_from(">BHH", data, at + 11)
            dpi = {1: (x, y), 2: (int(x * 2.54 + 0.5), int(y * 2.54 + 0.5))}.get(unit, (0, 0))
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return [(w, h, *dpi)]
        at += 2 + n
    return None


#: Fixed values of the format: tag numbers and the sizes of its types.
TIFF_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 282: "x_res", 283: "y_res", 296: "unit", 317: "predictor", 320: "colors"}
TIFF_TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II")}


def tiff_directories(data: bytes) -> list[dict] | None:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return None
    found, at = [], struct.unpack_from(order + "I", data, 4)[0]
    while at and len(found) < 65536:
        n = struct.unpack_from(order + "H", data, at)[0]
        d: dict = {"order": order}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if tag not in TIFF_TAGS or kind not in TIFF_TYPES:
                continue
            size, code = TIFF_TYPES[kind]
            place = at + 10 + 12 * k
            if size * count > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            values = struct.unpack_from(order + code * count, data, place)
            d[TIFF_TAGS[tag]] = [a / b if b else 0 for a, b in zip(values[::2], values[1::2], strict=True)] if kind == 5 else list(values)
        found.append(d)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return found


def tiff_metadata(data: bytes) -> list[tuple[int, int, int, int]] | None:
    found = tiff_directories(data)
    if found is None:
        return None
    out = []
    for d in found:
        unit = d.get("unit", [2])[0]
        scale = {2: 1.0, 3: 2.54}.get(unit, 0.0)
        out.append((d["width"][0], d["height"][0], int(d.get("x_res", [0])[0] * scale + 0.5), int(d.get("y_res", [0])[0] * scale + 0.5)))
    return out


def pgm_metadata(data: bytes) -> list[tuple[int, int, int, int]] | None:
    if not data.startswith(b"P5"):
        return None
    w, h = data.split(None, 4)[1:3]
    return [(int(w), int(h), 0, 0)]


#: Tried in order; the first that knows the format answers.
LOADERS = [tiff_metadata, png_metadata, jpeg_metadata, pgm_metadata]


def metadata_of(data: bytes) -> list[tuple[int, int, int, int]] | None:
    return next((m for load in LOADERS if (m := load(data)) is not None), None)


def lzw_decode(data: bytes) -> bytes:
    """Variable codes of 9 to 12 bits, most significant first; 256 clears, 257 ends; codes grow one entry early."""
    out, table, bits, acc, n, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        acc, n = (acc << 8 | byte) & 0xFFFFFF, n + 8
        if n < bits:
            continue
        code = acc >> (n - bits) & ((1 << bits) - 1)
        n -= bits
        if code == 257:
            break
        if code == 256:
            table, bits, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, n = bytearray(), 0, 0
    table, size, bits = {bytes([i]): i for i in range(256)}, 258, 9

    def put(code):
        nonlocal acc, n
        acc, n = acc << bits | code, n + bits
        while n >= 8:
            n -= 8
            out.append(acc >> n & 255)
        acc &= (1 << n) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        bits = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256)
            table, size, bits = {bytes([k]): k for k in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        bits = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if n:
        out.append(acc << (8 - n) & 255)
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    """Runs: n from 0 to 127 is followed by n + 1 bytes as they are, from 129 to 255 by one byte that comes 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


#: Fixed values of the format: compressions that are decoded.
TIFF_DECODERS = {1: bytes, 5: lzw_decode, 8: zlib.decompress, 32773: packbits_decode, 32946: zlib.decompress}


def to_gray(px: np.ndarray) -> np.ndarray:
    """Gray of the first three channels of (h, w, channels)."""
    px = px.astype(np.int64)
    return ((px[..., 0] * 11 + px[..., 1] * 16 + px[..., 2] * 5) >> 5).astype(np.uint8)


def samples_of(raw: np.ndarray, bits: int, n: int, big_endian: bool = True) -> np.ndarray:
    """(rows, n) samples of packed rows of bytes, as they are; of 16 bits the upper 8."""
    if bits == 8:
        return raw[:, :n]
    if bits == 16:
        return raw[:, (0 if big_endian else 1) : 2 * n : 2]
    each = np.unpackbits(raw, axis=1).reshape(len(raw), -1, bits)[:, :n]
    return (each @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)


def tiff_plane(data: bytes, page: int) -> np.ndarray:
    """A gray plane."""
    d = tiff_directories(data)[page]
    w, h, bits, channels, kind = d["width"][0], d["height"][0], d.get("bits", [1])[0], d.get("samples", [1])[0], d.get("photometric", [1])[0]
    decode = TIFF_DECODERS.get(d.get("compression", [1])[0])
    if decode is None or bits not in (1, 2, 4, 8, 16) or kind not in (0, 1, 2, 3) or channels not in (1, 2, 3, 4) or "offsets" not in d or (kind == 2) != (channels > 2):
        raise ValueError("this kind of TIFF is not decoded")
    stride, rows, parts, at = (w * channels * bits + 7) // 8, d.get("rows", [h])[0], [], 0
    for a, n in zip(d["offsets"], d["counts"], strict=True):
        k = min(rows, h - at)
        raw = np.frombuffer(decode(data[a : a + n]), np.uint8, stride * k).reshape(k, stride)
        part = samples_of(raw, bits, w * channels, d["order"] == ">").reshape(k, w, channels)
        if d.get("predictor", [1])[0] == 2 and bits == 8:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        parts.append(part)
        at += k
    px = np.concatenate(parts)
    if kind == 3:
        colors = (np.array(d["colors"]).reshape(3, -1) >> 8).T
        return to_gray(colors[px[..., 0]])
    if kind == 2:
        return to_gray(px if bits in (8, 16) else px.astype(np.int64) * 255 // ((1 << bits) - 1))
    g = px[..., 0] if bits in (8, 16) else (px[..., 0].astype(np.int64) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    return np.ascontiguousarray(255 - g if kind == 0 else g)


def tiff_bytes(g: np.ndarray, dpi: tuple[int, int] = (0, 0)) -> bytes:
    """An LZW TIFF of a gray plane (uint8), of a binary one (bool, True is black), or of RGB (height, width, 3)."""
    binary, color = g.dtype == bool, g.ndim == 3
    raw = np.packbits(~g, axis=1).tobytes() if binary else g.tobytes()
    body = lzw_encode(raw)
    h, w = g.shape[:2]
    at = 8 + len(body) + len(body) % 2
    extra = at + 2 + 12 * 12 + 4
    bits = (258, 3, 3, extra + 16) if color else (258, 3, 1, 1 if binary else 8)
    tags = [(256, 4, 1, w), (257, 4, 1, h), bits, (259, 3, 1, 5), (262, 3, 1, 2 if color else 1), (273, 4, 1, 8), (277, 3, 1, 3 if color else 1), (278, 4, 1, h), (279, 4, 1, len(body)), (282, 5, 1, extra), (283, 5, 1, extra + 8), (296, 3, 1, 2)]
    entries = b"".join(struct.pack("<HHII", *t) for t in tags)
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + struct.pack("<4I", dpi[0], 1, dpi[1], 1) + struct.pack("<3H", 8, 8, 8)


def png_bytes(g: np.ndarray, dpi: tuple[int, int] = (0, 0)) -> bytes:
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.pad(g, ((0, 0), (1, 0))).tobytes()
    phys = struct.pack(">2IB", *[int(x / INCH_M + 0.5) for x in dpi], 1)
    return PNG + chunk(b"IHDR", struct.pack(">2I5B", g.shape[1], g.shape[0], 8, 0, 0, 0, 0)) + chunk(b"pHYs", phys) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_plane(data: bytes) -> np.ndarray:
    """A gray plane."""
    w, h, depth, color, _, _, interlace = struct.unpack_from(">2I5B", data, 16)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if interlace or channels is None:
        raise ValueError("this kind of PNG is not decoded")
    step, stride, palette = max(1, channels * depth // 8), (w * channels * depth + 7) // 8, b""
    at, body = 8, b""
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        elif kind == b"PLTE":
            palette = data[at + 8 : at + 8 + n]
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + stride)
    out, before = np.zeros((h, stride), np.uint8), np.zeros(stride, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + before
        elif kind:
            line = line.copy()
            for x in range(len(line)):
                a = line[x - step] & 255 if x >= step else 0
                b, c = before[x], before[x - step] if x >= step else 0
                if kind == 1:
                    line[x] += a
                elif kind == 3:
                    line[x] += (a + b) // 2
                else:
                    p = a + b - c
                    line[x] += min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                line[x] &= 255
        out[y] = before = line & 255
    px = samples_of(out, depth, w * channels).reshape(h, w, channels)
    if color == 3:
        return to_gray(np.frombuffer(palette, np.uint8).reshape(-1, 3)[px[..., 0]])
    if channels > 2:
        return to_gray(px)
    return np.ascontiguousarray(px[..., 0] if depth >= 8 else (px[..., 0].astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8))


def plane_of(data: bytes, page: int) -> np.ndarray:
    """page: 0 for single-image files, else from 1; formats other than TIFF have page 0 only."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return tiff_plane(data, max(0, page - 1))
    if page:
        raise ValueError("the file has one page")
    if data.startswith(PNG):
        return png_plane(data)
    if data.startswith(b"P5"):
        _, w, h, _, rest = data.split(None, 4) if data.count(b"\n") < 2 else (*data.split(None, 4)[:4], data.split(b"\n", 3)[-1])
        return np.frombuffer(rest[-int(w) * int(h) :], np.uint8).reshape(int(h), int(w))
    raise ValueError("unknown format")


def read_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """METADATA, a row for each image of each file, files in the order of their names when sorted by file_path, page."""

    def parse(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    found = metadata_of(data.as_py())
                    if found is None:
                        raise ValueError("unknown format")
                    rows += [(path, i + (len(found) > 1), *m, None) for i, m in enumerate(found)]
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), *[pa.int32()] * 5, pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in METADATA.split(", ")])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(parse, METADATA)


def read_planes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """PLANES, a row for each image of each file."""

    def decode(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, rows = data.as_py(), []
                try:
                    n = len(metadata_of(data) or [0])
                    for i in range(n):
                        g = plane_of(data, i + (n > 1))
                        rows.append((path, i + (n > 1), *g.shape, g.tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PLANES.split(", ")])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(decode, PLANES)


def as_tiff(images: DataFrame, dpi: tuple[int, int] = (0, 0), binary: bool = False) -> DataFrame:
    """img and the bytes of a TIFF, of image rows (see operators.kernels)."""

    def encode(batches):
        for b in batches:
            rows = []
            for img, h, w, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                g = np.frombuffer(data, np.uint8).reshape(h, w)
                rows.append((img, tiff_bytes(g.astype(bool) if binary else g, dpi)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["img", "tiff"])

    return images.select("img", "height", "width", "data").mapInArrow(encode, "img long, tiff binary")


def write_file(uri: str, data: bytes) -> None:
    """A file at a path or uri; it appears whole, and a repeated task replaces it by the same."""
    if "://" in uri and not uri.startswith("file:"):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        temp = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(temp) as out:
            out.write(data)
        system.move(temp, path)
        return
    path = os.path.abspath(re.sub("^file:/*", "/", uri))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temp = f"{path}.{uuid.uuid4().hex}"
    with open(temp, "wb") as out:
        out.write(data)
    os.replace(temp, path)


def write_tiffs(pictures: DataFrame, folder: str, dpi: tuple[int, int] = (0, 0)) -> DataFrame:
    """name and size of the files written below a folder that all executors share. pictures: name, height, width, data, binary (black and
    white: 0 is black in a gray plane, 1 in a mask)."""

    def write(batches):
        for b in batches:
            rows = []
            for name, h, w, data, binary in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                g = np.frombuffer(data, np.uint8).reshape(h, w)
                body = tiff_bytes((g == 1) if binary and name.startswith("cache/") else (g < 128) if binary else g, dpi)
                write_file(f"{folder}/{name}", body)
                rows.append((name, len(body)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["name", "size"])

    return pictures.select("name", "height", "width", "data", "binary").mapInArrow(write, "name string, size long")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """Names from a text of white-space separated names."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), "\\s+")).alias("file_path")).where("file_path <> ''")
