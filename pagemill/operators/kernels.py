"""Array kernels over tables with an image a row, in Arrow batches of few rows.

An image row is img, height, width, data: the bytes of a gray plane, or of 0 and 1 for a binary one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "img int, height int, width int, data binary"


class Columns(tuple):
    """Arrays of equal length, one for each column of a kernel's result."""


def to_images(pixels: DataFrame, value: str = "gray", width: int = 0, height: int = 0, seen: bool = False) -> DataFrame:
    """Image rows from (img, y, x, value), of this size or as large as the pixels need; missing pixels are 0. seen: one more column, `seen`, the bytes of
    a plane with 1 for pixels that were given. One image is one task's work, whatever its size."""
    cells = [F.collect_list(F.col(c).cast("int")).alias(n) for c, n in (("y", "ys"), ("x", "xs"), (value, "vs"))]
    whole = pixels.where(F.col("y").isNotNull() & F.col("x").isNotNull()).withColumn(value, F.coalesce(F.col(value).cast("int"), F.lit(0))).groupBy("img").agg(*cells)

    def draw(batches):
        for b in batches:
            at = b.column(1).offsets.to_numpy()
            img, (ys, xs, vs) = b.column(0).to_pylist(), (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for k, (lo, hi) in enumerate(zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)):
                y, x = ys[lo:hi], xs[lo:hi]
                h, w = max(height, int(y.max()) + 1), max(width, int(x.max()) + 1)
                planes = [np.zeros((h, w), np.uint8) for _ in names[3:]]
                for a, v in zip(planes, (vs[lo:hi], 1), strict=False):
                    a[y, x] = v
                yield pa.RecordBatch.from_arrays([pa.array([img[k]], pa.int32()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in planes)], names=names)

    schema = IMAGE + ", seen binary" * seen
    names = [x.split()[0] for x in schema.split(", ")]
    return whole.mapInArrow(draw, schema)


def mapped(images: DataFrame, f, schema: str, binary: bool = False, seen: bool = False) -> DataFrame:
    """f(image array) gives rows of `schema` without img, as Columns or as a list of tuples; img is put before them. seen: f(image array, the pixels given)."""

    def run(batches):
        for b in batches:
            for img, h, w, *planes in zip(*(b.column(i).to_pylist() for i in range(len(columns))), strict=True):
                a, *given = (np.frombuffer(data, np.uint8).reshape(h, w) for data in planes)
                found = f(a.astype(bool) if binary else a, *(x.astype(bool) for x in given))
                if not isinstance(found, Columns):
                    found = Columns(zip(*found, strict=True))
                if found and len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), img, np.int64)), *map(pa.array, found)], names=names)

    names = ["img", *[x.split()[0] for x in schema.split(",")]]
    columns = ["img", "height", "width", "data"] + ["seen"] * seen
    return images.select(*columns).mapInArrow(run, f"img long, {schema}")


def as_pixels(a: np.ndarray, of: np.ndarray | None = None) -> Columns:
    """y, x, value of every cell, or of those of a mask."""
    y, x = np.indices(a.shape).reshape(2, -1) if of is None else np.nonzero(of)
    return Columns((y, x, a[y, x].astype(np.int64)))


def as_black(b: np.ndarray) -> Columns:
    return Columns(np.nonzero(b))
