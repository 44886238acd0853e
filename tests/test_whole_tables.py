"""Raster queries over every image of the table."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import catalog
from pagemill.plans import kernel_queries, pixel_queries
from pagemill.sources import derived


@pytest.fixture(scope="module")
def gray(spark, sf_dir):
    """The levels of each image."""
    out = {}
    for r in derived.gray(spark, sf_dir).collect():
        out.setdefault(r.img, np.zeros((100, 64), int))[r.y, r.x] = r.gray
    assert len(out) > 1
    return out


def test_distance_maps_of_every_image(spark, sf_dir, gray):
    found = {k: np.full(a.shape, -1) for k, a in gray.items()}
    rows = kernel_queries.kernel_distance_map(spark, sf_dir).collect()
    for r in rows:
        found[r.img][r.y, r.x] = r.v
    assert len(rows) == sum(a.size for a in gray.values())
    for k, a in gray.items():
        white = np.argwhere(np.pad(a >= 105, 1, constant_values=True)) - 1
        y, x = np.indices(a.shape)
        want = ((y[..., None] - white[:, 0]) ** 2 + (x[..., None] - white[:, 1]) ** 2).min(axis=-1)
        assert np.array_equal(found[k], want)


BOTH = {
    "invert": lambda a, b: 255 - a, "clipped_subtract": lambda a, b: np.maximum(a - b, 0), "unclipped_subtract": lambda a, b: (a - b) % 256, "clipped_add": lambda a, b: np.minimum(a + b, 255),
    "unclipped_add": lambda a, b: (a + b) % 256, "darkest": np.minimum, "lightest": np.maximum,
}


@pytest.mark.parametrize("op", sorted(BOTH))
def test_gray_operations_of_every_image(spark, sf_dir, gray, op):
    found = {(r.img, r.y, r.x): r.gray for r in pixel_queries.QUERIES[f"gray_{op}"](spark, sf_dir).collect()}
    want = {k: BOTH[op](a, np.roll(a, 1, axis=1)) for k, a in gray.items()}
    assert found == {(k, y, x): v for k, a in want.items() for (y, x), v in np.ndenumerate(a)}


def test_upscale_of_every_image(spark, sf_dir, gray):
    found = sorted((r.img, r.y, r.x) for r in pixel_queries.integer_upscale(spark, sf_dir).collect())
    assert found == sorted((k, y, x) for k, a in gray.items() for y, x in np.argwhere(np.kron(a < 118, np.ones((2, 3)))).tolist())


def test_polygon_of_every_image(spark, sf_dir, gray):
    found = {}
    for r in kernel_queries.kernel_polygon(spark, sf_dir).collect():
        found.setdefault(r.img, set()).add((r.y, r.x))
    assert set(found) == set(gray)
    assert len({frozenset(v) for v in found.values()}) == 1 and (30, 40) in found[0]


def test_dense_positions_of_many_rows(spark):
    """More rows than the sampled bounds of a range partitioning are exact for, in partitions that are merged when only keys are read."""
    wide = spark.range(400_000).select(F.xxhash64("id").alias("key"), F.concat_ws(" ", *[F.sha2((F.col("id") + k).cast("string"), 512) for k in range(3)]).alias("text"))
    found = catalog.ordered(wide, "key").select("key", "ord", F.length("text").alias("n")).toPandas().sort_values("ord")
    assert found["ord"].tolist() == list(range(400_000))
    assert found["key"].is_monotonic_increasing and (found["n"] == 386).all()


@pytest.fixture(scope="module")
def cut_dir(tmp_path_factory):
    """Rasters of which the last one ends after 56 rows and lacks one more."""
    folder = str(tmp_path_factory.mktemp("cut"))
    duckdb.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 256 AND vec_id <> 230) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["dewarped_flat", "kernel_scaled", "kernel_sheared", "kernel_sobel", "hough_lines", "kernel_blurred", "kernel_eroded", "kernel_smoothed"])
def test_rasters_that_lack_rows(spark, cut_dir, name):
    found = kernel_queries.QUERIES[name](spark, cut_dir)
    want = duckdb.connect().execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{cut_dir}/embeddings.parquet')").execute(kernel_queries.SQL[name])
    names = [c[0] for c in want.description]
    rows = lambda of: sorted(tuple(round(v, 9) for v in r) for r in of)
    assert rows(found.select(*names).collect()) == rows(want.fetchall())
