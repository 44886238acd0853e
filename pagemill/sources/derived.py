"""Page catalogs and rasters derived from plain tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, file_path, file_name, n_images; a path may come more than once."""
    k = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (k % 40).cast("string"), F.lit(".tif"))
    return table(spark, sf_dir, "part").select(k.alias("file_id"), F.concat(F.lit("/scans/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), name).alias("file_path"), name.alias("file_name"), (F.col("p_size") % 3 + 1).alias("n_images"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image: img_ord, file_id, file_path, page, width, height, dpi_x, dpi_y."""
    from pagemill.operators.catalog import expand_files

    i = expand_files(files(spark, sf_dir))
    k, p = F.col("file_id"), F.col("page")
    dpis = F.array(*[F.lit(x) for x in (0, 72, 150, 300, 600, 12000)])
    pick = lambda x: F.element_at(dpis, (x % 6 + 1).cast("int"))
    return i.select(
        (k * 4 + p).alias("img_ord"), "file_id", "file_path", "page",
        (600 + (k * 37 + p * 53) % 2400).cast("int").alias("width"), (800 + (k * 61 + p * 17) % 2400).cast("int").alias("height"),
        pick(k + p).alias("dpi_x"), F.when(k % 3 == 0, pick(k * 7 + p)).otherwise(pick(k + p)).alias("dpi_y"),
        (k % 2 + 1).cast("int").alias("sub_pages"), (k % 5 == 1).alias("left_removed"), (k % 7 == 1).alias("right_removed"),
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout settings of most images: margins, content size in mm (-1: unknown), alignment (null: not aligned)."""
    o = F.col("img_ord")
    d = images(spark, sf_dir).where(o % 5 != 0)
    unknown = o % 11 == 0
    return d.select(
        "img_ord", *[(base + o % m).cast("double").alias(c) for c, base, m in (("margin_left", 5, 7), ("margin_top", 4, 3), ("margin_right", 6, 5), ("margin_bottom", 3, 4))],
        F.when(unknown, -1.0).otherwise((80 + o * 13 % 60).cast("double")).alias("content_w"), F.when(unknown, -1.0).otherwise((120 + o * 17 % 90).cast("double")).alias("content_h"),
        F.when(o % 4 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, ("left", "center", "right"))), (o % 3 + 1).cast("int"))).alias("align_h"),
        F.when(o % 4 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, ("top", "center", "bottom"))), (F.floor(o / 3) % 3 + 1).cast("int"))).alias("align_v"),
    )


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, y, x, gray (0 to 255) of rasters of 100 rows."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id"), F.posexplode("embedding").alias("x", "v"))
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 1) * 127.5).cast("int")))
    return v.select(F.floor(F.col("vec_id") / 100).cast("int").alias("img"), (F.col("vec_id") % 100).cast("int").alias("y"), F.col("x").cast("int").alias("x"), level.cast("int").alias("gray"))


def black(spark: SparkSession, sf_dir: str, threshold: int = 118) -> DataFrame:
    """img, y, x of pixels darker than the threshold."""
    return gray(spark, sf_dir).where(F.col("gray") < threshold).select("img", "y", "x")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters with structure: each block of 4 x 4 pixels has the level of its first one."""
    g = gray(spark, sf_dir)
    first = g.where("x % 4 = 0 AND y % 4 = 0")
    step = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return first.withColumn("dy", step).withColumn("dx", step).select("img", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "gray")


#: The same tables for DuckDB, as common table expressions.
SQL = r"""
WITH files AS (SELECT p_partkey AS file_id, '/scans/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '_' || (p_partkey % 40)::VARCHAR || '.tif' AS file_path,
  replace(p_name, ' ', '_') || '_' || (p_partkey % 40)::VARCHAR || '.tif' AS file_name, p_size % 3 + 1 AS n_images FROM part),
expanded AS (SELECT file_id, file_path, CASE WHEN n_images > 1 THEN 1 ELSE 0 END + i AS page FROM files, unnest(range(0, n_images)) AS u(i)),
images AS (SELECT file_id * 4 + page AS img_ord, file_id, file_path, page::INT AS page, (600 + (file_id * 37 + page * 53) % 2400)::INT AS width, (800 + (file_id * 61 + page * 17) % 2400)::INT AS height,
  [0, 72, 150, 300, 600, 12000][(file_id + page) % 6 + 1] AS dpi_x, [0, 72, 150, 300, 600, 12000][CASE WHEN file_id % 3 = 0 THEN (file_id * 7 + page) % 6 ELSE (file_id + page) % 6 END + 1] AS dpi_y,
  (file_id % 2 + 1)::INT AS sub_pages, file_id % 5 = 1 AS left_removed, file_id % 7 = 1 AS right_removed FROM expanded),
settings AS (SELECT img_ord, (5 + img_ord % 7)::DOUBLE AS margin_left, (4 + img_ord % 3)::DOUBLE AS margin_top, (6 + img_ord % 5)::DOUBLE AS margin_right, (3 + img_ord % 4)::DOUBLE AS margin_bottom,
  CASE WHEN img_ord % 11 = 0 THEN -1.0 ELSE 80 + img_ord * 13 % 60 END::DOUBLE AS content_w, CASE WHEN img_ord % 11 = 0 THEN -1.0 ELSE 120 + img_ord * 17 % 90 END::DOUBLE AS content_h,
  CASE WHEN img_ord % 4 = 0 THEN NULL ELSE ['left', 'center', 'right'][img_ord % 3 + 1] END AS align_h, CASE WHEN img_ord % 4 = 0 THEN NULL ELSE ['top', 'center', 'bottom'][img_ord // 3 % 3 + 1] END AS align_v
  FROM images WHERE img_ord % 5 <> 0),
gray AS (SELECT (vec_id // 100)::INT AS img, (vec_id % 100)::INT AS y, (i - 1)::INT AS x, least(255, greatest(0, floor((embedding[i]::DOUBLE + 1) * 127.5::DOUBLE)))::INT AS gray FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)),
black AS (SELECT img, y, x FROM gray WHERE gray < 118),
blocks AS (SELECT img, (y + j)::INT AS y, (x + i)::INT AS x, gray FROM gray, unnest(range(4)) AS a(j), unnest(range(4)) AS b(i) WHERE x % 4 = 0 AND y % 4 = 0)
"""
