"""Queries over rasters in relational form, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import pixels
from pagemill.sources import derived

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Of the derived rasters.
WIDTH, HEIGHT = 64, 100


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = derived.SQL + sql
        return f

    return keep


def sizes(black: DataFrame, n: int) -> DataFrame:
    return black.select("img").distinct().withColumn("size", F.lit(n))


HIST = ", hist AS (SELECT g.img, l.gray::INT AS gray, count(p.gray) AS n FROM (SELECT DISTINCT img FROM gray) g CROSS JOIN (SELECT unnest(range(256)) AS gray) l LEFT JOIN gray p ON p.img = g.img AND p.gray = l.gray GROUP BY g.img, l.gray)\n"


@query(HIST + "SELECT img, gray, n FROM hist")
def gray_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pixels.histogram(derived.gray(spark, d))


@query(HIST.replace("gray p ON", "(SELECT * FROM gray WHERE (x + y) % 3 = 0) p ON") + "SELECT img, gray, n FROM hist")
def gray_histogram_masked(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the pixels that a mask has; the mask is a set of pixels."""
    g = derived.gray(spark, d)
    mask = g.where("(x + y) % 3 = 0").select("img", "y", "x")
    return pixels.histogram(g.join(mask, ["img", "y", "x"], "left_semi"))


OTSU = HIST + """, c AS (SELECT img, gray, sum(n) OVER w AS b, sum(n * gray) OVER w AS mb, sum(n) OVER (PARTITION BY img) AS t, sum(n * gray) OVER (PARTITION BY img) AS mt FROM hist WINDOW w AS (PARTITION BY img ORDER BY gray)),
v AS (SELECT img, gray, CASE WHEN b > 0 AND t > b THEN ((mt - mb)::DOUBLE / (t - b) - mb::DOUBLE / b) * ((mt - mb)::DOUBLE / (t - b) - mb::DOUBLE / b) * b * (t - b) END AS v FROM c),
m AS (SELECT *, max(v) OVER (PARTITION BY img) AS top FROM v)
SELECT img, coalesce((min(gray) FILTER (v = top AND top > 0) + max(gray) FILTER (v = top AND top > 0) + 2) >> 1, 0)::INT AS threshold FROM m GROUP BY img"""


@query(OTSU)
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return pixels.otsu(derived.gray(spark, d))


@query(""", m AS (SELECT a.img, a.gray, min(b.gray) AS m FROM gray a JOIN gray b ON a.img = b.img AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3
WHERE a.x >= 3 AND a.y >= 3 AND a.x < 61 AND a.y < 97 GROUP BY a.img, a.y, a.x, a.gray),
s AS (SELECT img, sum(m + gray) AS s, count(*) AS n FROM m WHERE gray >= m + 20 GROUP BY img)
SELECT img, CASE WHEN n > 0 THEN floor((s + n)::DOUBLE / (2 * n))::INT ELSE 128 END AS threshold FROM (SELECT DISTINCT img FROM gray) LEFT JOIN s USING (img)""")
def mokji_threshold(spark: SparkSession, d: str) -> DataFrame:
    return pixels.mokji(derived.gray(spark, d))


LOCAL = """, l AS (SELECT a.img, a.y, a.x, a.gray, sum(b.gray)::DOUBLE / count(*) AS mean, sum(b.gray * b.gray)::DOUBLE / count(*) AS sq FROM gray a
JOIN gray b ON a.img = b.img AND b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 3 AND a.y + 2 GROUP BY a.img, a.y, a.x, a.gray), st AS (SELECT *, sqrt(abs(sq - mean * mean)) AS sigma FROM l)
"""


@query(LOCAL + "SELECT img, y, x, gray < mean * (1 + 0.34::DOUBLE * (sigma / 128 - 1)) AS black FROM st")
def sauvola_binarization(spark: SparkSession, d: str) -> DataFrame:
    return pixels.sauvola(derived.gray(spark, d), 9, 6)


@query(LOCAL + """, f AS (SELECT *, mean::FLOAT::DOUBLE AS mf, sigma::FLOAT::DOUBLE AS sf FROM st)
SELECT f.img, y, x, CASE WHEN gray < 1 THEN true WHEN gray > 254 THEN false ELSE coalesce(gray < mf - 0.3::DOUBLE * (1 - sf / nullif(top, 0)) * (mf - dark), false) END AS black
FROM f JOIN (SELECT img, max(sf) AS top, min(gray) AS dark FROM f GROUP BY img) o ON o.img = f.img""")
def wolf_binarization(spark: SparkSession, d: str) -> DataFrame:
    return pixels.wolf(derived.gray(spark, d), 9, 6)


@query("SELECT a.img, a.y, a.x, min(b.gray) AS out FROM gray a JOIN gray b ON a.img = b.img AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.img, a.y, a.x")
def dilated_gray(spark: SparkSession, d: str) -> DataFrame:
    return pixels.dilate_gray(derived.gray(spark, d), 5, 3).select("img", "y", "x", "out")


@query("SELECT a.img, a.y, a.x, max(b.gray) AS out FROM gray a JOIN gray b ON a.img = b.img AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.img, a.y, a.x")
def eroded_gray(spark: SparkSession, d: str) -> DataFrame:
    return pixels.erode_gray(derived.gray(spark, d), 5, 3).select("img", "y", "x", "out")


@query("SELECT i.img, r.y::INT AS at, count(b.x) AS n FROM (SELECT DISTINCT img FROM black) i CROSS JOIN (SELECT unnest(range(100)) AS y) r LEFT JOIN black b ON b.img = i.img AND b.y = r.y GROUP BY i.img, r.y")
def row_projection(spark: SparkSession, d: str) -> DataFrame:
    b = derived.black(spark, d)
    return pixels.projection(b, "y", sizes(b, HEIGHT))


@query("SELECT i.img, r.x::INT AS at, count(b.y) AS n FROM (SELECT DISTINCT img FROM black) i CROSS JOIN (SELECT unnest(range(64)) AS x) r LEFT JOIN black b ON b.img = i.img AND b.x = r.x GROUP BY i.img, r.x")
def column_projection(spark: SparkSession, d: str) -> DataFrame:
    b = derived.black(spark, d)
    return pixels.projection(b, "x", sizes(b, WIDTH))


@query(""", dark AS (SELECT DISTINCT img, y FROM gray WHERE gray < 92), g AS (SELECT img, y, y - lag(y) OVER (PARTITION BY img ORDER BY y) - 1 AS gap FROM dark),
s AS (SELECT img, y, sum(CASE WHEN gap >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY img ORDER BY y) AS span FROM g)
SELECT img, min(y) AS from_, max(y) + 1 AS to_ FROM s GROUP BY img, span HAVING max(y) + 1 - min(y) >= 2""")
def content_spans(spark: SparkSession, d: str) -> DataFrame:
    b = derived.black(spark, d, 92)
    return pixels.content_spans(pixels.projection(b, "y", sizes(b, HEIGHT)), 2, 3)


@query("SELECT img, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom, count(*) AS n_black FROM black GROUP BY img")
def content_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return pixels.bounding_boxes(derived.black(spark, d))


@query("SELECT img, min(gray) AS darkest FROM gray GROUP BY img")
def darkest_level(spark: SparkSession, d: str) -> DataFrame:
    return derived.gray(spark, d).groupBy("img").agg(F.min("gray").alias("darkest"))


@query("SELECT i.img, count(b.x) AS n_black, 20 * 30 - count(b.x) AS n_white FROM (SELECT DISTINCT img FROM gray) i LEFT JOIN black b ON b.img = i.img AND b.x BETWEEN 10 AND 29 AND b.y BETWEEN 5 AND 34 GROUP BY i.img")
def counts_in_rectangle(spark: SparkSession, d: str) -> DataFrame:
    b = derived.black(spark, d).where("x BETWEEN 10 AND 29 AND y BETWEEN 5 AND 34").groupBy("img").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return derived.gray(spark, d).select("img").distinct().join(b, "img", "left").select("img", n.alias("n_black"), (F.lit(600) - n).cast("long").alias("n_white"))


@query("SELECT img, y // 2 AS y, x // 2 AS x FROM black GROUP BY img, y // 2, x // 2 HAVING count(*) >= 2")
def threshold_reduction(spark: SparkSession, d: str) -> DataFrame:
    return pixels.reduce_2x(derived.black(spark, d), 2)


@query("SELECT img, y, x + floor(0.2::DOUBLE * (y + 0.5 - 50) + 0.5)::INT AS x FROM black")
def horizontal_shear(spark: SparkSession, d: str) -> DataFrame:
    return pixels.shear_rows(derived.black(spark, d), F.lit(0.2), F.lit(50)).select("img", "y", "x")


@query("SELECT img, x AS y, 99 - y AS x FROM black")
def quarter_rotation(spark: SparkSession, d: str) -> DataFrame:
    return pixels.rotate_quarter(derived.black(spark, d), 90, WIDTH, HEIGHT)


@query("SELECT img, y * 2 + j AS y, x * 3 + i AS x FROM black, (SELECT unnest(range(2))::INT AS j), (SELECT unnest(range(3))::INT AS i)")
def integer_upscale(spark: SparkSession, d: str) -> DataFrame:
    return pixels.upscale(derived.black(spark, d), 3, 2)


ANGLES = [float(a) for a in range(-7, 8)]
TANS = ", ".join(f"({a}::DOUBLE, {math.tan(math.radians(a))!r}::DOUBLE)" for a in ANGLES)


@query(f""", a AS (SELECT * FROM (VALUES {TANS}) AS v(degrees, t)), m AS (SELECT img, degrees, y + floor(t * (x + 0.5 - 32) + 0.5)::INT AS y FROM black, a),
n AS (SELECT i.img, a.degrees, r.y, count(m.y) AS n FROM (SELECT DISTINCT img FROM black) i CROSS JOIN a CROSS JOIN (SELECT unnest(range(100)) AS y) r LEFT JOIN m ON m.img = i.img AND m.degrees = a.degrees AND m.y = r.y GROUP BY i.img, a.degrees, r.y),
l AS (SELECT *, n - lag(n) OVER (PARTITION BY img, degrees ORDER BY y) AS diff FROM n)
SELECT img, degrees, sum(diff * diff)::BIGINT AS score FROM l GROUP BY img, degrees""")
def skew_scores(spark: SparkSession, d: str) -> DataFrame:
    return pixels.skew_scores(derived.black(spark, d), ANGLES, WIDTH, HEIGHT)


UV = ", ".join(f"({a}::DOUBLE, {math.cos(math.radians(a))!r}::DOUBLE, {math.sin(math.radians(a))!r}::DOUBLE)" for a in (-5.0, 0.0, 5.0, 90.0))


@query(f"SELECT img, degrees, floor((x * u + y * v + 20) / 2 + 0.5)::INT AS bin, count(*) AS weight FROM black, (SELECT * FROM (VALUES {UV}) AS t(degrees, u, v)) GROUP BY img, degrees, bin")
def hough_votes(spark: SparkSession, d: str) -> DataFrame:
    return pixels.hough(derived.black(spark, d), [-5.0, 0.0, 5.0, 90.0], 2.0, 20.0)


@query(HIST + """, s AS (SELECT img, gray, sum(n) OVER (PARTITION BY img ORDER BY gray ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM hist), b AS (SELECT img, gray AS start, s FROM s WHERE gray <= 246 QUALIFY row_number() OVER (PARTITION BY img ORDER BY s DESC, gray) = 1),
c AS (SELECT h.img, h.gray, sum(n) OVER (PARTITION BY h.img ORDER BY h.gray) AS upto, s FROM hist h JOIN b ON b.img = h.img AND h.gray BETWEEN start AND start + 9)
SELECT img, min(gray) AS level FROM c WHERE upto * 2 >= s GROUP BY img""")
def dominant_background(spark: SparkSession, d: str) -> DataFrame:
    return pixels.dominant_level(derived.gray(spark, d))


def two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = derived.black(spark, d)
    return b, b.withColumn("x", F.col("x") + 1)


for op, words in (("and", "INTERSECT"), ("or", "UNION"), ("subtract", "EXCEPT")):

    def one(spark: SparkSession, d: str, op=op) -> DataFrame:
        return pixels.raster_op(*two(spark, d), op)

    one.__name__ = f"raster_{op}"
    query(f"SELECT * FROM black {words} SELECT img, y, x + 1 AS x FROM black")(one)


@query(", b AS (SELECT img, y, x + 1 AS x FROM black) (SELECT * FROM black EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM black)")
def raster_xor(spark: SparkSession, d: str) -> DataFrame:
    return pixels.raster_op(*two(spark, d), "xor")


@query("""SELECT * FROM (SELECT img, y, x FROM gray) c WHERE ((img, y, x) IN (SELECT (img, y, x) FROM black)) <> ((img, y, x) IN (SELECT (img, y, x + 1) FROM black) AND NOT (img, y, x) IN (SELECT (img, y + 1, x) FROM black))
OR ((img, y, x) IN (SELECT (img, y, x + 1) FROM black) AND (img, y, x) IN (SELECT (img, y + 1, x) FROM black))""")
def raster_expression(spark: SparkSession, d: str) -> DataFrame:
    """A raster, itself a column on and itself a row on: (a xor (b and not c)) or (b and c)."""
    b = derived.black(spark, d)
    three = {"a": b, "b": b.withColumn("x", F.col("x") + 1), "c": b.withColumn("y", F.col("y") + 1)}
    return pixels.raster_expression(derived.gray(spark, d), three, lambda k: (k["a"] != (k["b"] & ~k["c"])) | (k["b"] & k["c"]))


@query("SELECT img, y, x FROM gray WHERE (img, y, x) IN (SELECT (img, y, x) FROM black) OR NOT (img, y, x) IN (SELECT (img, y, x + 1) FROM black)")
def raster_subtract_white(spark: SparkSession, d: str) -> DataFrame:
    """Black, or not white in the other raster's sense: the white of one taken from the white of the other."""
    a, b = two(spark, d)
    return pixels.raster_expression(derived.gray(spark, d), {"a": a, "b": b}, lambda k: k["a"] | ~k["b"])


@query("SELECT a.img, a.y, a.x, ((a.gray + b.gray * 2 + c.gray) // 4)::INT AS gray FROM gray a JOIN gray b ON a.img = b.img AND a.y = b.y AND a.x = b.x + 1 JOIN gray c ON a.img = c.img AND a.y = c.y AND a.x = c.x + 2")
def gray_expression(spark: SparkSession, d: str) -> DataFrame:
    g = derived.gray(spark, d)
    three = {"a": g, "b": g.withColumn("x", F.col("x") + 1), "c": g.withColumn("x", F.col("x") + 2)}
    return pixels.gray_expression(three, lambda k: F.floor((k["a"] + k["b"] * 2 + k["c"]) / 4))


for op, expr in {
    "invert": "255 - a.gray", "clipped_subtract": "greatest(a.gray - b.gray, 0)", "unclipped_subtract": "(a.gray - b.gray + 256) % 256", "clipped_add": "least(a.gray + b.gray, 255)",
    "unclipped_add": "(a.gray + b.gray) % 256", "darkest": "least(a.gray, b.gray)", "lightest": "greatest(a.gray, b.gray)",
}.items():

    def two_gray(spark: SparkSession, d: str, op=op) -> DataFrame:
        """Every image, with itself a column on (the last column comes first)."""
        g = derived.gray(spark, d)
        return pixels.gray_op(g, g.withColumn("x", (F.col("x") + 1) % WIDTH), op)

    two_gray.__name__ = f"gray_{op}"
    query(f"SELECT a.img, a.y, a.x, ({expr})::INT AS gray FROM gray a JOIN gray b ON a.img = b.img AND a.y = b.y AND a.x = (b.x + 1) % 64")(two_gray)
