"""Pixel analytics in relational form, over (img, y, x, gray) and black pixels (img, y, x).

Every operator aggregates or windows within one image; windows are partitioned by a row or column
of an image, never by the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 256


def histogram(gray: DataFrame) -> DataFrame:
    """img, gray, n for all 256 levels."""
    grid = gray.select("img").distinct().withColumn("gray", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    n = gray.groupBy("img", "gray").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["img", "gray"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def otsu(gray: DataFrame) -> DataFrame:
    """img, threshold: of the largest variance between levels up to i and above, the middle of the first and last i, each plus one."""
    w = Window.partitionBy("img").orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("img")
    h = histogram(gray).withColumns({"below": F.sum("n").over(w), "mb": F.sum(F.col("n") * F.col("gray")).over(w), "total": F.sum("n").over(every), "mt": F.sum(F.col("n") * F.col("gray")).over(every)})
    above = F.col("total") - F.col("below")
    d = (F.col("mt") - F.col("mb")) / above - F.col("mb") / F.col("below")
    h = h.withColumn("v", F.when((F.col("below") > 0) & (above > 0), d * d * F.col("below") * above))
    h = h.withColumn("most", F.max("v").over(every))
    best = F.col("v") == F.col("most")
    first, last = F.min(F.when(best & (F.col("most") > 0), F.col("gray"))), F.max(F.when(best & (F.col("most") > 0), F.col("gray")))
    return h.groupBy("img").agg(F.coalesce(F.shiftright(first + last + 2, 1), F.lit(0)).alias("threshold"))


def with_extents(gray: DataFrame) -> DataFrame:
    size = gray.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return gray.join(size, "img")


def sliding(gray: DataFrame, aggregate, rx: tuple[int, int], ry: tuple[int, int], name: str) -> DataFrame:
    """aggregate over a window of columns x + rx and rows y + ry, clipped at the borders: by rows, then by columns."""
    by_row = Window.partitionBy("img", "y").orderBy("x").rangeBetween(*rx)
    by_col = Window.partitionBy("img", "x").orderBy("y").rangeBetween(*ry)
    return gray.withColumn("r__", aggregate(F.col("gray")).over(by_row)).withColumn(name, aggregate(F.col("r__")).over(by_col)).drop("r__")


def dilate_gray(gray: DataFrame, w: int, h: int) -> DataFrame:
    """Dark spreads: the least level in a brick of odd sides; outside is white."""
    return sliding(gray, F.min, (-(w // 2), w // 2), (-(h // 2), h // 2), "out")


def erode_gray(gray: DataFrame, w: int, h: int) -> DataFrame:
    """Light spreads: the greatest level; outside is black."""
    return sliding(gray, F.max, (-(w // 2), w // 2), (-(h // 2), h // 2), "out")


def mokji(gray: DataFrame, edge: int = 3, magnitude: int = 20) -> DataFrame:
    """img, threshold from the co-occurrences of a pixel and the darkest one around it; 128 without edges."""
    d = with_extents(sliding(gray, F.min, (-edge, edge), (-edge, edge), "m"))
    inner = (F.col("x") >= edge) & (F.col("y") >= edge) & (F.col("x") < F.col("w") - edge) & (F.col("y") < F.col("h") - edge)
    pairs = d.where(inner).groupBy("img", "m", "gray").agg(F.count(F.lit(1)).alias("c"))
    use = F.col("gray") >= F.col("m") + magnitude
    sums = pairs.groupBy("img").agg(F.sum(F.when(use, (F.col("m") + F.col("gray")) * F.col("c"))).alias("s"), F.sum(F.when(use, F.col("c"))).alias("n"))
    all_ = gray.select("img").distinct().join(sums, "img", "left")
    return all_.select("img", F.when(F.col("n") > 0, F.floor((F.col("s") + F.col("n")) / (2 * F.col("n"))).cast("int")).otherwise(128).alias("threshold"))


def local_stats(gray: DataFrame, w: int, h: int) -> DataFrame:
    """mean and sigma of the window; the lower half is h >> 1 and the upper end is exclusive."""
    rx, ry = (-(w // 2), w - w // 2 - 1), (-(h // 2), h - h // 2 - 1)
    by_row, by_col = Window.partitionBy("img", "y").orderBy("x").rangeBetween(*rx), Window.partitionBy("img", "x").orderBy("y").rangeBetween(*ry)
    g = F.col("gray")
    d = gray.withColumns({"a": F.sum(g).over(by_row), "b": F.sum(g * g).over(by_row), "c": F.count(F.lit(1)).over(by_row)})
    d = d.withColumns({"a": F.sum("a").over(by_col), "b": F.sum("b").over(by_col), "c": F.sum("c").over(by_col)})
    d = d.withColumn("mean", F.col("a") / F.col("c"))
    return d.withColumn("sigma", F.sqrt(F.abs(F.col("b") / F.col("c") - F.col("mean") * F.col("mean")))).drop("a", "b", "c")


def sauvola(gray: DataFrame, w: int, h: int) -> DataFrame:
    """Pixels with `black`: darker than mean (1 + 0.34 (sigma / 128 - 1))."""
    d = local_stats(gray, w, h)
    return d.select("img", "y", "x", (F.col("gray") < F.col("mean") * (1 + F.lit(0.34) * (F.col("sigma") / 128 - 1))).alias("black"))


def wolf(gray: DataFrame, w: int, h: int, lower: int = 1, upper: int = 254) -> DataFrame:
    """Pixels with `black`: darker than mean - 0.3 (1 - sigma / largest sigma) (mean - darkest), within bounds."""
    d = local_stats(gray, w, h).withColumns({"mean": F.col("mean").cast("float"), "sigma": F.col("sigma").cast("float")})
    one = d.groupBy("img").agg(F.max("sigma").cast("double").alias("top"), F.min("gray").alias("dark"))
    d = d.join(one, "img")
    mean = F.col("mean").cast("double")
    t = mean - F.lit(0.3) * (1 - F.col("sigma").cast("double") / F.nullif(F.col("top"), F.lit(0.0))) * (mean - F.col("dark"))
    g = F.col("gray")
    return d.select("img", "y", "x", F.when(g < lower, True).when(g > upper, False).otherwise(F.coalesce(g < t, F.lit(False))).alias("black"))


def projection(black: DataFrame, axis: str, sizes: DataFrame) -> DataFrame:
    """img, at, n: black pixels per row ('y') or column ('x'), zeros too. sizes: img and the size along the axis, `size`."""
    grid = sizes.withColumn("at", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("int")))).drop("size")
    n = black.groupBy("img", F.col(axis).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["img", "at"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def content_spans(hist: DataFrame, min_content: int, min_gap: int) -> DataFrame:
    """img, from_, to_ (exclusive): runs of counts above 0, joined over gaps shorter than min_gap, narrow ones dropped after that."""
    w = Window.partitionBy("img").orderBy("at")
    d = hist.where("n > 0").withColumn("gap", F.col("at") - F.lag("at").over(w) - 1)
    d = d.withColumn("span", F.sum(F.when(F.col("gap") >= min_gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = d.groupBy("img", "span").agg(F.min("at").alias("from_"), (F.max("at") + 1).alias("to_"))
    return s.where(F.col("to_") - F.col("from_") >= min_content).drop("span")


def bounding_boxes(black: DataFrame) -> DataFrame:
    return black.groupBy("img").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"), F.count(F.lit(1)).alias("n_black"))


def reduce_2x(black: DataFrame, threshold: int) -> DataFrame:
    """2 x 2 blocks with `threshold` black pixels or more; for images with even sides."""
    g = black.groupBy("img", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= threshold).drop("n")


def shear_rows(black: DataFrame, shear: Column, origin: Column) -> DataFrame:
    """Rows moved sideways by the rounded shear times their distance from the origin."""
    return black.withColumn("x", F.col("x") + F.floor(shear * (F.col("y") + 0.5 - origin) + 0.5).cast("int"))


def rotate_quarter(black: DataFrame, degrees: int, w: int, h: int) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    to = {0: (x, y), 90: (h - 1 - y, x), 180: (w - 1 - x, h - 1 - y), 270: (y, w - 1 - x)}[degrees % 360]
    return black.select("img", to[1].alias("y"), to[0].alias("x"))


def upscale(black: DataFrame, sx: int, sy: int) -> DataFrame:
    d = black.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(sy - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(sx - 1))))
    return d.select("img", (F.col("y") * sy + F.col("j")).alias("y"), (F.col("x") * sx + F.col("i")).alias("x"))


def skew_scores(black: DataFrame, degrees: list[float], width: int, height: int) -> DataFrame:
    """img, degrees, score: columns sheared by the angle, then the sum of squared differences of neighbouring row counts."""
    angles = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("degrees"), F.lit(math.tan(math.radians(a))).alias("t")) for a in degrees])).alias("a")
    d = black.select("img", "x", "y", angles).withColumn("y", F.col("y") + F.floor(F.col("a.t") * (F.col("x") + 0.5 - width / 2) + 0.5).cast("int"))
    n = d.where(F.col("y").between(0, height - 1)).groupBy("img", F.col("a.degrees").alias("degrees"), "y").agg(F.count(F.lit(1)).alias("n"))
    # rows without pixels count 0: a row differs from the one before, and the last of a run from the empty row after it
    w = Window.partitionBy("img", "degrees").orderBy("y")
    prev, nxt = F.lag(F.struct("y", "n")).over(w), F.lead("y").over(w)
    n = n.withColumns({"p": prev, "q": nxt})
    up = F.when(F.col("y") == 0, 0).when(F.col("p.y") == F.col("y") - 1, F.pow(F.col("n") - F.col("p.n"), F.lit(2))).otherwise(F.col("n") * F.col("n"))
    down = F.when((F.col("y") < height - 1) & (F.col("q").isNull() | (F.col("q") > F.col("y") + 1)), F.col("n") * F.col("n")).otherwise(0)
    return n.groupBy("img", "degrees").agg(F.sum((up + down).cast("long")).alias("score"))


def hough(black: DataFrame, degrees: list[float], resolution: float, bias: float) -> DataFrame:
    """img, degrees, bin, weight: votes of pixels for lines at an angle and distance."""
    rows = [F.struct(F.lit(float(a)).alias("degrees"), F.lit(math.cos(math.radians(a))).alias("u"), F.lit(math.sin(math.radians(a))).alias("v")) for a in degrees]
    d = black.select("img", "x", "y", F.explode(F.array(*rows)).alias("a"))
    at = F.floor((F.col("x") * F.col("a.u") + F.col("y") * F.col("a.v") + bias) / resolution + 0.5).cast("int")
    return d.groupBy("img", F.col("a.degrees").alias("degrees"), at.alias("bin")).agg(F.count(F.lit(1)).alias("weight"))


def dominant_level(gray: DataFrame, window: int = 10) -> DataFrame:
    """img, level: of the densest `window` consecutive levels (ties: the lowest), the weighted median."""
    h = histogram(gray)
    dense = h.withColumn("s", F.sum("n").over(Window.partitionBy("img").orderBy("gray").rowsBetween(0, window - 1))).where(F.col("gray") <= LEVELS - window)
    best = dense.groupBy("img").agg(F.min(F.struct((-F.col("s")).alias("s"), "gray")).alias("m")).select("img", F.col("m.gray").alias("start"), (-F.col("m.s")).alias("total"))
    d = h.join(best, "img").where((F.col("gray") >= F.col("start")) & (F.col("gray") < F.col("start") + window))
    d = d.withColumn("upto", F.sum("n").over(Window.partitionBy("img").orderBy("gray")))
    return d.where(F.col("upto") * 2 >= F.col("total")).groupBy("img").agg(F.min("gray").alias("level"))


def raster_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """and, or, xor, subtract of black pixels as sets."""
    if op == "and":
        return a.intersect(b)
    if op == "or":
        return a.unionByName(b).distinct()
    if op == "subtract":
        return a.subtract(b)
    if op == "xor":
        both = a.withColumn("k", F.lit(1)).unionByName(b.withColumn("k", F.lit(2)))
        return both.groupBy("img", "y", "x").agg(F.sum("k").alias("k")).where("k < 3").drop("k")
    raise ValueError(op)


def raster_expression(cells: DataFrame, rasters: dict[str, DataFrame], black) -> DataFrame:
    """Pixels of `cells` that are black by an expression of any number of rasters, nested at will: black(columns) is given, by name, whether
    each raster has the pixel. One aggregate over all, whatever the expression."""
    flagged = cells.select("img", "y", "x").withColumn("k", F.lit(0))
    for i, r in enumerate(rasters.values()):
        flagged = flagged.unionByName(r.select("img", "y", "x").withColumn("k", F.lit((1 << i) | (1 << len(rasters)))))
    inside = flagged.groupBy("img", "y", "x").agg(F.bit_or("k").alias("k"), F.min("k").alias("least"))
    has = {name: F.col("k").bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(rasters)}
    return inside.where((F.col("least") == 0) & black(has)).select("img", "y", "x")


def gray_expression(rasters: dict[str, DataFrame], level) -> DataFrame:
    """Levels by an expression of any number of rasters: level(columns) is given each raster's level by name. Pixels that all have."""
    one = None
    for name, r in rasters.items():
        named = r.select("img", "y", "x", F.col("gray").alias(name))
        one = named if one is None else one.join(named, ["img", "y", "x"])
    return one.select("img", "y", "x", level({name: F.col(name) for name in rasters}).cast("int").alias("gray"))


def gray_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Levels of two rasters of equal size, by pixel."""
    x, y = F.col("gray"), F.col("other")
    out = {
        "invert": 255 - x, "clipped_subtract": F.greatest(x - y, F.lit(0)), "unclipped_subtract": F.pmod(x - y, F.lit(256)), "clipped_add": F.least(x + y, F.lit(255)),
        "unclipped_add": F.pmod(x + y, F.lit(256)), "darkest": F.least(x, y), "lightest": F.greatest(x, y),
    }[op]
    return a.join(b.withColumnRenamed("gray", "other"), ["img", "y", "x"]).select("img", "y", "x", out.cast("int").alias("gray"))
