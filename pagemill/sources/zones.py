"""Zones of a page: closed splines with a kind, as polygons, and as XML rows read and written by Spark.

A zone has points (x, y, tension) and properties; its polygon is the closed spline through or near them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import curves

POINT = "array<struct<x: double, y: double>>"
XML = "_page LONG, _kind STRING, _level INT, point ARRAY<STRUCT<_x: DOUBLE, _y: DOUBLE>>"
#: What a picture zone does, in the order in which zones are applied, and a zone that is filled with a level.
KINDS = ("eraser1", "painter2", "eraser3", "fill")


def closed_polygon(points, tensions=None, per_segment: int = 8) -> list[tuple[float, float]]:
    """The polygon of a closed spline; without tensions its points themselves."""
    p = np.asarray(points, float)
    if tensions is None or len(p) < 3:
        return [tuple(q) for q in p.tolist()]
    n = len(p)
    # three turns of the points, of which the middle one is kept, so that the ends meet smoothly
    line = curves.xspline(np.vstack([p, p, p]), list(tensions) * 3, per_segment)
    return [tuple(q) for q in line[n * per_segment : 2 * n * per_segment].tolist()]


def with_area(zones: DataFrame, points: str = "points") -> DataFrame:
    """area: of the polygon, by the sum over its sides; valid: three points or more and some area."""

    def term(p: Column, i: Column) -> Column:
        a, b = F.get(p, i), F.get(p, (i + 1) % F.size(p))
        return a["x"] * b["y"] - b["x"] * a["y"]

    p = F.col(points)
    total = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0.0), lambda s, i: s + term(p, i))
    return zones.withColumn("area", F.when(F.size(p) > 2, F.abs(total) / 2).otherwise(0.0)).withColumn("valid", F.col("area") > 0)


def write_zones(zones: DataFrame, path: str) -> None:
    """zones: page, kind, level, points. A folder of XML files, written where the rows are."""
    rows = zones.select(F.col("page").alias("_page"), F.col("kind").alias("_kind"), F.col("level").alias("_level"), F.transform("points", lambda p: F.struct(p["x"].alias("_x"), p["y"].alias("_y"))).alias("point"))
    rows.write.format("xml").option("rootTag", "zones").option("rowTag", "zone").mode("overwrite").save(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """page, kind, level, points; rows without a page or of an unknown kind go."""
    rows = spark.read.format("xml").option("rowTag", "zone").schema(XML).load(path)
    points = F.transform(F.coalesce("point", F.array().cast("array<struct<_x: double, _y: double>>")), lambda p: F.struct(p["_x"].alias("x"), p["_y"].alias("y")))
    d = rows.select(F.col("_page").alias("page"), F.col("_kind").alias("kind"), F.col("_level").alias("level"), points.alias("points"))
    return d.where(F.col("page").isNotNull() & F.col("kind").isin(*KINDS))
