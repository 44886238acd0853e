"""Files, images and logical pages: expansion, normalisation, edits and selections.

Sub-pages are 0 (single), 1 (left) and 2 (right). The order of pages is a column, `ord`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SINGLE, LEFT, RIGHT = 0, 1, 2
MIN_DPI, MAX_DPI, MAX_SIDE_MM = 150, 9999, 500


def expand_files(files: DataFrame) -> DataFrame:
    """A row per image; pages of single-image files are 0, of others 1, 2, ..."""
    i = F.explode(F.sequence(F.lit(0), (F.col("n_images") - 1).cast("int")))
    return files.withColumn("i", i).withColumn("page", F.when(F.col("n_images") > 1, 1).otherwise(0) + F.col("i")).drop("i", "n_images")


def normalise_halves(images: DataFrame) -> DataFrame:
    """Two sub-pages: no half is removed. One: not both are. Other numbers: the image goes."""
    n, both = F.col("sub_pages"), F.col("left_removed") & F.col("right_removed")
    free = (n == 2) | both
    return images.where(n.isin(1, 2)).withColumns({"left_removed": F.col("left_removed") & ~free, "right_removed": F.col("right_removed") & ~free})


def page_view(images: DataFrame, right_to_left: bool = False) -> DataFrame:
    """Logical pages in reading order: two of images with two sub-pages, else the surviving half or the whole."""
    first, second = (RIGHT, LEFT) if right_to_left else (LEFT, RIGHT)
    one = F.when(F.col("left_removed"), RIGHT).when(F.col("right_removed"), LEFT).otherwise(SINGLE)
    subs = F.when(F.col("sub_pages") == 2, F.array(F.lit(first), F.lit(second))).otherwise(F.array(one))
    return normalise_halves(images).select("*", F.posexplode(subs).alias("half", "sub_page")).withColumn("ord", F.col("img_ord") * 2 + F.col("half")).drop("half")


def image_view(images: DataFrame) -> DataFrame:
    return normalise_halves(images).withColumn("sub_page", F.lit(SINGLE))


def auto_page_count(width: Column, height: Column, dpi_x: Column, dpi_y: Column, degrees: Column) -> Column:
    """2 for pages wider than high on paper after the rotation, else 1."""
    w, h = width.cast("long") * dpi_y, height.cast("long") * dpi_x
    return F.when(F.when(degrees % 180 == 0, w > h).otherwise(h > w), 2).otherwise(1)


def set_layout(images: DataFrame, n: Column) -> DataFrame:
    """Sub-pages to n; two are not given to an image with one removed half."""
    half = F.col("left_removed") != F.col("right_removed")
    return images.withColumn("sub_pages", F.when((n == 2) & half, 1).otherwise(n))


def remove_pages(images: DataFrame, removed: DataFrame) -> DataFrame:
    """removed: img_ord, sub_page. A single page takes its image along, a half is flagged."""
    flags = removed.groupBy("img_ord").agg(*[F.max((F.col("sub_page") == s).cast("int")).alias(f"r{s}") for s in (SINGLE, LEFT, RIGHT)])
    d = images.join(flags, "img_ord", "left").fillna(0, ["r0", "r1", "r2"])
    n = F.when(F.col("r0") == 1, 0).otherwise(F.col("sub_pages") - F.col("r1") - F.col("r2"))
    d = d.withColumns({"sub_pages": n, "left_removed": F.col("left_removed") | (F.col("r1") == 1), "right_removed": F.col("right_removed") | (F.col("r2") == 1)})
    return d.where("sub_pages > 0").drop("r0", "r1", "r2")


def restore_pages(images: DataFrame, restored: DataFrame) -> DataFrame:
    """restored: img_ord, sub_page. Only the removed half of an image with one sub-page comes back."""
    r = restored.groupBy("img_ord").agg(F.max((F.col("sub_page") == LEFT).cast("int")).alias("r1"), F.max((F.col("sub_page") == RIGHT).cast("int")).alias("r2"))
    d = images.join(r, "img_ord", "left").fillna(0, ["r1", "r2"])
    back = (F.col("sub_pages") == 1) & ((F.col("left_removed") & (F.col("r1") == 1)) | (F.col("right_removed") & (F.col("r2") == 1)))
    return d.withColumns({"sub_pages": F.when(back, 2).otherwise(F.col("sub_pages")), "left_removed": F.col("left_removed") & ~back, "right_removed": F.col("right_removed") & ~back}).drop("r1", "r2")


def insert_images(images: DataFrame, new: DataFrame) -> DataFrame:
    """new: as images, with `anchor` (img_ord, or null) and `before`. It goes next to its anchor; before null is
    at the end; other missing anchors insert nothing. Returns img_ord renumbered as `ord`."""
    cols = images.columns
    at = images.select(F.col("img_ord").alias("anchor"), F.col("img_ord").cast("double").alias("at"))
    placed = new.join(at, "anchor", "left").withColumn("pos", F.when(F.col("at").isNotNull(), F.col("at") + F.when(F.col("before"), -0.5).otherwise(0.5)).when(F.col("anchor").isNull() & F.col("before"), F.lit(float("inf"))))
    both = images.withColumn("pos", F.col("img_ord").cast("double")).select(*cols, "pos").unionByName(placed.where("pos IS NOT NULL").select(*cols, "pos"))
    return ordered(both, "pos", "img_ord").drop("pos")


def ordered(d: DataFrame, *by: str, name: str = "ord") -> DataFrame:
    """Dense positions from 0 by range-partitioned sort and counts per partition: no single task sees all rows. The sorted rows are kept in a checkpoint
    (of the executors, if no folder is set for any): sorted once more for the counts, the sampled bounds and the merged partitions would be others."""
    s = d.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"part__": F.spark_partition_id(), "at__": F.monotonically_increasing_id()})
    s = s.withColumn("at__", F.col("at__") - F.shiftleft(F.col("part__").cast("long"), 33))
    s = s.checkpoint() if d.sparkSession.sparkContext.getCheckpointDir() else s.localCheckpoint()
    counts = s.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))
    before = counts.select("part__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    return s.join(F.broadcast(before), "part__").withColumn(name, F.col("at__") + F.col("before__")).drop("part__", "at__", "before__")


def dpi_status(size: Column, dpi: Column) -> Column:
    """Status of one axis: pixels and dots per inch."""
    mm = size / dpi * F.lit(25.4)
    return (
        F.when(dpi <= 1, "undefined")
        .when(dpi < MIN_DPI, "too_small")
        .when(dpi > MAX_DPI, "too_large")
        .when(mm > MAX_SIDE_MM, "too_small_for_size")
        .otherwise("ok")
    )


def with_dpi_status(images: DataFrame) -> DataFrame:
    d = images.withColumns({"status_x": F.when(F.col("dpi_x") <= 1, "undefined").otherwise(dpi_status(F.col("width"), F.col("dpi_x"))), "status_y": F.when(F.col("dpi_y") <= 1, "undefined").otherwise(dpi_status(F.col("height"), F.col("dpi_y")))})
    return d.withColumn("dpi_ok", (F.col("status_x") == "ok") & (F.col("status_y") == "ok"))


def followers(pages: DataFrame, anchor: Column) -> DataFrame:
    """The anchor page (of several the first) and all after it; none if there is no such page."""
    at = pages.where(anchor).agg(F.min("ord").alias("from_ord"))  # one row
    return pages.join(F.broadcast(at), F.col("ord") >= F.col("from_ord")).drop("from_ord")


def every_other(pages: DataFrame, anchor: Column) -> DataFrame:
    """Pages an even number of places from the anchor (of several the first); `ord` must be dense among the pages given."""
    at = pages.where(anchor).agg(F.min("ord").alias("from_ord"))  # one row
    return pages.join(F.broadcast(at), (F.col("ord") - F.col("from_ord")) % 2 == 0).drop("from_ord")
