"""Settings, sizes and margins of page layouts; keyed lookups, aggregates and orders over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MARGINS = {"margin_left": 10.0, "margin_top": 5.0, "margin_right": 10.0, "margin_bottom": 5.0}


def with_defaults(pages: DataFrame, settings: DataFrame, key: str = "img_ord") -> DataFrame:
    """Each page's settings; pages without any get the default margins, centred, and no content size."""
    d = pages.join(settings.withColumn("known__", F.lit(True)), key, "left")
    known = F.coalesce(F.col("known__"), F.lit(False))
    cols = {c: F.when(known, F.col(c)).otherwise(F.lit(v)) for c, v in (DEFAULT_MARGINS | {"content_w": -1.0, "content_h": -1.0, "align_h": "center", "align_v": "center"}).items()}
    return d.withColumns(cols).drop("known__")


def has_content() -> Column:
    return (F.col("content_w") >= 0) & (F.col("content_h") >= 0)


def aligned() -> Column:
    return F.col("align_h").isNotNull() & F.col("align_v").isNotNull()


def hard_sizes(d: DataFrame) -> DataFrame:
    """hard_w, hard_h: content and margins in mm; 0 for unknown content."""
    return d.withColumns({
        "hard_w": F.when(has_content(), F.col("content_w") + F.col("margin_left") + F.col("margin_right")).otherwise(0.0),
        "hard_h": F.when(has_content(), F.col("content_h") + F.col("margin_top") + F.col("margin_bottom")).otherwise(0.0),
    })


def aggregate_size(d: DataFrame) -> DataFrame:
    """One row: the largest width and height among aligned pages, independently; 0 if there is none."""
    most = lambda c: F.coalesce(F.max(F.when(aligned(), F.col(c))), F.lit(0.0))
    return d.agg(most("hard_w").alias("agg_w"), most("hard_h").alias("agg_h"))


def leave_one_out(d: DataFrame) -> DataFrame:
    """loo_w, loo_h: the aggregate of the other pages, so what it becomes if the page changes is the larger of this and the
    page's new size. One aggregate of one row, by partial sums: for each axis the largest size, a page that has it, how many have it, and
    the largest size below; the page that has it alone gets the next one."""
    sizes = ("hard_w", "hard_h")
    top = d.where(aligned()).agg(*[F.max(c).alias(f"top_{c}") for c in sizes])
    both = d.where(aligned()).join(F.broadcast(top), how="cross")  # one row
    rest = [
        x for c in sizes for x in (
            F.max(f"top_{c}").alias(f"top_{c}"), F.sum(F.when(F.col(c) == F.col(f"top_{c}"), 1)).alias(f"n_{c}"), F.max(F.when(F.col(c) == F.col(f"top_{c}"), F.col("ord"))).alias(f"at_{c}"),
            F.max(F.when(F.col(c) < F.col(f"top_{c}"), F.col(c))).alias(f"next_{c}"),
        )
    ]
    one = both.agg(*rest)

    def pick(c: str) -> Column:
        alone = aligned() & (F.col("ord") == F.col(f"at_{c}")) & (F.col(f"n_{c}") == 1)
        return F.coalesce(F.when(alone, F.col(f"next_{c}")).otherwise(F.col(f"top_{c}")), F.lit(0.0))

    d = d.join(F.broadcast(one), how="cross")  # one row
    return d.withColumns({"loo_w": pick("hard_w"), "loo_h": pick("hard_h")}).drop(*[f"{p}_{c}" for p in ("top", "at", "n", "next") for c in sizes])


def soft_margins(d: DataFrame) -> DataFrame:
    """soft_left ... soft_bottom: what is missing to the aggregate, dealt by alignment; nothing for pages that are not aligned."""
    dw, dh = F.col("agg_w") - F.col("hard_w"), F.col("agg_h") - F.col("hard_h")

    def share(gap: Column, align: str, low: str, high: str) -> tuple[Column, Column]:
        a = F.col(align)
        first = F.when(aligned() & (gap > 0), F.when(a == low, 0.0).when(a == high, gap).otherwise(gap * 0.5)).otherwise(0.0)
        return first, F.when(aligned() & (gap > 0), gap - first).otherwise(0.0)

    left, right = share(dw, "align_h", "left", "right")
    top, bottom = share(dh, "align_v", "top", "bottom")
    return d.withColumns({"soft_left": left, "soft_right": right, "soft_top": top, "soft_bottom": bottom})


def page_sizes(d: DataFrame) -> DataFrame:
    """page_w, page_h in mm: content, hard and soft margins. The aggregate is one row, broadcast."""
    h = hard_sizes(d)
    s = soft_margins(h.join(F.broadcast(aggregate_size(h)), how="cross"))
    return s.withColumns({"page_w": F.col("hard_w") + F.col("soft_left") + F.col("soft_right"), "page_h": F.col("hard_h") + F.col("soft_top") + F.col("soft_bottom")})


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: does the aggregate size differ?"""
    a, b = aggregate_size(hard_sizes(before)), aggregate_size(hard_sizes(after))
    return a.select(F.col("agg_w").alias("w0"), F.col("agg_h").alias("h0")).join(F.broadcast(b), how="cross").select(((F.col("w0") != F.col("agg_w")) | (F.col("h0") != F.col("agg_h"))).alias("changed"))


def drop_orphans(settings: DataFrame, pages: DataFrame, key: str = "img_ord") -> DataFrame:
    return settings.join(pages.select(key).distinct(), key, "left_semi")


def undefined_pages(pages: DataFrame, settings: DataFrame, key: str = "img_ord") -> DataFrame:
    """Pages without settings or with unknown content."""
    return pages.join(settings.where(has_content()), key, "left_anti")


def by_size(d: DataFrame, of: str, margins: bool) -> DataFrame:
    """rank: ascending by width or height ('w', 'h') of the content, or with margins; unknown content last; ties by ord."""
    c = F.col(f"hard_{of}") if margins else F.col(f"content_{of}")
    return d.withColumns({"incomplete__": ~has_content(), "size__": F.when(has_content(), c)})


def fold_metadata(images: DataFrame, only_bad: bool = False) -> DataFrame:
    """By size: the one pair of dots per inch that all images share, else 0, 0. Invalid pairs are equal to each other."""
    d = images.where(~F.col("dpi_ok")) if only_bad else images
    null = (F.col("dpi_x") <= 1) | (F.col("dpi_y") <= 1)
    pair = F.struct(F.when(null, 0).otherwise(F.col("dpi_x")).alias("x"), F.when(null, 0).otherwise(F.col("dpi_y")).alias("y"))
    g = d.groupBy("width", "height").agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"), F.count(F.lit(1)).alias("n"), F.min("img_ord").alias("first_ord"))
    same = F.col("lo") == F.col("hi")
    return g.select("width", "height", "n", "first_ord", F.when(same, F.col("lo.x")).otherwise(0).alias("dpi_x"), F.when(same, F.col("lo.y")).otherwise(0).alias("dpi_y"))


def stale(pages: DataFrame, params: DataFrame, key: str, deps: list[str]) -> DataFrame:
    """Pages whose stored parameters are missing or were made from other dependencies: the work to do.
    Dependencies of params are named stored_<dep>; manual parameters with the same key are kept if they match."""
    d = pages.join(params, key, "left")
    match = F.col("mode").isNotNull()
    for x in deps:
        match = match & F.col(x).eqNullSafe(F.col(f"stored_{x}"))
    return d.withColumn("stale", ~match)


def merge_params(d: DataFrame, fresh: str, stored: str) -> Column:
    """AUTO parameters that are stale are computed again; MANUAL ones stay."""
    return F.when((F.col("mode") == "manual") & F.col(stored).isNotNull(), F.col(stored)).when(F.col("stale"), F.col(fresh)).otherwise(F.col(stored))


def numbered(d: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
    return d.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(by)) - 1)
