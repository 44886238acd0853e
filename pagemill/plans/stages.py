"""The six stages over a table of gray pages: orientation, split, deskew, content, layout, output.

Pixel work of an image is one row's work in Arrow batches; stages 1 to 4 run in one pass over the pixels,
then the layout takes the largest page size (one row, broadcast), then the output is rendered. Stored
parameters enter by key: pages whose parameters are manual, or automatic and made from the same
dependencies, keep them.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import content, dewarp, layout, pagework, rasters, split

#: x0 to y1: the box of the page; left_edge and right_edge: x of its edges at the top and the bottom; error: why an image has no pages.
ESTIMATES = (
    "img long, sub_page int, layout string, x0 int, y0 int, x1 int, y1 int, left_edge array<double>, right_edge array<double>, angle double, confidence double, "
    "left int, top int, right int, bottom int, error string"
)
#: speckles and mask: planes of 0 and 1, of the specks taken away and of pictures.
OUTPUT = "img long, sub_page int, height int, width int, data binary, specks long, speckles binary, mask binary"


def estimate(images: DataFrame, rotation: int = 0, layout_type: str = "auto", manual_angle: float | None = None, dpi: float = 100, box: tuple[int, int, int, int] | None = None, level: str = "normal", last: int = 6) -> DataFrame:
    """ESTIMATES, a row for each logical page: outline, skew and content box (nulls: no content) in the page's pixels.

    images: img, height, width, data (see operators.kernels), and error if some couldn't be decoded. An image that can't be taken gives one row
    with an error and no page.
    manual_angle, box: instead of what is found. last: the last stage that is computed; what later ones find is unknown (angle 0, no box).
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ", 1) for f in ESTIMATES.split(", ")]

    def pages(img, h, w, data, error=None):
        if error:
            raise ValueError(error)
        if data is None or h is None or w is None or len(data) != h * w or not data:
            raise ValueError(f"{0 if data is None else len(data)} bytes for {w} x {h} pixels")
        g = rasters.rotate_quarter(np.frombuffer(data, np.uint8).reshape(h, w), rotation)
        cut = split.split_page(g, layout_type, dpi) if last >= 2 else split.Layout("single_uncut")
        for sub, (a, z) in split.page_outlines(g.shape[1], g.shape[0], cut).items():
            page, x0, x1 = split.cut_page(g, a, z)
            if not page.size:
                continue
            angle, confidence = (0.0, 0.0) if last < 3 else pagework.skew(page, dpi) if manual_angle is None else (manual_angle, 0.0)
            found = (None,) * 4
            if last >= 4:
                found = box or content.content_box(pagework.rotated(page, -angle), dpi, level) or found
            yield img, sub, cut.kind, x0, 0, x1, g.shape[0], list(a), list(z), angle, confidence, *found, None

    def run(batches):
        for b in batches:
            rows = []
            for image in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows += list(pages(*image))
                except Exception as e:  # noqa: BLE001  one bad image must not end the job; its row says why
                    rows.append((image[0], *(None,) * (len(fields) - 2), f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return images.select("img", "height", "width", "data", *[c for c in images.columns if c == "error"]).mapInArrow(run, ESTIMATES)


def reuse(fresh: DataFrame, stored: DataFrame, deps: tuple[str, ...] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Estimates with the stored ones of the same pages: stored has img, sub_page, mode, stored_<dep>, angle and box as stored_*.
    Manual boxes move with the middle of the outline when it changed."""
    s = layout.stale(fresh.withColumn("key", F.struct("img", "sub_page")), stored.withColumn("key", F.struct("img", "sub_page")).drop("img", "sub_page"), "key", list(deps))
    moved = {}
    for low, high, sides in (("x0", "x1", ("left", "right")), ("y0", "y1", ("top", "bottom"))):
        shift = F.floor((F.col(low) + F.col(high) - F.col(f"stored_{low}") - F.col(f"stored_{high}")) / 2).cast("int")
        for side in sides:
            kept = F.col(f"stored_{side}")
            moved[side] = F.when(F.col("mode") == "manual", kept + F.coalesce(shift, F.lit(0))).when(F.col("stale"), F.col(side)).otherwise(kept)
    return s.withColumns({**moved, "angle": layout.merge_params(s, "angle", "stored_angle")}).select(*fresh.columns, "stale")


def laid_out(estimates: DataFrame, dpi: int, settings: DataFrame | None = None, margins: dict[str, float] | None = None, align: tuple[str | None, str | None] = ("center", "center")) -> DataFrame:
    """Estimates with content size in mm, margins, and the page size: the largest over all pages, by alignment. margins, align: of pages
    without settings. Images without pages are left out."""
    mm = 25.4 / dpi
    d = estimates.where("error IS NULL").drop("error").withColumns({"content_w": F.coalesce((F.col("right") - F.col("left")) * mm, F.lit(-1.0)), "content_h": F.coalesce((F.col("bottom") - F.col("top")) * mm, F.lit(-1.0)), "ord": F.col("img") * 4 + F.col("sub_page")})
    defaults = {c: F.lit(v) for c, v in (layout.DEFAULT_MARGINS | (margins or {})).items()} | {c: F.lit(v).cast("string") for c, v in zip(("align_h", "align_v"), align, strict=True)}
    if settings is None:
        return layout.page_sizes(d.withColumns(defaults))
    d = d.join(settings.withColumn("known__", F.lit(True)), ["img", "sub_page"], "left")
    return layout.page_sizes(d.withColumns({c: F.when(F.col("known__"), F.col(c)).otherwise(v) for c, v in defaults.items()}).drop("known__"))


def on_sheet(page: np.ndarray, p: dict, dpi: float, out_dpi: float, white_margins: bool, normalize: bool, dewarping: str, depth: float) -> np.ndarray:
    """A turned page on its sheet of the common size at out_dpi: its content, or all of it that reaches the sheet. Levels are made even before white comes
    around them."""
    px = lambda mm: int(round(mm * out_dpi / 25.4))
    sheet = np.full((max(1, px(p["page_h"])), max(1, px(p["page_w"]))), 255, np.uint8)
    if p.get("left") is None:
        return sheet
    k = out_dpi / dpi
    page = split.at_dpi(page, dpi, out_dpi)
    left, top, right, bottom = (int(round(p[c] * k)) for c in ("left", "top", "right", "bottom"))
    y, x = px(p["margin_top"] + p["soft_top"]), px(p["margin_left"] + p["soft_left"])
    part = page[top:bottom, left:right]
    if dewarping == "auto":
        part = dewarp.flattened(part, depth)
    elif not white_margins:  # as it is: what lies around the content comes along
        up, back = min(y, top), min(x, left)
        part, y, x = page[top - up : top + sheet.shape[0] - y, left - back : left + sheet.shape[1] - x], y - up, x - back
    part = part[: sheet.shape[0] - y, : sheet.shape[1] - x]
    if normalize and part.size:
        part = pagework.normalised(part)
    sheet[y : y + part.shape[0], x : x + part.shape[1]] = part
    return sheet


def render(
    images: DataFrame, pages: DataFrame, dpi: int, rotation: int = 0, out_dpi: int | None = None, white_margins: bool = True, normalize: bool = True, dewarping: str = "off", depth: float = 2.0, **options
) -> DataFrame:
    """OUTPUT: each page cut out, turned, put on its sheet and rendered. pages: of laid_out(). dewarping: off or auto, with the depth of curls.
    options: of pagework.rendered()."""
    cols = ["sub_page", "left_edge", "right_edge", "angle", "left", "top", "right", "bottom", "page_w", "page_h", "margin_left", "margin_top", "soft_left", "soft_top"]
    todo = pages.groupBy("img").agg(F.to_json(F.collect_list(F.struct(*cols))).alias("pages"))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        for b in batches:
            for img, h, w, data, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                g = rasters.rotate_quarter(np.frombuffer(data, np.uint8).reshape(h, w), rotation)
                for p in json.loads(text):
                    page = pagework.rotated(split.cut_page(g, p["left_edge"], p["right_edge"])[0], -p["angle"])
                    sheet = on_sheet(page, p, dpi, out_dpi or dpi, white_margins, normalize, dewarping, depth)
                    out, specks, mask = pagework.rendered_parts(sheet, normalize=False, **options)
                    row = (img, p["sub_page"], *out.shape, out.tobytes(), int(specks.sum()), specks.astype(np.uint8).tobytes(), mask.astype(np.uint8).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in OUTPUT.split(", ")])

    return images.select("img", "height", "width", "data").join(todo, "img").mapInArrow(run, OUTPUT)


def run(images: DataFrame, dpi: int = 100, rotation: int = 0, layout_type: str = "auto", manual_angle: float | None = None, **options) -> DataFrame:
    """All stages."""
    return render(images, laid_out(estimate(images, rotation, layout_type, manual_angle, dpi), dpi), dpi, rotation, **options)
