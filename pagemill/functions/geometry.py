"""Units, affine transforms and polygons as column expressions. Affines are structs of six doubles:
x' = a x + c y + e, y' = b x + d y + f."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INCH_MM = 25.4


def mm_to_px(mm: Column, dpi: Column) -> Column:
    return mm * dpi / F.lit(INCH_MM)


def px_to_mm(px: Column, dpi: Column) -> Column:
    return px * F.lit(INCH_MM) / dpi


def dpm(dpi: Column) -> Column:
    """Dots per metre, rounded."""
    return F.floor(dpi / F.lit(0.0254) + 0.5).cast("int")


def affine(a, b, c, d, e, f) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for x, n in zip((a, b, c, d, e, f), "abcdef", strict=True)])


def bound(value: Column, body) -> Column:
    """body(value), with value evaluated once; structs that are read field by field would be copied into every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def then(m: Column, n: Column) -> Column:
    """m, then n."""
    return bound(F.struct(m.alias("m"), n.alias("n")), lambda p: _product(p["m"], p["n"]))


def _product(m: Column, n: Column) -> Column:
    g = lambda p, x: p[x]
    return affine(
        g(n, "a") * g(m, "a") + g(n, "c") * g(m, "b"), g(n, "b") * g(m, "a") + g(n, "d") * g(m, "b"),
        g(n, "a") * g(m, "c") + g(n, "c") * g(m, "d"), g(n, "b") * g(m, "c") + g(n, "d") * g(m, "d"),
        g(n, "a") * g(m, "e") + g(n, "c") * g(m, "f") + g(n, "e"), g(n, "b") * g(m, "e") + g(n, "d") * g(m, "f") + g(n, "f"),
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def scaling(sx: Column, sy: Column) -> Column:
    return affine(sx, 0, 0, sy, 0, 0)


def quarter_turn(degrees: Column, w: Column, h: Column) -> Column:
    """Rotation by 0, 90, 180 or 270 degrees clockwise, moved back into the first quadrant."""
    return (
        F.when(degrees == 90, affine(0, 1, -1, 0, h, 0))
        .when(degrees == 180, affine(-1, 0, 0, -1, w, h))
        .when(degrees == 270, affine(0, -1, 1, 0, 0, w))
        .otherwise(affine(1, 0, 0, 1, 0, 0))
    )


def rotated_size(degrees: Column, w: Column, h: Column) -> Column:
    turn = degrees % 180 != 0
    return F.struct(F.when(turn, h).otherwise(w).alias("w"), F.when(turn, w).otherwise(h).alias("h"))


def translation(dx: Column, dy: Column) -> Column:
    return affine(1, 0, 0, 1, dx, dy)


def rotation(degrees: Column, cx: Column, cy: Column) -> Column:
    """Clockwise about a point."""
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    return affine(c, s, -s, c, cx - c * cx + s * cy, cy - s * cx - c * cy)


def bounds(m: Column, rect: Column) -> Column:
    """The box (left, top, right, bottom) of a rectangle through m."""
    p = F.array(*[apply(m, rect[x], rect[y]) for x, y in (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"))])
    return bound(p, lambda q: F.struct(F.array_min(q["x"]).alias("left"), F.array_min(q["y"]).alias("top"), F.array_max(q["x"]).alias("right"), F.array_max(q["y"]).alias("bottom")))


def chain(w: Column, h: Column, dpi_x: Column, dpi_y: Column, pre_dpi: Column, degrees: Column, pre_crop: Column, skew: Column, post_crop: Column, post_dpi: Column) -> Column:
    """The whole transform of a page: scale to pre_dpi, turn by quarters, crop to pre_crop (a rectangle after that), rotate about the middle of the cropped
    area, crop to post_crop (a rectangle after that), scale from pre_dpi to post_dpi. A crop moves its upper left corner to the origin."""
    first = then(scaling(pre_dpi / dpi_x, pre_dpi / dpi_y), quarter_turn(degrees, w * pre_dpi / dpi_x, h * pre_dpi / dpi_y))
    middle = lambda r: ((r["right"] - r["left"]) / 2, (r["bottom"] - r["top"]) / 2)
    turned = then(then(first, translation(-pre_crop["left"], -pre_crop["top"])), rotation(skew, *middle(pre_crop)))
    cropped = then(turned, translation(-post_crop["left"], -post_crop["top"]))
    return then(cropped, scaling(post_dpi / pre_dpi, post_dpi / pre_dpi))


def page_transform(w: Column, h: Column, dpi_x: Column, dpi_y: Column, degrees: Column, skew: Column) -> Column:
    """The chain up to the rotation of the skew: scale to the smaller of both resolutions, turn by quarters (with the
    size before scaling), then rotate about the centre of the page."""
    low = F.least(dpi_x, dpi_y).cast("double")
    size = rotated_size(degrees, w, h)
    cx, cy = size["w"] / 2, size["h"] / 2
    return then(then(scaling(low / dpi_x, low / dpi_y), quarter_turn(degrees, w, h)), rotation(skew, cx, cy))


def rect_size_mm(m: Column, left: Column, top: Column, right: Column, bottom: Column, dpi: Column) -> Column:
    """Lengths in mm of the mapped top and left edges of a rectangle."""
    corners = bound(m, lambda t: F.struct(apply(t, left, top).alias("p"), apply(t, right, top).alias("q"), apply(t, left, bottom).alias("r")))
    dist = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    return bound(corners, lambda c: F.struct(px_to_mm(dist(c["p"], c["q"]), dpi).alias("w"), px_to_mm(dist(c["p"], c["r"]), dpi).alias("h")))


def content_or_point(left: Column, top: Column, right: Column, bottom: Column, page: Column) -> Column:
    """A content box; an empty one becomes a hundredth of a pixel each way around the middle of the page."""
    full = (right > left) & (bottom > top)
    x, y = (page["left"] + page["right"]) / 2, (page["top"] + page["bottom"]) / 2
    pick = lambda own, at: F.when(full, own).otherwise(at)
    return F.struct(pick(left, x - 0.01).alias("left"), pick(top, y - 0.01).alias("top"), pick(right, x + 0.01).alias("right"), pick(bottom, y + 0.01).alias("bottom"))


def quad(m: Column, rect: Column) -> Column:
    """The corners of a rectangle through m: upper left, upper right, lower right, lower left."""
    return F.array(*[apply(m, rect[x], rect[y]) for x, y in (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"))])


def extend_quad(q: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A quad with margins along its own directions: right is that of the upper side, down that of the left side."""

    def of(p):
        a, b, d = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(3))
        unit = lambda u, v: F.struct(((v["x"] - u["x"]) / F.hypot(v["x"] - u["x"], v["y"] - u["y"])).alias("x"), ((v["y"] - u["y"]) / F.hypot(v["x"] - u["x"], v["y"] - u["y"])).alias("y"))
        r, down = unit(a, b), unit(a, d)

        def moved(k, along, below):
            c = F.get(p, F.lit(k))
            return F.struct((c["x"] + r["x"] * along + down["x"] * below).alias("x"), (c["y"] + r["y"] * along + down["y"] * below).alias("y"))

        return F.array(moved(0, -left, -top), moved(1, right, -top), moved(2, right, bottom), moved(3, -left, bottom))

    return bound(q, of)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / length)))
    ex, ey = px - x1 - t * dx, py - y1 - t * dy
    return ex * ex + ey * ey


def line_intersection(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """Parameter on the first line where it meets the second, null for parallel lines."""
    den = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    return F.when(F.abs(den) > 1e-12, ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / den)


def to_gray(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 11 + g * 16 + b * 5, 5)


def same_polygon(p: Column, q: Column, tolerance: float = 2.0**-12) -> Column:
    """Do two polygons (arrays of x, y) have the same edges, up to a tolerance and to order and direction?"""

    def edges(a):
        n = F.size(a)
        edge = lambda i: F.array_sort(F.array(F.get(a, i), F.get(a, (i + 1) % n)))
        return F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), edge))

    close = lambda u, v: (F.abs(u["x"] - v["x"]) <= tolerance) & (F.abs(u["y"] - v["y"]) <= tolerance)
    pairs = F.zip_with(edges(p), edges(q), lambda e, f: close(F.get(e, F.lit(0)), F.get(f, F.lit(0))) & close(F.get(e, F.lit(1)), F.get(f, F.lit(1))))
    return (F.size(p) == F.size(q)) & ((F.size(p) == 0) | F.forall(pairs, lambda x: x))
