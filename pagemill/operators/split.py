"""Where a scan is cut into logical pages: at folding lines, else at white space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pagemill.operators import lines, rasters

#: Fixed values. In shares of half the width: two-page folds lie this near the middle; of one page's lines, which lie on one side, those beyond
#: FAR count as edges of which the nearer one is taken, and lines beyond EDGE make a cut page. The share of all content that spans at the
#: edges must hold, the balance of the best gap, how close to it others must come, and pixels at 150 dpi around a lone span.
NEAR_CENTRE, FAR, EDGE, EDGE_SPAN, GAP_RATIO, NEARLY_BEST, LONE = 0.6, 0.3, 0.65, 15, 0.25, 0.9, 15
MOST_LINES, GOOD_CONFIDENCE = 8, 2.0

Cutter = tuple[float, float]


@dataclass(frozen=True)
class Layout:
    """kind: single_uncut (no cutters), page_plus_offcut (two) or two_pages (one). A cutter is its x at the top and at the bottom."""

    kind: str
    cutters: tuple[Cutter, ...] = ()


def logical_pages(w: int, h: int, dpi_x: float = 1, dpi_y: float = 1) -> int:
    """Two for sheets that are wider than high."""
    return 2 if w * dpi_y > h * dpi_x else 1


def at_dpi(g: np.ndarray, dpi: float, target: float) -> np.ndarray:
    if dpi == target:
        return g
    size = [max(1, int(np.ceil(n * target / dpi))) for n in g.shape]
    return rasters.scale_gray(g, *size)


def spans(counts: np.ndarray, least: int = 1, gap: int = 1) -> list[tuple[int, int]]:
    """[from, to) of runs above 0, joined over gaps shorter than `gap`; narrow ones go after that."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (counts > 0).astype(np.int8), [0]])))
    out: list[list[int]] = []
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if out and a - out[-1][1] < gap:
            out[-1][1] = z
        else:
            out.append([a, z])
    return [(a, z) for a, z in out if z - a >= least]


def without_edge_spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The narrower of the first and the last span goes, again and again, while all that goes is a fifteenth of all content at most."""
    found, size = list(found), lambda s: s[1] - s[0]
    budget = sum(map(size, found)) // EDGE_SPAN
    while len(found) > 1:
        at = 0 if size(found[0]) < size(found[-1]) else -1
        if size(found[at]) > budget:
            break
        budget -= size(found.pop(at))
    return found


def middle(c: Cutter) -> float:
    return (c[0] + c[1]) / 2


def cut_at_lines(kind: str, pages: int, found: list[Cutter], w: float) -> Layout | None:
    """The layout by folding lines, or None if they don't tell. kind: auto, page_plus_offcut or two_pages."""
    found, centre = sorted(found, key=middle), w / 2
    if pages == 2:
        near = [c for c in found if abs(middle(c) - centre) <= NEAR_CENTRE * centre]
        return Layout("two_pages", (min(near, key=lambda c: abs(middle(c) - centre)),)) if near else None
    if len(found) > 1:
        first, last = (centre - middle(c) for c in (found[0], found[-1]))
        if (first < 0) == (last < 0) and min(abs(first), abs(last)) >= FAR * centre:
            found = [found[0] if abs(first) < abs(last) else found[-1]]
    outer = [found[0], found[-1]] if found else []
    if kind != "page_plus_offcut" and all(abs(centre - middle(c)) <= EDGE * centre for c in outer):
        return Layout("single_uncut")
    if not found:
        return None
    if len(found) > 1:
        return Layout("page_plus_offcut", (found[0], found[-1]))
    left, right = (0.0, 0.0), (float(w), float(w))
    return Layout("page_plus_offcut", (found[0], right) if middle(found[0]) < centre else (left, found[0]))


def without_garbage(b: np.ndarray) -> np.ndarray:
    """A page at 150 dpi without what holds no bar of four pixels, and without long shadows."""
    bars = rasters.opened(b, 4, 1) | rasters.opened(b, 1, 4)
    b = rasters.fill_from(bars, b)
    shadows = rasters.opened(b, 200, 14, True) | rasters.opened(b, 14, 300, True)
    return b & ~rasters.fill_from(shadows, rasters.dilate(b, 3, 3))


def two_page_cut(found: list[tuple[int, int]], w: int) -> float:
    """The gap that parts the content best (by the ratio of what lies before and after), then the widest of its neighbours that part it nearly as well."""
    if not found:
        return w / 2
    a, z = found[0][0], found[-1][1]
    if len(found) == 1:
        return lone_span_cut(found[0], w)
    before = np.array([s[1] - a for s in found[:-1]])
    after = np.array([z - s[0] for s in found[1:]])
    ratio = np.minimum(before, after) / np.maximum(before, after)
    best = int(np.argmax(ratio))
    if ratio[best] < GAP_RATIO:
        return lone_span_cut((a, z), w)
    good = ratio >= NEARLY_BEST * ratio[best]
    low, high = best, best
    while low > 0 and good[low - 1]:
        low -= 1
    while high + 1 < len(ratio) and good[high + 1]:
        high += 1
    width = lambda i: found[i + 1][0] - found[i][1]
    # of equal widths the best gap, then the nearest one before it, then after it
    widest = min(range(low, high + 1), key=lambda i: (-width(i), i != best, i > best, abs(i - best)))
    return (found[widest][1] + found[widest + 1][0]) / 2


def lone_span_cut(span: tuple[int, int], w: int) -> float:
    """The middle of the sheet, if all content lies well on one side of it; else just beside the content, where more white is."""
    a, z = span
    if abs(w / 2 - (a + z) / 2) - (z - a) / 2 > LONE:
        return w / 2
    return max(0, a - LONE) if a > w - z else min(w, z + LONE)


def offcut_cut(kind: str, found: list[tuple[int, int]], w: int, left: bool, right: bool) -> Layout:
    """One page; left, right: is there something at that edge? For kind auto that side is cut off, unless its span is the page."""
    whole = (0.0, 0.0), (float(w), float(w))
    if kind != "auto":
        return Layout("page_plus_offcut", whole)
    if left and not right and not (found and found[0][0] == 0 and found[0][1] > w // 2):
        if not found:
            x = 0.0
        elif found[0][0] > 0:
            x = found[0][0] / 2
        else:
            x = (found[0][1] + found[1][0]) / 2 if len(found) > 1 else min(found[0][1] + 20, w)
        return Layout("page_plus_offcut", ((x, x), whole[1]))
    if right and not left and not (found and found[-1][1] == w and w - found[-1][0] > w // 2):
        if not found:
            x = float(w)
        elif found[-1][1] < w:
            x = (found[-1][1] + w) / 2
        else:
            x = (found[-2][1] + found[-1][0]) / 2 if len(found) > 1 else max(found[-1][0] - 20, 0)
        return Layout("page_plus_offcut", (whole[0], (x, x)))
    return Layout("single_uncut")


def cut_at_whitespace(g: np.ndarray, kind: str, pages: int, dpi: float) -> Layout:
    """By spans of columns with content, on the page at 150 dpi, black and white, cleaned and sheared upright."""
    b = without_garbage(rasters.reduce(at_dpi(g, dpi, 300) < rasters.otsu(g), 2))
    h, w = b.shape
    left, right = b[2 : h - 2, 2:5].any(), b[2 : h - 2, max(0, w - 5) : w - 2].any()
    angle, confidence = rasters.find_skew(b, accuracy=0.5)
    t, margin = 0.0, 0
    if angle and confidence >= GOOD_CONFIDENCE:
        t = float(np.tan(np.radians(-angle)))
        margin = int(np.ceil(abs(0.5 * h * t)))
        if w > 2 * margin:
            b = rasters.shear_columns(b.T, -t).T[:, margin : w - margin]
        else:
            t, margin = 0.0, 0
    blocks = np.zeros_like(b)
    for _, x0, y0, x1, y1, _ in rasters.component_boxes(rasters.labels(b)).tolist():
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        if bw >= 5 and bh >= 5 and bh <= 6 * bw:
            blocks[y0 : y1 + 1, x0 : x1 + 1] = True
    found = spans(blocks.sum(axis=0), 2, 8)
    if pages == 2:
        x = two_page_cut(without_edge_spans(found), b.shape[1])
        cut = Layout("two_pages", ((x, x),))
    else:
        cut = offcut_cut(kind, found, b.shape[1], bool(left), bool(right))
    scale = dpi / 150

    def back(c: Cutter) -> Cutter:
        """Sheared rows lie shifted by -t times their distance from the middle."""
        if c in ((0.0, 0.0), (float(b.shape[1]),) * 2):  # the sheet's own edges
            return (0.0, 0.0) if c[0] == 0 else (float(g.shape[1]),) * 2
        return (c[0] + margin - t * h / 2) * scale, (c[1] + margin + t * h / 2) * scale

    return Layout(cut.kind, tuple(map(back, cut.cutters)))


def split_page(g: np.ndarray, kind: str = "auto", dpi: float = 100) -> Layout:
    """kind: auto, single_uncut, page_plus_offcut or two_pages."""
    if kind == "single_uncut":
        return Layout(kind)
    h, w = g.shape
    pages = logical_pages(w, h) if kind == "auto" else 1 + (kind == "two_pages")
    small = at_dpi(g, dpi, 100)
    scale = dpi / 100
    found = [(a * scale, b * scale) for a, b in lines.vertical_lines(small, MOST_LINES)]
    return cut_at_lines(kind, pages, found, w) or cut_at_whitespace(g, kind, pages, dpi)


def page_outlines(w: int, h: int, layout: Layout) -> dict[int, tuple[Cutter, Cutter]]:
    """Sub-page (0 for the only one, 1 and 2 for left and right) -> its left and right edges."""
    left, right = (0.0, 0.0), (float(w), float(w))
    clip = lambda c: tuple(min(max(x, 0.0), float(w)) for x in c)
    if layout.kind == "two_pages":
        cut = clip(layout.cutters[0])
        return {1: (left, cut), 2: (cut, right)}
    return {0: tuple(map(clip, layout.cutters)) if layout.cutters else (left, right)}


def cut_page(g: np.ndarray, left: Cutter, right: Cutter, outside: int = 255) -> tuple[np.ndarray, int, int]:
    """(the page, its first column, the column after its last one) between two edges; what lies beyond a tilted edge is `outside`."""
    h, w = g.shape
    x0, x1 = max(0, int(np.floor(min(left)))), min(w, int(np.ceil(max(right))))
    page = g[:, x0:x1]
    if left[0] == left[1] and right[0] == right[1] or not page.size:
        return page, x0, x1
    y, x = (np.arange(h) + 0.5)[:, None] / h, x0 + np.arange(x1 - x0)[None, :] + 0.5
    inside = (x >= left[0] + (left[1] - left[0]) * y) & (x <= right[0] + (right[1] - right[0]) * y)
    return np.where(inside, page, outside).astype(np.uint8), x0, x1
