"""What the stages compute from one gray page: its skew, its place on a turned sheet, and its output. Cuts are in split, content boxes in content."""

from __future__ import annotations

import numpy as np

from pagemill.operators import rasters

#: The confidence of a good angle, bounds of the output's threshold, and the shadow that deskewing takes away at 150 dpi.
GOOD_CONFIDENCE = 2.0
LEAST_THRESHOLD, MOST_THRESHOLD = 30, 225
SHADOW = (200, 14)


def without_shadows(b: np.ndarray, dpi: float) -> np.ndarray:
    """A page without long horizontal shadows, which are looked for at less than 200 dpi."""
    small, at = b, dpi
    while at >= 200:
        small, at = rasters.reduce(small, 2), at / 2
    size = [max(1, int((n * at + 75) // 150)) for n in SHADOW]
    seed = rasters.opened(small, *size, True)
    k = round(dpi / at)
    whole = np.zeros_like(b)
    large = rasters.upscale(seed, k, k)[: b.shape[0], : b.shape[1]]
    whole[: large.shape[0], : large.shape[1]] = large
    return b & ~rasters.fill_from(whole & b, b)


def skew(g: np.ndarray, dpi: float = 100) -> tuple[float, float]:
    """(angle, confidence); an uncertain angle is 0. Pages of less than 200 dpi are not halved."""
    halved = {} if dpi >= 200 else {"coarse": 0, "fine": 0}
    angle, confidence = rasters.find_skew(without_shadows(g < rasters.otsu(g), dpi), **halved)
    return (angle, confidence) if confidence >= GOOD_CONFIDENCE else (0.0, confidence)


def rotated(g: np.ndarray, degrees: float, outside: int = 255) -> np.ndarray:
    """About the centre, the size staying."""
    if not degrees:
        return g
    h, w = g.shape
    s, c = np.sin(np.radians(degrees)), np.cos(np.radians(degrees))
    cx, cy = w / 2, h / 2
    m = np.array([[c, s, cx - c * cx - s * cy], [-s, c, cy + s * cx - c * cy], [0, 0, 1]])
    return rasters.transform_gray(g, m, h, w, outside)


def normalised(g: np.ndarray) -> np.ndarray:
    """Levels relative to the estimated background, which becomes white."""
    paper = rasters.background(g).astype(np.int64)
    return np.minimum(255, (g.astype(np.int64) * 255 + paper // 2) // np.maximum(paper, 1)).astype(np.uint8)


def picture_mask(g: np.ndarray) -> np.ndarray:
    """Where there is more than text: dark areas that survive a gray closing wider than strokes, grown back inside the dark."""
    flat = rasters.erode_gray(g, 13, 13)
    core = flat < 160
    return rasters.fill_from(core, rasters.closed(g < 200, 5, 5)) if core.any() else core


def smooth_edges(b: np.ndarray) -> np.ndarray:
    """Single bumps and dents of straight edges go."""
    for k in range(4):
        for pattern in ([" - ", "XXX"], ["X+X", "XXX"]):
            p = np.array([list(x) for x in pattern])
            b = rasters.hit_miss_replace(b, ["".join(r) for r in np.rot90(p, k)])
    return b


def rendered(g: np.ndarray, *args, **options) -> tuple[np.ndarray, np.ndarray]:
    """(output plane, specks taken away), as rendered_parts() has them."""
    return rendered_parts(g, *args, **options)[:2]


def rendered_parts(g: np.ndarray, mode: str = "bw", threshold: int = 0, normalize: bool = True, level: str = "cautious", fill: list | None = None, zones: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(output plane, specks taken away, picture mask). Black and white: normalise, smooth, binarize, smooth edges, despeckle, fill zones, in this
    order. Mixed: pictures keep their levels, none of them white. Zones: (kind, polygon) with kind eraser1, painter2 or eraser3
    of the picture mask; fill: (level, polygon)."""
    none = np.zeros_like(g, bool)
    if mode == "color":
        out = np.minimum(g, 254) if not normalize else np.minimum(normalised(g), 254)
        return filled(out, fill or [], 254), none, none
    flat = normalised(g) if normalize else g
    soft = rasters.smooth_local(flat, 5, 5, 3, 3)
    b = soft < int(np.clip(rasters.otsu(soft) + threshold, LEAST_THRESHOLD, MOST_THRESHOLD))
    b = smooth_edges(b)
    mask = none
    if mode == "mixed":
        mask = picture_mask(flat)
        for kind in ("eraser1", "painter2", "eraser3"):
            for k, points in zones or []:
                if k == kind:
                    area = rasters.fill_polygon(g.shape, points)
                    mask = mask | area if kind == "painter2" else mask & ~area
        b &= ~mask
    clean = rasters.despeckle(b, level) if level != "off" else b
    out = np.where(mask, np.minimum(flat, 254), np.where(clean, 0, 255)).astype(np.uint8)
    return filled(out, [(0 if v < 128 and mode == "bw" else 255 if mode == "bw" else v, p) for v, p in fill or []], 255), b & ~clean, mask


def filled(out: np.ndarray, fill: list, most: int) -> np.ndarray:
    for level, points in fill:
        out = np.where(rasters.fill_polygon(out.shape, points), min(level, most), out).astype(np.uint8)
    return out
