"""Curled pages made flat: text lines are traced, the curves of two of them make the model, and the best of several pairs is taken."""

from __future__ import annotations

import numpy as np

from pagemill.functions import curves
from pagemill.operators import rasters

#: How much wider than letters the gaps are that a line is smeared over, in letter heights; the least length of a line in widths of the page;
#: the degree of its curve; how many lines from the top and from the bottom are tried; and what a model must gain to be used.
SMEAR, LEAST_LENGTH, DEGREE, TRIED, LEAST_GAIN = 2.0, 0.4, 4, 3, 0.25


def letter_height(boxes: np.ndarray) -> float:
    """The median height of components that are no specks."""
    heights = boxes[:, 4] - boxes[:, 2] + 1
    heights = heights[boxes[:, 5] >= 4]
    return float(np.median(heights)) if len(heights) else 0.0


def text_lines(b: np.ndarray) -> list[np.ndarray]:
    """The curves of long text lines, top to bottom: polynomials through the middles of what letters and the gaps between them cover, as points
    from the left end to the right end."""
    h, w = b.shape
    boxes = rasters.component_boxes(rasters.labels(b))
    if not len(boxes):
        return []
    size = letter_height(boxes)
    if size < 2:
        return []
    letters = boxes[(boxes[:, 4] - boxes[:, 2] + 1 <= 3 * size) & (boxes[:, 5] >= 4)]
    spread = np.zeros_like(b)
    reach = int(SMEAR * size)
    # the middle third of each letter, smeared sideways, so that lines don't touch above and below
    for _, x0, y0, x1, y1, _ in letters.tolist():
        third = max(1, (y1 - y0 + 1) // 3)
        middle = (y0 + y1) // 2
        spread[max(0, middle - third // 2) : middle + third // 2 + 1, max(0, x0 - reach // 2) : x1 + reach // 2 + 1] = True
    lab = rasters.labels(spread)
    found = []
    for k, x0, y0, x1, y1, _ in rasters.component_boxes(lab).tolist():
        if x1 - x0 + 1 < LEAST_LENGTH * w:
            continue
        part = lab[y0 : y1 + 1, x0 : x1 + 1] == k
        weight = part.sum(axis=0)
        x = np.flatnonzero(weight)
        y = (part * np.arange(y1 - y0 + 1)[:, None]).sum(axis=0)[x] / weight[x]
        t = (x - x.mean()) / max(1, len(x))
        keep = np.ones(len(x), bool)
        for _ in range(3):  # outliers, as of lines that touch, go
            c = np.polyfit(t[keep], y[keep], min(DEGREE, max(1, keep.sum() // 20)))
            off = np.abs(np.polyval(c, t) - y)
            keep = off <= max(1.0, 2.5 * float(np.median(off[keep])))
        if float(np.median(off)) > size / 2:
            continue
        ends = np.linspace(0, len(x) - 1, 40).astype(int)
        found.append(np.column_stack([x0 + x[ends], y0 + np.polyval(c, t[ends])]))
    return sorted(found, key=lambda line: float(line[:, 1].mean()))


def side_lines(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) bounds of the lines' ends: x as a straight function of y, as far out as most ends reach."""
    out = []
    for end, outer in ((0, np.min), (-1, np.max)):
        p = np.array([line[end] for line in lines])
        slope = np.polyfit(p[:, 1], p[:, 0], 1)[0] if len(p) > 2 and np.ptp(p[:, 1]) > 0 else 0.0
        slope = float(np.clip(slope, -0.2, 0.2))
        out.append(np.array([slope, outer(np.sort(p[:, 0] - slope * p[:, 1])[1:-1] if len(p) > 4 else p[:, 0] - slope * p[:, 1])]))
    return out[0], out[1]


def extended(line: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A line up to both sides: cut there, or continued with its slope at that end."""
    n = max(2, len(line) // 5)
    slope0, slope1 = (np.polyfit(p[:, 0], p[:, 1], 1)[0] if np.ptp(p[:, 0]) > 0 else 0.0 for p in (line[:n], line[-n:]))
    x0 = left[0] * line[0, 1] + left[1]
    x1 = right[0] * line[-1, 1] + right[1]
    inner = line[(line[:, 0] > x0) & (line[:, 0] < x1)]
    if len(inner) < 2:
        return line
    first = [x0, inner[0, 1] - slope0 * (inner[0, 0] - x0)]
    last = [x1, inner[-1, 1] + slope1 * (x1 - inner[-1, 0])]
    return np.vstack([first, inner, last])


def waviness(lines: list[np.ndarray], model: curves.Cylinder | None) -> float:
    """How far the lines are from straight and level, as the mean square of their heights' deviations; of the lines themselves without a model."""
    total = 0.0
    for line in lines:
        y = line[:, 1] if model is None else model.to_unit(line)[:, 1] * float(np.abs(model.bottom[:, 1].mean() - model.top[:, 1].mean()))
        total += float(np.var(y))
    return total / max(1, len(lines))


def find_model(b: np.ndarray, depth: float = 2.0) -> curves.Cylinder | None:
    """The model of a page in black and white, or None if no pair of lines makes all lines much straighter."""
    lines = text_lines(b)
    if len(lines) < 3:
        return None
    left, right = side_lines(lines)
    long = [extended(line, left, right) for line in lines]
    best, least = None, waviness(lines, None) * (1 - LEAST_GAIN)
    for top in range(min(TRIED, len(long) - 1)):
        for bottom in range(len(long) - 1, max(top, len(long) - 1 - TRIED), -1):
            if bottom - top < 1 or not curves.valid_model(long[top], long[bottom]):
                continue
            try:
                model = curves.Cylinder(long[top], long[bottom], depth)
                error = waviness(lines, model)
            except np.linalg.LinAlgError:  # the four ends lie on a line
                continue
            if np.isfinite(error) and error < least:
                best, least = model, error
    return best


def flattened(g: np.ndarray, depth: float = 2.0) -> np.ndarray:
    """A gray page of the same size with straight text lines; the page itself if no model helps."""
    b = g < rasters.otsu(g)
    model = find_model(b, depth)
    if model is None:
        return g
    h, w = g.shape
    # unit coordinates of the page's sides tell how far the model must be carried beyond its curves
    at = np.linspace(0, 1, 9)
    upper, lower, left, right = (model.to_unit(np.column_stack(p)) for p in ((at * w, 0 * at), (at * w, 0 * at + h), (0 * at, at * h), (0 * at + w, at * h)))
    across, down = (float(np.median(left[:, 0])), float(np.median(right[:, 0]))), (float(np.median(upper[:, 1])), float(np.median(lower[:, 1])))
    return curves.dewarp(g, model, h, w, across=across, down=down)
