"""Array kernels on whole images, with numpy. Gray images are uint8 (y, x), binary ones bool with True for black.

Each is written for one image in memory; kernel() runs one of them over a table with an image a row.
"""

from __future__ import annotations

import heapq

import numpy as np

FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = FOUR + ((1, 1), (1, -1), (-1, 1), (-1, -1))
BIG = np.iinfo(np.int64).max // 4


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """b[y, x] = a[y - dy, x - dx], fill outside."""
    out = np.full_like(a, fill)
    h, w = a.shape
    ys, xs = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    yt, xt = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = a[yt, xt]
    return out


def sliding(a: np.ndarray, before: int, after: int, axis: int, outside, pick) -> np.ndarray:
    """pick (np.minimum or maximum) over i - before .. i + after along an axis, in log steps."""
    n, width = a.shape[axis], before + after + 1
    pad = [(0, 0)] * a.ndim
    pad[axis] = (before, after)
    b, have = np.pad(a, pad, constant_values=outside), 1
    while have < width:
        step = min(have, width - have)
        m = b.shape[axis] - step
        b = pick(np.take(b, range(m), axis), np.take(b, range(step, step + m), axis))
        have += step
    return np.take(b, range(n), axis)


def dilate(b: np.ndarray, w: int, h: int, outside: bool = False) -> np.ndarray:
    """Black spreads over a brick of w by h around its centre."""
    x = sliding(b, w - w // 2 - 1, w // 2, 1, outside, np.maximum)
    return sliding(x, h - h // 2 - 1, h // 2, 0, outside, np.maximum)


def erode(b: np.ndarray, w: int, h: int, outside: bool = True) -> np.ndarray:
    return ~dilate(~b, w, h, not outside)


def opened(b: np.ndarray, w: int, h: int, outside: bool = False) -> np.ndarray:
    e = erode(b, w, h, outside)
    return sliding(sliding(e, w // 2, w - w // 2 - 1, 1, False, np.maximum), h // 2, h - h // 2 - 1, 0, False, np.maximum)


def closed(b: np.ndarray, w: int, h: int) -> np.ndarray:
    d = np.pad(b, ((h, h), (w, w)))
    return ~opened(~d, w, h)[h:-h, w:-w]


def dilate_gray(g: np.ndarray, w: int, h: int, outside: int = 255) -> np.ndarray:
    """Dark spreads."""
    x = sliding(g, w // 2, w - w // 2 - 1, 1, outside, np.minimum)
    return sliding(x, h // 2, h - h // 2 - 1, 0, outside, np.minimum)


def erode_gray(g: np.ndarray, w: int, h: int, outside: int = 0) -> np.ndarray:
    return 255 - dilate_gray(255 - g, w, h, 255 - outside)


def open_gray(g: np.ndarray, w: int, h: int) -> np.ndarray:
    return dilate_gray(erode_gray(g, w, h), w, h)


def close_gray(g: np.ndarray, w: int, h: int, outside: int | None = None) -> np.ndarray:
    """outside: a level around the image for both steps; else what changes nothing."""
    if outside is None:
        return erode_gray(dilate_gray(g, w, h), w, h)
    return erode_gray(dilate_gray(np.pad(g, ((h, h), (w, w)), constant_values=outside), w, h, outside), w, h, outside)[h:-h, w:-w]


def gradient_dark(g: np.ndarray, w: int, h: int) -> np.ndarray:
    return g - dilate_gray(g, w, h)


def gradient_light(g: np.ndarray, w: int, h: int) -> np.ndarray:
    return erode_gray(g, w, h) - g


def hit_miss(b: np.ndarray, pattern: list[str], outside: bool = False) -> np.ndarray:
    """Places of the pattern's top left where X and - meet black, space and + meet white; ? is any."""
    out = np.ones_like(b)
    for j, row in enumerate(pattern):
        for i, c in enumerate(row):
            if c != "?":
                out &= shifted(b, -j, -i, outside) == (c in "X-")
    return out


def hit_miss_replace(b: np.ndarray, pattern: list[str], outside: bool = False) -> np.ndarray:
    """As hit_miss; then - turns white and + turns black."""
    n = max(len(pattern), *map(len, pattern))
    out = np.pad(b, n, constant_values=outside)  # patterns may begin outside
    at = hit_miss(out, pattern, outside)
    for j, row in enumerate(pattern):
        for i, c in enumerate(row):
            if c in "+-":
                out[shifted(at, j, i, False)] = c == "+"
    return out[n:-n, n:-n]


def labels(b: np.ndarray, around=EIGHT) -> np.ndarray:
    """Components 1 to N of black pixels in order of their first pixel; 0 is background. Union of runs by rows."""
    h, w = b.shape
    out, parent = np.zeros((h, w), np.int64), [0]

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    reach = 1 if len(around) == 8 else 0
    before: list[tuple[int, int, int]] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], b[y].astype(np.int8), [0]])))
        runs = []
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            mine = 0
            for p, q, k in before:
                if p < z + reach and q > a - reach:
                    k = find(k)
                    if mine and mine != k:
                        parent[max(mine, k)] = min(mine, k)
                        mine = min(mine, k)
                    else:
                        mine = k
            if not mine:
                mine = len(parent)
                parent.append(mine)
            out[y, a:z] = mine
            runs.append((a, z, mine))
        before = runs
    roots = np.array([find(k) for k in range(len(parent))])
    distinct = np.unique(roots)
    return np.searchsorted(distinct, roots)[out]


def component_boxes(lab: np.ndarray) -> np.ndarray:
    """label, left, top, right, bottom, pixels, a row for each component."""
    y, x = np.nonzero(lab)
    k = lab[y, x]
    n = int(lab.max(initial=0))
    lo, hi = np.full((2, n + 1), BIG), np.full((2, n + 1), -1)
    for i, v in enumerate((x, y)):
        np.minimum.at(lo[i], k, v)
        np.maximum.at(hi[i], k, v)
    return np.stack([np.arange(1, n + 1), lo[0, 1:], lo[1, 1:], hi[0, 1:], hi[1, 1:], np.bincount(k, minlength=n + 1)[1:]], axis=1)


def nearest(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, index of the row-major nearest True cell) of every cell: lower envelopes of parabolas,
    first down columns, then along rows, as in the linear-time separable method."""
    h, w = seeds.shape
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(seeds, rows, -1), axis=0)
    down = np.minimum.accumulate(np.where(seeds, rows, h + 10**6)[::-1], axis=0)[::-1]
    use_up = (up >= 0) & ((rows - up <= down - rows) | (down >= h))
    near = np.where(use_up, up, np.where(down < h, down, -1))
    gap = np.where(near >= 0, np.abs(rows - near), 10**6).astype(np.int64)
    # all rows at once: the parabola of column q takes over from the last one on the row's stack, after those it hides went
    f = gap * gap
    row = np.arange(h)
    stack, starts, top = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64), np.zeros(h, np.int64)
    for q in range(1, w):
        todo, at = row, np.zeros(h, np.int64)
        while len(todo):
            p = stack[todo, top[todo]]
            better = (q * q - p * p + f[todo, q] - f[todo, p]) // (2 * (q - p)) + 1  # q is better from here on
            hidden = better <= starts[todo, top[todo]]
            at[todo] = better
            todo = todo[hidden]
            top[todo] -= 1
            alone = todo[top[todo] < 0]
            at[alone] = 0
            todo = todo[top[todo] >= 0]
        push = row[at < w]
        top[push] += 1
        stack[push, top[push]], starts[push, top[push]] = q, at[push]
    held = np.arange(w)[None, :] <= top[:, None]
    place = np.zeros((h, w), np.int64)
    r, j = np.nonzero(held)
    place[r, starts[r, j]] = j
    own = np.take_along_axis(stack, np.maximum.accumulate(place, axis=1), axis=1)
    dist = (np.arange(w)[None, :] - own) ** 2 + np.take_along_axis(f, own, axis=1)
    by = np.take_along_axis(near, own, axis=1)
    return dist, np.where(by >= 0, by * w + own, -1)


#: Where the line outside of each side lies in an image with a border of one pixel.
SIDES = {"top": np.s_[0, :], "bottom": np.s_[-1, :], "left": np.s_[:, 0], "right": np.s_[:, -1]}


def distance_map(b: np.ndarray, to_black: bool = False, borders: bool | frozenset[str] = True) -> np.ndarray:
    """Squared distances to the nearest white (or black) pixel; with borders (all, or some of SIDES) the line outside counts as well."""
    seeds = np.pad(b == to_black, 1)
    for side in (SIDES if borders else ()) if isinstance(borders, bool) else borders:
        seeds[SIDES[side]] = True
    return nearest(seeds)[0][1:-1, 1:-1]


def influence(lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label of the nearest component, squared distance) of each pixel."""
    dist, source = nearest(lab > 0)
    return np.where(source >= 0, lab.ravel()[source], 0), dist


def fill_from(seed: np.ndarray, mask: np.ndarray, around=EIGHT) -> np.ndarray:
    """The black of mask that is connected to black of seed inside it."""
    lab = labels(mask, around)
    hit = np.unique(lab[seed & mask])
    return np.isin(lab, hit[hit > 0])


def fill_gray(seed: np.ndarray, mask: np.ndarray, around=EIGHT) -> np.ndarray:
    """Darkness of the seed spreads, nowhere darker than the mask: a priority flood from the darkest pixel."""
    out = np.maximum(seed, mask).astype(np.int64)
    h, w = out.shape
    queue = [(int(v), i) for i, v in enumerate(out.ravel().tolist())]
    heapq.heapify(queue)
    flat, m = out.ravel(), mask.ravel().astype(np.int64)
    while queue:
        v, i = heapq.heappop(queue)
        if v > flat[i]:
            continue
        y, x = divmod(i, w)
        for dy, dx in around:
            yy, xx = y + dy, x + dx
            if 0 <= yy < h and 0 <= xx < w:
                j = yy * w + xx
                t = max(v, m[j])
                if t < flat[j]:
                    flat[j] = t
                    heapq.heappush(queue, (int(t), j))
    return flat.reshape(h, w).astype(np.uint8)


def fill_gray_slow(seed: np.ndarray, mask: np.ndarray, around=EIGHT) -> np.ndarray:
    """The same by repeated passes, for tests."""
    out = np.maximum(seed, mask)
    while True:
        new = out
        for dy, dx in around:
            new = np.minimum(new, shifted(out, dy, dx, 255))
        new = np.maximum(new, mask)
        if np.array_equal(new, out):
            return out
        out = new


def reduce(b: np.ndarray, threshold: int) -> np.ndarray:
    """Blocks of 2 x 2 with `threshold` black or more; an odd last line is dropped, a single line is doubled."""
    h, w = b.shape
    b = np.repeat(b, 2, axis=0) if h == 1 else b[: h // 2 * 2]
    b = np.repeat(b, 2, axis=1) if w == 1 else b[:, : w // 2 * 2]
    return b.reshape(b.shape[0] // 2, 2, b.shape[1] // 2, 2).sum(axis=(1, 3)) >= threshold


def rotate_quarter(a: np.ndarray, degrees: int) -> np.ndarray:
    return np.rot90(a, -(degrees // 90) % 4)


def upscale(b: np.ndarray, sx: int, sy: int) -> np.ndarray:
    return np.repeat(np.repeat(b, sy, axis=0), sx, axis=1)


def otsu(g: np.ndarray) -> int:
    n = np.bincount(g.ravel(), minlength=256)
    below, moment = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(invalid="ignore", divide="ignore"):
        d = (moment[-1] - moment) / above - moment / below
        v = np.where((below > 0) & (above > 0), d * d * below * above, 0)
    if not v.max() > 0:
        return 0
    at = np.flatnonzero(v == v.max())
    return int(at[0] + 1 + at[-1] + 1) >> 1


def local_stats(g: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    ny, nx = g.shape
    sums = [np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g.astype(np.int64), g.astype(np.int64) ** 2)]
    y0, y1 = np.maximum(np.arange(ny) - h // 2, 0), np.minimum(np.arange(ny) + h - h // 2, ny)
    x0, x1 = np.maximum(np.arange(nx) - w // 2, 0), np.minimum(np.arange(nx) + w - w // 2, nx)
    area = (y1 - y0)[:, None] * (x1 - x0)
    a, b = ((s[np.ix_(y1, x1)] - s[np.ix_(y0, x1)] - s[np.ix_(y1, x0)] + s[np.ix_(y0, x0)]) / area for s in sums)
    return a, np.sqrt(np.abs(b - a * a))


def sauvola(g: np.ndarray, w: int, h: int) -> np.ndarray:
    mean, sigma = local_stats(g, w, h)
    return g < mean * (1 + 0.34 * (sigma / 128 - 1))


def wolf(g: np.ndarray, w: int, h: int, lower: int = 1, upper: int = 254) -> np.ndarray:
    mean, sigma = (x.astype(np.float32).astype(np.float64) for x in local_stats(g, w, h))
    with np.errstate(invalid="ignore", divide="ignore"):
        t = mean - 0.3 * (1 - sigma / sigma.max()) * (mean - g.min())
    return np.where(g < lower, True, np.where(g > upper, False, g < t))


def shear_columns(b: np.ndarray, t: float) -> np.ndarray:
    h, w = b.shape
    out = np.zeros_like(b)
    for x, s in enumerate(np.floor(t * (np.arange(w) + 0.5 - w / 2) + 0.5).astype(int).tolist()):
        out[max(0, s) : min(h, h + s), x] = b[max(0, -s) : min(h, h - s), x]
    return out


def skew_score(b: np.ndarray, degrees: float, ratio: float = 1.0) -> float:
    n = shear_columns(b, np.tan(np.radians(degrees)) / ratio).sum(axis=1).astype(np.int64)
    return float((np.diff(n) ** 2).sum())


def reduced(b: np.ndarray, times: int, first: int = 0) -> np.ndarray:
    """Halved `times` times: any black of four in the very first halving (number 0), two of four in later ones."""
    for i in range(first, first + times):
        b = reduce(b, 1 if i == 0 else 2)
    return b


#: Fixed value: a score that is no sign of text lines.
LOW_SCORE = 1000


def find_skew(b: np.ndarray, most: float = 7.0, accuracy: float = 0.1, coarse: int = 2, fine: int = 1, ratio: float = 1.0) -> tuple[float, float]:
    """(angle that the page is turned by, confidence): whole degrees first, on the page halved `coarse` times, then halving around the best one,
    on the page halved `fine` times. A confidence of 2 is good; a low score has none. ratio: horizontal resolution by vertical."""
    both = reduced(b, min(coarse, fine))
    small, large = reduced(both, coarse - min(coarse, fine), min(coarse, fine)), reduced(both, fine - min(coarse, fine), min(coarse, fine))
    grid = np.arange(-most, most + 1e-9)
    scores = [skew_score(small, a, ratio) for a in grid]
    at = int(np.argmax(scores))
    mean, top, angle = sum(scores) / len(scores), scores[at], float(grid[at])
    if accuracy < 1:
        ends = {a: skew_score(large, a, ratio) for a in (angle - 0.5, angle + 0.5)}
        if len(scores) == 1:
            mean = (sum(scores) + sum(ends.values())) / 3
        low, high = angle - 0.5, angle + 0.5
        while high - low > accuracy and ends[low] != ends[high]:
            middle = (low + high) / 2
            ends[middle] = skew_score(large, middle, ratio)
            low, high = (middle, high) if ends[high] > ends[low] else (low, middle)
        if ends[low] == ends[high]:  # as on a page that mirrors itself: their middle, if it is better
            ends[(low + high) / 2] = skew_score(large, (low + high) / 2, ratio)
        angle = max(ends, key=lambda a: (ends[a], -abs(a)) if low <= a <= high else (-1.0, 0.0))
        top = ends[angle]
        if top <= LOW_SCORE:
            return -angle, 0.0
    return -angle, top / mean - 1 if mean else 0.0


def scale_gray(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area-weighted downwards, interpolated between pixel centres upwards."""

    def weights(n, m):
        if m <= n:
            edge = np.arange(m + 1) * n / m
            lo, hi = edge[:-1, None], edge[1:, None]
            return np.clip(np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n)), 0, None) * m / n
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        a = np.floor(at).astype(int)
        out = np.zeros((m, n))
        out[np.arange(m), a] += 1 - (at - a)
        out[np.arange(m), np.minimum(a + 1, n - 1)] += at - a
        return out

    return np.floor(weights(g.shape[0], h) @ g.astype(np.float64) @ weights(g.shape[1], w).T + 0.5).astype(np.uint8)


def transform_gray(g: np.ndarray, m: np.ndarray, h: int, w: int, outside: int = 255, samples: int = 2) -> np.ndarray:
    """m: 3 x 3, from output to input. The mean of samples x samples points of each output pixel."""
    offsets = (np.arange(samples) + 0.5) / samples
    total = np.zeros((h, w))
    for dy in offsets:
        for dx in offsets:
            y, x = np.mgrid[0:h, 0:w]
            p = m @ np.stack([(x + dx).ravel(), (y + dy).ravel(), np.ones(h * w)])
            u, v = np.floor(p[0] / p[2]).astype(int), np.floor(p[1] / p[2]).astype(int)
            inside = (u >= 0) & (v >= 0) & (u < g.shape[1]) & (v < g.shape[0])
            total += np.where(inside, g[np.clip(v, 0, g.shape[0] - 1), np.clip(u, 0, g.shape[1] - 1)], outside).reshape(h, w)
    return np.floor(total / samples**2 + 0.5).astype(np.uint8)


def blur(g: np.ndarray, sx: float, sy: float) -> np.ndarray:
    """Gaussian blur, separable, mirrored at the borders."""

    def one(a, sigma, axis):
        if sigma <= 0:
            return a
        r = max(1, int(np.ceil(3 * sigma)))
        k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
        k /= k.sum()
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p = np.pad(a, pad, mode="symmetric")
        return sum(k[i] * np.take(p, range(i, i + a.shape[axis]), axis) for i in range(2 * r + 1))

    return np.floor(one(one(g.astype(np.float64), sx, 1), sy, 0) + 0.5).astype(np.uint8)


def sobel(g: np.ndarray, horizontal: bool = True) -> np.ndarray:
    p = np.pad(g.astype(np.int64), 1, mode="edge")
    if not horizontal:
        p = p.T
    d = p[:, 2:] - p[:, :-2]
    out = d[:-2] + 2 * d[1:-1] + d[2:]
    return out if horizontal else out.T


def polynomial_terms(y: np.ndarray, x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    return np.stack([y**j * x**i for j in range(dy + 1) for i in range(dx + 1)], axis=-1)


def local_kernel(w: int, h: int, dx: int, dy: int) -> np.ndarray:
    """Weights of a window's pixels in the value at its middle of the least-squares polynomial (Savitzky and Golay)."""
    j, i = np.mgrid[0:h, 0:w]
    a = polynomial_terms((j - h // 2).ravel().astype(float), (i - w // 2).ravel().astype(float), dy, dx)
    return np.linalg.pinv(a)[0].reshape(h, w)


def smooth_local(g: np.ndarray, w: int, h: int, dx: int, dy: int) -> np.ndarray:
    """Local least-squares polynomials of the window around each pixel."""
    kernel = local_kernel(w, h, dx, dy)
    p = np.pad(g.astype(np.float64), ((h // 2, h - h // 2 - 1), (w // 2, w - w // 2 - 1)), mode="edge")
    out = sum(kernel[y, x] * p[y : y + g.shape[0], x : x + g.shape[1]] for y in range(h) for x in range(w))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def polynomial_surface(g: np.ndarray, dx: int, dy: int, mask: np.ndarray | None = None) -> np.ndarray:
    """The least-squares surface of the masked pixels, rendered over the image; degrees shrink for few points."""
    y, x = np.nonzero(np.ones_like(g, bool) if mask is None else mask)
    while (dx + 1) * (dy + 1) > len(y) and (dx or dy):
        dx, dy = (dx - 1, dy) if dx >= dy else (dx, dy - 1)
    h, w = g.shape
    norm = lambda v, n: v / max(n - 1, 1)
    coefficients, *_ = np.linalg.lstsq(polynomial_terms(norm(y, h), norm(x, w), dy, dx), g[y, x].astype(float), rcond=None)
    j, i = np.mgrid[0:h, 0:w]
    return np.clip(np.floor(polynomial_terms(norm(j, h), norm(i, w), dy, dx) @ coefficients + 0.5), 0, 255).astype(np.uint8)


def polynomial_line(v: np.ndarray, degree: int) -> np.ndarray:
    """The least-squares polynomial of a row of values, at each of them; the degree shrinks for few values."""
    t = np.arange(len(v)) / max(1, len(v))
    return np.polyval(np.polyfit(t, v, min(degree, len(v) - 1)), t)


def framed(h: int, w: int, inside: int, frame: int) -> np.ndarray:
    """A gray canvas with a frame of one pixel, from which floods start."""
    out = np.full((h, w), inside, np.uint8)
    out[[0, -1], :] = frame
    out[:, [0, -1]] = frame
    return out


def drawn_over(g: np.ndarray, part: np.ndarray, y: int, x: int) -> np.ndarray:
    """g with `part` at a place; what reaches beyond g is left out."""
    out = g.copy()
    y0, x0, y1, x1 = max(0, y), max(0, x), min(g.shape[0], y + part.shape[0]), min(g.shape[1], x + part.shape[1])
    if y0 < y1 and x0 < x1:
        out[y0:y1, x0:x1] = part[y0 - y : y1 - y, x0 - x : x1 - x]
    return out


def background(g: np.ndarray, darker: int = 30) -> np.ndarray:
    """The paper's level: text is flooded away from top and bottom and from all sides, the gentler variant is taken where both
    are alike, pixels much darker than a polynomial through their column or row go, and a surface fits the rest."""
    edge = np.full_like(g, 255)
    edge[0], edge[-1] = g[0], g[-1]
    top_bottom = erase_dark(g, edge)
    edge[:, 0], edge[:, -1] = g[:, 0], g[:, -1]
    sides = erase_dark(g, edge)
    lit = top_bottom if (np.abs(top_bottom.astype(int) - sides) > 10).mean() < 0.01 else sides
    keep = np.ones_like(g, bool)
    for axis, degree in ((0, 2), (1, 4)):
        line = np.apply_along_axis(polynomial_line, axis, lit.astype(float), degree)
        keep &= lit > line - darker
    return polynomial_surface(lit, 5, 5, keep if keep.any() else None)


def erase_dark(g: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Darkness that is not connected to that of the edge is lifted to the level of its surroundings."""
    return fill_gray(np.maximum(edge, g), g)


def fill_polygon(shape: tuple[int, int], points: list[tuple[float, float]], winding: bool = False) -> np.ndarray:
    """Pixels whose centres lie inside, by scan lines; odd-even or winding rule."""
    h, w = shape
    out = np.zeros(shape, bool)
    n = len(points)
    x = np.arange(w) + 0.5
    for row in range(h):
        y = row + 0.5
        count = np.zeros(w, int)
        for k in range(n):
            (x1, y1), (x2, y2) = points[k], points[(k + 1) % n]
            if (y1 <= y) != (y2 <= y):
                at = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
                count += np.where(x > at, (1 if y2 > y1 else -1) if winding else 1, 0)
        out[row] = count != 0 if winding else count % 2 == 1
    return out


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def dents_and_holes(b: np.ndarray) -> np.ndarray:
    """White pixels between black ones of a horizontal, vertical or diagonal line."""

    def between(a):
        return np.maximum.accumulate(a, axis=1) & np.maximum.accumulate(a[:, ::-1], axis=1)[:, ::-1]

    h, w = b.shape
    out = between(b) | between(b.T).T
    for flip in (False, True):
        src = b[:, ::-1] if flip else b
        skew = np.zeros((h, w + h - 1), bool)
        for y in range(h):
            skew[y, y : y + w] = src[y]
        found = between(skew.T).T
        diagonal = np.stack([found[y, y : y + w] for y in range(h)])
        out |= diagonal[:, ::-1] if flip else diagonal
    return out & ~b


def largest_white(b: np.ndarray, count: int, least_w: int = 1, least_h: int = 1, iterations: int = 1000) -> list[tuple[int, int, int, int]]:
    """Up to `count` large white rectangles (left, top, width, height), best first: an area is split at the obstacle
    nearest its middle into four, the most promising area is tried first, and found ones become obstacles."""
    b = b.copy()
    found = []
    for _ in range(count):
        total = np.pad(np.cumsum(np.cumsum(b, 0), 1), ((1, 0), (1, 0)))
        queue, steps = [(-b.size, 0, 0, b.shape[1], b.shape[0])], 0
        best = None
        while queue and steps < iterations:
            steps += 1
            _, x0, y0, x1, y1 = heapq.heappop(queue)
            if total[y1, x1] - total[y0, x1] - total[y1, x0] + total[y0, x0] == 0:
                best = (x0, y0, x1 - x0, y1 - y0)
                break
            ys, xs = np.nonzero(b[y0:y1, x0:x1])
            k = int(np.argmin((ys + 0.5 - (y1 - y0) / 2) ** 2 + (xs + 0.5 - (x1 - x0) / 2) ** 2))
            px, py = x0 + int(xs[k]), y0 + int(ys[k])
            for a in ((x0, y0, px, y1), (px + 1, y0, x1, y1), (x0, y0, x1, py), (x0, py + 1, x1, y1)):
                if a[2] - a[0] >= least_w and a[3] - a[1] >= least_h:
                    heapq.heappush(queue, (-(a[2] - a[0]) * (a[3] - a[1]), *a))
        if best is None:
            break
        found.append(best)
        b[best[1] : best[1] + best[3], best[0] : best[0] + best[2]] = True
    return found


#: Fixed values of the despeckling levels at 300 dpi: the width or height in pixels from which a component is big, how far (in squared
#: pixels, for each pixel of its own) a component may lie from what it is attached to, and what share of its own pixels that must have.
DESPECKLE = {"cautious": (7, 100, 0.125), "normal": (12, 42, 0.175), "aggressive": (17, 12, 0.225)}


def neighbours(lab: np.ndarray, seeds: np.ndarray, blocked: np.ndarray | None = None) -> dict[tuple[int, int], int]:
    """Pairs of labels whose areas of influence touch, with the least squared distance between their pixels next to the border, less
    the step over the border. Vertical distances count twice when areas are parted. seeds: pixels from which areas grow; areas leave out `blocked` cells."""
    h, w = lab.shape
    tall = np.zeros((2 * h, w), bool)
    tall[::2] = seeds
    source = nearest(tall)[1][::2]
    known = source >= 0
    if blocked is not None:
        known &= ~blocked
    sy, sx = np.divmod(np.where(known, source, 0), w)
    sy //= 2
    area = np.where(known, lab[sy, sx], 0)
    out: dict[tuple[int, int], int] = {}
    for dy, dx in ((0, 1), (1, 0)):
        p, q = np.s_[: h - dy, : w - dx], np.s_[dy:, dx:]
        touch = (area[p] != area[q]) & known[p] & known[q]
        i, j = area[p][touch], area[q][touch]
        d = (sx[q][touch] - dx - sx[p][touch]) ** 2 + (sy[q][touch] - dy - sy[p][touch]) ** 2
        for a, b, v in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), d.tolist(), strict=True):
            if v < out.get((a, b), BIG):
                out[a, b] = v
    return out


def despeckle(b: np.ndarray, level: str = "normal", dpi: int = 300) -> np.ndarray:
    """Small components go unless they are attached, over components near each other, to a big one.

    All big components are one. Two components are near if their areas of influence touch. One may be attached to another that is not
    farther than its own pixels allow and not much smaller. Components near smaller ones only get a second chance, in which their areas
    grow over those of the rest; it is taken if the last component is one of them (a fixed rule).
    """
    lab = labels(b)
    n = int(lab.max(initial=0))
    if not n:
        return b.copy()
    big_from, reach, share = DESPECKLE[level]
    big_from, share = int(np.floor(big_from * dpi / 300 + 0.5)), share * dpi / 300
    box = component_boxes(lab)
    is_big = np.maximum(box[:, 3] - box[:, 1], box[:, 4] - box[:, 2]) + 1 >= big_from
    # new numbers: in order, the first big one stands for all
    kept = ~is_big
    big = 0
    if is_big.any():
        kept[np.argmax(is_big)] = True
    number = np.concatenate([[0], np.cumsum(kept)])
    if is_big.any():
        big = int(number[1 + np.argmax(is_big)])
        number[1:][is_big] = big
    lab = number[lab]
    size = [0] * (int(number.max()) + 1)
    for k, pixels in zip(number[1:].tolist(), box[:, 5].tolist(), strict=True):
        size[k] = b.size if k == big else pixels
    near = neighbours(lab, lab > 0)

    # tags stand in the upper bits of the sizes, so a tagged component counts as a large one while tags are given
    to_big, to_small, wrap = 1 << 31, 1 << 30, 1 << 32
    tagged = list(size)
    for pair in sorted(near):
        for source, target in (pair, pair[::-1]):
            if not tagged[source] & to_big and near[pair] <= tagged[source] * reach % wrap:
                tagged[source] |= to_big if tagged[target] >= share * tagged[source] else to_small
    tagged[big] |= to_big
    only_small = [t & (to_big | to_small) == to_small for t in tagged]
    if only_small[-1]:
        growing = np.array(only_small)[lab]
        for pair, d in neighbours(lab, growing, (lab > 0) & ~growing).items():
            near[pair] = min(d, near.get(pair, BIG))

    attached: dict[int, list[int]] = {}
    for pair, d in near.items():
        for source, target in (pair, pair[::-1]):
            if d <= size[source] * reach and size[target] >= size[source] * share:
                attached.setdefault(target, []).append(source)
    stays, todo = np.zeros(len(size), bool), [big]
    while todo:
        k = todo.pop()
        if not stays[k]:
            stays[k] = True
            todo += attached.get(k, [])
    stays[0] = False
    return stays[lab]


def peaks(v: np.ndarray, w: int, h: int) -> np.ndarray:
    """Plateaus of equal cells, connected over eight neighbours, of which none has an equal or greater cell in the window of w by h
    (odd) around it besides its own plateau's."""
    low = np.iinfo(np.int64).min

    def greatest(a):
        return sliding(sliding(a, w // 2, w // 2, 1, low, np.maximum), h // 2, h // 2, 0, low, np.maximum)

    v = v.astype(np.int64)
    top = greatest(v) == v
    beside = top & (greatest(np.where(top, low, v)) == v)
    return top & ~fill_from(beside, top)


def distance_peaks(b: np.ndarray, to_black: bool = False, borders: bool = False) -> np.ndarray:
    """Ultimate eroded points: the plateau peaks of the distance map, in windows of 3 by 3."""
    d = np.pad(np.minimum(distance_map(b, to_black, borders), BIG >> 2), 1)
    return peaks(d, 3, 3)[1:-1, 1:-1]
