"""The content box of a page at 150 dpi: shadows away, blocks between large white rectangles, a mask of text lines, and trimming
of the four sides by what lies near garbage rather than near the rest."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from pagemill.operators import rasters
from pagemill.operators.split import at_dpi

#: Window and lower level of the binarization, sizes of shadows, white rectangles in each pass, and of text lines the least
#: height and the shares of black in them.
WINDOW, LEVEL, SHADOW, WIDE_RECTANGLES, HIGH_RECTANGLES, MORE_RECTANGLES, TEXT_HEIGHT, LEAST_FILL, MOST_FILL = 51, 50, ((200, 14), (14, 300)), 80, 40, 10, 6, 0.22, 0.65

Box = tuple[int, int, int, int]


class WhiteSpaces:
    """White rectangles (left, top, right, bottom; ends exclusive) of an image, those of the greatest value first.

    Regions wait in order of their value, an upper bound for what they hold. One with an obstacle or a black pixel is split
    around it into four; the first without is the answer.
    """

    def __init__(self, b: np.ndarray, value: Callable[[int, int], int] = lambda w, h: w * h, least: tuple[int, int] = (1, 1)):
        self.b, self.value, self.least = b, value, least
        self.total = np.pad(np.cumsum(np.cumsum(b, 0, dtype=np.int64), 1), ((1, 0), (1, 0)))
        self.obstacles: list[Box] = []
        self.queue: list = []
        self.count = 0
        self._push((0, 0, b.shape[1], b.shape[0]), (), 0)

    def _push(self, box: Box, obstacles: tuple, known: int) -> None:
        w, h = box[2] - box[0], box[3] - box[1]
        if w >= self.least[0] and h >= self.least[1] and w > 0 and h > 0:
            self.count += 1
            heapq.heappush(self.queue, (-self.value(w, h), self.count, box, obstacles, known))

    def _sum(self, x0: int, y0: int, x1: int, y1: int) -> int:
        t = self.total
        return int(t[y1, x1] - t[y0, x1] - t[y1, x0] + t[y0, x0])

    def add_obstacle(self, box: Box) -> None:
        self.obstacles.append(box)

    def next(self, iterations: int = 1000) -> Box | None:
        meets = lambda p, q: p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]
        while self.queue and iterations:
            iterations -= 1
            _, _, box, held, known = heapq.heappop(self.queue)
            held = tuple(o for o in (*held, *self.obstacles[known:]) if meets(box, o))
            if held:
                cx, cy = box[0] + box[2], box[1] + box[3]
                pivot = min(held, key=lambda o: (o[0] + o[2] - cx) ** 2 + (o[1] + o[3] - cy) ** 2)
            elif self._sum(*box):
                pivot = self._black_box(box)
            else:
                return box
            x0, y0, x1, y1 = box
            a, b, c, d = pivot
            for part in ((x0, y0, x1, b), (x0, d, x1, y1), (x0, y0, a, y1), (c, y0, x1, y1)):
                if part[0] < part[2] and part[1] < part[3]:
                    self._push(part, tuple(o for o in held if meets(part, o)), len(self.obstacles))
        return None

    def _black_box(self, box: Box) -> Box:
        """A black rectangle around a black pixel that is near the middle of the box."""
        x0, y0, x1, y1 = box
        cx, cy = (x0 + x1 - 1) // 2, (y0 + y1 - 1) // 2
        around = lambda k: (max(x0, cx - k), max(y0, cy - k), min(x1, cx + k + 1), min(y1, cy + k + 1))
        low, high = -1, max(x1 - x0, y1 - y0)
        while high - low > 1:
            k = (low + high) // 2
            low, high = (low, k) if self._sum(*around(k)) else (k, high)
        a, b, c, d = around(high)
        y, x = np.nonzero(self.b[b:d, a:c]) if high < 2 else self._ring(a, b, c, d)
        k = int(np.argmin((y + b - cy) ** 2 + (x + a - cx) ** 2))
        px, py = a + int(x[k]), b + int(y[k])
        row = ~self.b[py, x0:x1]
        gaps = np.flatnonzero(row) + x0
        left = int(gaps[gaps < px].max(initial=x0 - 1)) + 1
        right = int(gaps[gaps > px].min(initial=x1))

        def reach(ends, far):
            """The farthest end up to which all rows of the run are black."""
            low, high = 0, abs(far - ends(0))
            while low < high:
                k = (low + high + 1) // 2
                top, bottom = min(py, ends(k)), max(py + 1, ends(k))
                low, high = (k, high) if self._sum(left, top, right, bottom) == (right - left) * (bottom - top) else (low, k - 1)
            return ends(low)

        return left, reach(lambda k: py - k, y0), right, reach(lambda k: py + 1 + k, y1)

    def _ring(self, a: int, b: int, c: int, d: int):
        """The black pixels on the sides of a rectangle."""
        side = np.zeros((d - b, c - a), bool)
        for s in (np.s_[0, :], np.s_[-1, :], np.s_[:, 0], np.s_[:, -1]):
            side[s] = self.b[b:d, a:c][s]
        return np.nonzero(side)


def touching(b: np.ndarray) -> np.ndarray:
    """The pixels on the four sides."""
    edge = np.zeros_like(b)
    edge[0] = edge[-1] = edge[:, 0] = edge[:, -1] = True
    return edge


def trimmed_blocks(content: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Each block is cut to the box of its content; blocks without any go."""
    lab = rasters.labels(blocks, rasters.FOUR)
    n = int(lab.max(initial=0))
    y, x = np.nonzero(content & blocks)
    k = lab[y, x]
    low, high = np.full((2, n + 1), rasters.BIG), np.full((2, n + 1), -1)
    for i, v in enumerate((x, y)):
        np.minimum.at(low[i], k, v)
        np.maximum.at(high[i], k, v)
    yy, xx = np.indices(blocks.shape)
    return blocks & (xx >= low[0][lab]) & (xx <= high[0][lab]) & (yy >= low[1][lab]) & (yy <= high[1][lab])


def without_borders(blocks: np.ndarray) -> np.ndarray:
    """Blocks at the sides go as far as a quarter of the shorter side, step by step inside them."""
    most = min(blocks.shape) // 4
    gone = blocks & touching(blocks)
    front = gone
    for _ in range(most - 1):
        if not front.any():
            break
        near = np.zeros_like(blocks)
        for dy, dx in rasters.FOUR:
            near |= rasters.shifted(front, dy, dx, False)
        front = near & blocks & ~gone
        gone = gone | front
    return blocks & ~gone


def line_ranges(rows: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the text lines that a histogram of rows shows: split at valleys between shoulders of like height, the deepest first."""
    found, todo = [], [(0, len(rows))]
    while todo:
        a, z = todo.pop()
        if z - a < TEXT_HEIGHT:
            continue
        r = rows[a:z]
        inner = r[1:-1]
        peak1, peak2 = np.maximum.accumulate(r)[: len(inner)], np.maximum.accumulate(r[::-1])[::-1][2:]
        s1, s2 = peak1 - inner, peak2 - inner
        good = (inner * 3.5 <= 0.5 * (peak1 + peak2)) & (s1 > 0) & (s2 > 0) & (np.minimum(s1, s2) * 20 >= np.maximum(s1, s2))
        if good.any():
            at = a + 1 + int(np.argmax(np.where(good, s1 + s2, -1)))
            todo += [(a, at), (at + 1, z)]
        else:
            found.append((a, z))
    return found


def text_line(rows: np.ndarray, widths: np.ndarray, a: int, z: int) -> tuple[int, int] | None:
    """[top, bottom) of the text in rows [a, z): around its centre of weight, as long as black fills enough of the block and not too much; rows:
    black pixels, widths: pixels of the block."""
    weight = int(rows[a:z].sum())
    if not weight:
        return None
    centre = int((rows[a:z] * np.arange(a, z)).sum() + weight // 2) // weight
    top, bottom = centre - TEXT_HEIGHT // 2, centre - TEXT_HEIGHT // 2 + TEXT_HEIGHT - 1
    if top < a or bottom > z - 1:
        return None
    black, area = int(rows[top : bottom + 1].sum()), int(widths[top : bottom + 1].sum())
    if not LEAST_FILL * area <= black <= MOST_FILL * area:
        return None
    widest = int(widths[top : bottom + 1].max())
    while (top > a or bottom < z - 1) and abs((centre - top) - (bottom - centre)) <= 1:
        t, b = max(a, top - 1), min(z - 1, bottom + 1)
        black, area = black + int(rows[t] + rows[b]), area + int(widths[t] + widths[b])
        if black < LEAST_FILL * area:
            break
        widest = max(widest, int(widths[t]), int(widths[b]))
        top, bottom = t, b
    if black > MOST_FILL * area or widest < (bottom - top + 1) * 0.6:
        return None
    return top, bottom + 1


def text_mask(content: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Rows of blocks that hold text lines. A line differs from a straight stroke by the peaks of the white distances in it."""
    points = rasters.distance_peaks(content, True)
    lab = rasters.labels(blocks, rasters.FOUR)
    mask = np.zeros_like(content)
    for k, x0, y0, x1, y1, _ in rasters.component_boxes(lab).tolist():
        area = np.s_[y0 : y1 + 1, x0 : x1 + 1]
        block = lab[area] == k
        rows, widths = (content[area] & block).sum(axis=1), block.sum(axis=1)
        for a, z in line_ranges(rows):
            line = text_line(rows, widths, a, z)
            if line is None:
                continue
            top, bottom = line
            least = int(0.4 * (x1 - x0 + 1) / (bottom - top))
            if least:
                inside = np.s_[y0 + top : y0 + bottom, x0 : x1 + 1]
                if int(rasters.labels(points[inside] & blocks[inside], rasters.FOUR).max(initial=0)) < least:
                    continue
            mask[y0 + top : y0 + bottom, x0 : x1 + 1] |= block[top:bottom]
    return mask


def genuine_shadows(shadows: np.ndarray) -> np.ndarray:
    """Shadows that touch the sides, and others unless white text stands in them."""
    edge = touching(shadows)
    outer = rasters.fill_from(edge & shadows, shadows)
    inner = shadows & ~outer
    if inner.any():
        around = rasters.fill_from(edge & ~inner, ~inner)
        text = text_mask(~inner, ~around | inner)
        inner &= ~rasters.fill_from(text & inner, inner)
    return outer | inner


class Garbage:
    """Garbage along one direction, and distances from it and from the two sides that it may lie at."""

    def __init__(self, b: np.ndarray, sides: frozenset[str]):
        self.b, self.sides, self._far = b, sides, None

    def add(self, content: np.ndarray, box: Box) -> None:
        area = np.s_[box[1] : box[3], box[0] : box[2]]
        self.b = self.b.copy()
        self.b[area] |= content[area]
        self._far = None

    def far(self) -> np.ndarray:
        if self._far is None:
            self._far = np.sqrt(rasters.distance_map(self.b, True, self.sides).astype(float))
        return self._far


def parted_garbage(garbage: np.ndarray) -> tuple[Garbage, Garbage]:
    """(horizontal, vertical): long runs and what lies at the sides claim the garbage near them; what is connected to neither is both."""
    seeds = []
    for size, sides in (((200, 1), np.s_[[0, -1], :]), ((1, 200), np.s_[:, [0, -1]])):
        s = rasters.opened(garbage, *size)
        s[sides] |= garbage[sides]
        seeds.append(s)
    horizontal, vertical = seeds
    owner = np.where(horizontal, 2, np.where(vertical, 1, 0))
    claimed = rasters.fill_from(owner > 0, garbage)
    near = rasters.influence(owner)[0]
    return (
        Garbage(garbage & ((near == 2) & claimed | ~claimed), frozenset(("top", "bottom"))),
        Garbage(garbage & ((near == 1) & claimed | ~claimed), frozenset(("left", "right"))),
    )


def _area(box: Box) -> int:
    return max(0, box[2] - box[0]) * max(0, box[3] - box[1])


def goes(content: np.ndarray, blocks: np.ndarray, text: np.ndarray, removed: Box, rest: Box, garbage: Garbage, vertical: bool) -> tuple[bool, bool]:
    """(does `removed` go, else may it be tried again together with what follows). It goes if its blocks lie nearer to garbage than to the
    content of the rest, by distances weighed with a bias that grows with the text in it."""
    w, h = removed[2] - removed[0], removed[3] - removed[1]
    if _area(removed) > 0.3 * _area(rest) and w >= 6 and h >= 6:
        return False, False
    cut = np.s_[removed[1] : removed[3], removed[0] : removed[2]]
    letters = int(text[cut].sum())
    if not letters:
        bias = 0.4 if vertical else 0.5
    else:
        bias = 0.5 if vertical else 0.65
        total = int(content[cut].sum()) + int(garbage.b[cut].sum()) + 1
        influence = 1.0 if letters >= 5000 else 0.2 + 0.8 * np.log(letters) / np.log(5000)
        bias = min(max(bias + (1 - bias) * influence * letters / total, 0.0), 1.0)
    others = np.zeros_like(content)
    keep = np.s_[rest[1] : rest[3], rest[0] : rest[2]]
    others[keep] = content[keep] & blocks[keep]
    here = blocks[cut]
    to_garbage = garbage.far()[cut][here].sum()
    to_others = np.sqrt(rasters.distance_map(others, True, False)[cut][here].astype(float)).sum()
    return bool(bias * to_garbage < (1 - bias) * to_others), bias < 0.85


def trimmed(content: np.ndarray, blocks: np.ndarray, text: np.ndarray, box: Box, garbage: Garbage, side: str) -> Box:
    """The box without what goes at one side: its first run of columns (rows) with blocks, or the first runs together."""
    vertical = side in ("left", "right")
    counts = blocks[box[1] : box[3], box[0] : box[2]].sum(axis=0 if vertical else 1) > 0
    low, n = (box[0] if vertical else box[1]), len(counts)
    if side in ("right", "bottom"):
        counts = counts[::-1]
    at = 0
    while at < n:
        white = at + int(np.argmin(counts[at:])) if not counts[at:].all() else n
        next_ = white + int(np.argmax(counts[white:])) if counts[white:].any() else n
        if next_ >= n:
            return box
        part = {"left": ((low, low + white), (low + next_, low + n)), "right": ((low + n - white, low + n), (low, low + n - next_))}[side if vertical else {"top": "left", "bottom": "right"}[side]]
        removed, rest = ((p[0], box[1], p[1], box[3]) if vertical else (box[0], p[0], box[2], p[1]) for p in part)
        if not _area(removed):
            return rest
        gone, again = goes(content, blocks, text, removed, rest, garbage, vertical)
        if gone:
            garbage.add(content, removed)
            return rest
        if not again:
            return box
        at = next_
    return box


def content_blocks(content: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """What large white rectangles leave: wide ones, high ones, then any between the content of the blocks."""
    blocks, least = np.ones_like(clean), min(clean.shape)
    for value, count, axis in ((lambda w, h: w * w * h, WIDE_RECTANGLES, 1), (lambda w, h: w * h * h, HIGH_RECTANGLES, 0)):
        spaces = WhiteSpaces(clean, value)
        for _ in range(count):
            box = spaces.next()
            if box is None or _area(box) < least:
                break
            blocks[box[1] : box[3], box[0] : box[2]] = False
            fifth = (box[axis + 2] - box[axis]) // 5  # later ones may overlap its outer fifths
            inner = list(box)
            inner[axis] += fifth
            inner[axis + 2] -= fifth
            spaces.add_obstacle(tuple(inner))
    blocks = trimmed_blocks(clean, blocks)
    spaces = WhiteSpaces(content | ~blocks, least=(4, 4))
    for _ in range(MORE_RECTANGLES):
        box = spaces.next()
        if box is None or _area(box) < least:
            break
        blocks[box[1] : box[3], box[0] : box[2]] = False
        spaces.add_obstacle(box)
    return without_borders(trimmed_blocks(clean, blocks))


def content_box(g: np.ndarray, dpi: float = 150, level: str = "normal") -> Box | None:
    """left, top, right, bottom (exclusive) of the content, in pixels of the page; None if there is none."""
    small = at_dpi(g, dpi, 150)
    if min(small.shape) < 8:
        return None
    b = rasters.wolf(small, WINDOW, WINDOW, LEVEL)
    seeds = rasters.opened(b, *SHADOW[0], True) | rasters.opened(b, *SHADOW[1], True)
    shadows = genuine_shadows(rasters.fill_from(seeds, rasters.dilate(b, 3, 3)) & b) if seeds.any() else seeds
    content = b & ~shadows
    clean = rasters.despeckle(content, level, 150)
    blocks = content_blocks(content, clean)
    if not blocks.any():
        return None
    text = text_mask(content, blocks) & content
    y, x = np.nonzero(blocks)
    box: Box = (int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1)
    horizontal, vertical = parted_garbage(shadows)
    todo = {"left", "right", "top", "bottom"}
    while todo:
        for side in ("left", "right", "top", "bottom"):
            if side in todo:
                todo.discard(side)
                new = trimmed(content, blocks, text, box, vertical if side in ("left", "right") else horizontal, side)
                if new != box:
                    todo |= {side} | ({"top", "bottom"} if side in ("left", "right") else {"left", "right"})
                box = new
        w, h = box[2] - box[0], box[3] - box[1]
        if w < 8 or h < 8 or w < 30 and h > 20 * w:
            return None
    sy, sx = g.shape[0] / small.shape[0], g.shape[1] / small.shape[1]
    left, top = int(np.floor(box[0] * sx)), int(np.floor(box[1] * sy))
    return left, top, min(g.shape[1], int(np.ceil(box[2] * sx))), min(g.shape[0], int(np.ceil(box[3] * sy)))
