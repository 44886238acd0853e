"""Lines in rasters and point clouds: weighted Hough votes with plateau peaks, groups of vertical lines, and lines
under bounded error by subdivision of the parameter space (Breuel, Pattern Recognition 29, 1996)."""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass

import numpy as np

from pagemill.operators import rasters

#: Fixed values of the search for folding lines at 100 dpi: thickness of a line, the greatest angle and its steps in degrees,
#: the margin in mm, the window of the vertical structure, the least length, and the quality a pixel of height must give.
THICKNESS, MOST_ANGLE, ANGLE_STEP, MARGIN_MM, STRUCTURE, LEAST_RUN, QUALITY = 5.0, 7.0, 0.25, 3.5, 11, 19, 1.8


@dataclass(frozen=True)
class Line:
    """Points p with p . (u, v) = distance. quality: its votes."""

    u: float
    v: float
    distance: float
    quality: float

    def x_at(self, y: float) -> float:
        return (self.distance - self.v * y) / self.u


def hough(y: np.ndarray, x: np.ndarray, weight: np.ndarray, shape: tuple[int, int], resolution: float, degrees: np.ndarray) -> tuple[np.ndarray, float]:
    """(votes by angle and bin, bias). The bin of a distance is floor((distance + bias) / resolution + 0.5)."""
    a = np.radians(degrees)
    u, v = np.cos(a), np.sin(a)
    h, w = shape
    corners = np.stack([u * (w - 1) + v * (h - 1), u * (w - 1), v * (h - 1), np.zeros_like(u)])
    bias = -float(corners.min())
    width = int((float(corners.max()) + bias) / resolution + 0.5) + 1
    votes = np.zeros((len(a), width), np.int64)
    for k in range(len(a)):
        bins = ((u[k] * x + v[k] * y + bias) / resolution + 0.5).astype(np.int64)
        votes[k] = np.bincount(bins, weight, width).astype(np.int64)
    return votes, bias


def hough_lines(votes: np.ndarray, bias: float, resolution: float, degrees: np.ndarray, least: float) -> list[Line]:
    """The peaks of the votes that have `least` or more, best first: each plateau of equal bins without an equal or greater one
    in the 5 x 5 bins around them gives the line at the middle of its box."""
    lab = rasters.labels(rasters.peaks(votes, 5, 5) & (votes >= least))
    out = []
    for k, x0, y0, x1, y1, _ in rasters.component_boxes(lab).tolist():
        a = np.radians(degrees[(y0 + y1) // 2])
        out.append(Line(float(np.cos(a)), float(np.sin(a)), ((x0 + x1) // 2 + 0.5) * resolution - bias, float(votes[lab == k][0])))
    return sorted(out, key=lambda line: -line.quality)


def gray_weights() -> np.ndarray:
    """The vote of each level: from 2 on, one more for each segment of levels; a segment is as long as the two before."""
    out, level, weight, length, before = np.zeros(256, np.int64), 0, 2, 2, 1
    while level < 256:
        out[level : level + length] = weight
        level, weight = level + length, weight + 1
        length += before
        before = length
    return out


def grouped(found: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """found: (left, right, quality) of lines, best first. The best of each group of lines that overlap, in order of the groups."""
    groups: list[list] = []  # left, right, leader
    for line in found:
        left, right, quality = line
        home = None
        for g in list(groups):
            if g[0] > right or g[1] < left:
                continue
            if home is None:
                home = g
                g[0], g[1] = min(g[0], left), max(g[1], right)
                if quality > g[2][2]:
                    g[2] = line
            else:
                home[0], home[1] = min(home[0], g[0]), max(home[1], g[1])
                if g[2][2] > home[2][2]:
                    home[2] = g[2]
                groups.remove(g)
        if home is None:
            groups.append([left, right, line])
    return [g[2] for g in groups]


def vertical_lines(g: np.ndarray, most: int = 8, dpi: float = 100.0) -> list[tuple[float, float]]:
    """(x at the top, x at the bottom) of up to `most` dark vertical lines of a page at 100 dpi, the best of each group.

    Vertical structure is what a horizontal erosion of darkness lifts and a vertical one doesn't; short pieces go; the rest votes
    by its level.
    """
    h, w = g.shape
    if not h or not w:
        return []
    lifted = rasters.erode_gray(g, STRUCTURE, 1).astype(np.int64) - rasters.erode_gray(g, 1, STRUCTURE)
    level = rasters.close_gray(np.maximum(lifted, 0).astype(np.uint8), 1, LEAST_RUN, 0)
    margin = int(np.floor(0.5 + MARGIN_MM / 25.4 * dpi))
    area = level[:, margin : max(margin, w - margin)]
    y, x = np.nonzero(area > 1)
    if not len(y):
        return []
    steps = int(MOST_ANGLE / ANGLE_STEP)
    degrees = np.arange(-steps, steps + 1) * ANGLE_STEP
    votes, bias = hough(y, x + margin, gray_weights()[area[y, x]], g.shape, THICKNESS, degrees)
    found, ends = [], {}
    for line in hough_lines(votes, bias, THICKNESS, degrees, int(h * THICKNESS * QUALITY) + 1):
        a, b = line.x_at(0.0), line.x_at(float(h))
        key = (min(a, b), max(a, b), line.quality)
        ends.setdefault(key, (a, b))
        found.append(key)
    return [ends[k] for k in grouped(found)[:most]]


class CloudLines:
    """Lines in a point cloud, the one with the most support first; its points then support no other line.

    A box of the parameter space (distances from the origin, angles of the normal in radians) holds the points that a line of it may
    pass near. The box with the most points is split by distance or by angle, whichever leaves fewer points in both halves, until
    it is no wider than the error bounds. Of boxes with as many points the oldest goes first, and no half holds more than its box: so the boxes
    that come next are known, and `ahead` of them are split at a time, with what splitting them one by one would give.
    """

    def __init__(self, points, origin=(0.0, 0.0), least_degrees: float = 0.0, most_degrees: float = 180.0, tolerance_degrees: float = 0.1, most_distance: float = 1.0, least_points: int = 3, ahead: int = 512):
        if not 0 < tolerance_degrees < 180 or most_distance <= 0 or least_points < 2:
            raise ValueError("the tolerance lies between 0 and 180 degrees, distances are positive, lines have two points or more")
        self.origin = np.asarray(origin, float)
        self.p = np.asarray(points, float).reshape(-1, 2) - self.origin
        self.r2 = (self.p**2).sum(1)
        self.free = np.ones(len(self.p), bool)
        self.tolerance, self.near, self.least, self.ahead = np.radians(tolerance_degrees), most_distance, least_points, ahead
        reach = float(np.sqrt(self.r2.max(initial=0))) + 1.0
        low = np.radians(np.fmod(least_degrees, 360.0))
        span = np.radians((most_degrees - least_degrees) % 360.0)
        box = np.array([[-reach, reach, low, low + span]])
        self._begin(box, self._inside(box, self._turned(box[:, 2]), self._turned(box[:, 3])))

    def _turned(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each angle and point: its distance along the normal, and how far ahead of the normal it lies."""
        u, v, x, y = np.cos(a)[:, None], np.sin(a)[:, None], self.p[:, 0], self.p[:, 1]
        return x * u + y * v, y * u - x * v

    def _inside(self, box: np.ndarray, first: tuple[np.ndarray, np.ndarray], last: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """box: rows of d0, d1, a0, a1; first and last: the points turned to a0 and a1. Those with a distance between d0 and d1 at one of the ends, or
        passing from one side to the other between them, or whose own angle lies between."""
        d0, d1, (at0, ahead0), (at1, ahead1) = box[:, :1], box[:, 1:2], first, last
        round_ = (ahead0 >= 0) & (ahead1 <= 0) & (self.r2 >= d0 * d0) & (self.r2 <= d1 * d1)
        return ((at0 >= d0) & (at1 <= d1)) | ((at1 >= d0) & (at0 <= d1)) | round_

    def _begin(self, box: np.ndarray, held: np.ndarray) -> None:
        """These boxes, in this order, are what is left to split."""
        keep = held.sum(axis=1) >= self.least
        self.box, self.held, self.count = box[keep], held[keep], int(keep.sum())
        self.heap: list[tuple[int, int]] = []
        self.waiting: dict[int, deque[int]] = {}  # by number of points, in order of age
        for row, n in enumerate(self.held.sum(axis=1).tolist()):
            self._keep(row, n)

    def _keep(self, row: int, n: int) -> None:
        heapq.heappush(self.heap, (-n, row))
        self.waiting.setdefault(n, deque()).append(row)

    def _store(self, box: np.ndarray, held: np.ndarray) -> int:
        """The row of the first of these boxes."""
        first, self.count = self.count, self.count + len(box)
        if self.count > len(self.box):
            self.box, self.held = (np.concatenate([x[:first], np.zeros((self.count, x.shape[1]), x.dtype)]) for x in (self.box, self.held))
        self.box[first : self.count], self.held[first : self.count] = box, held
        return first

    def _split(self, rows: list[int]) -> list[list[tuple[int, int]] | None]:
        """For each box the rows of its halves with enough points, and how many; None for a box within the error bounds."""
        held, (d0, d1, a0, a1) = self.held[rows], self.box[rows].T
        wide, open_ = d1 - d0 > 2.0001 * self.near, a1 - a0 > 2 * self.tolerance
        half = np.where(d1 - d0 > 3 * self.tolerance, self.near, 2 * self.near - (d1 - d0) / 2)
        middle, angle = (d0 + d1) / 2, (a0 + a1) / 2
        first, between, last = self._turned(a0), self._turned(angle), self._turned(a1)
        halves = []
        for sides, ends in (((d0, middle + half, a0, a1), (first, last)), ((middle - half, d1, a0, a1), (first, last)), ((d0, d1, a0, angle), (first, between)), ((d0, d1, angle, a1), (between, last))):
            box = np.stack(sides, axis=1)
            halves.append((box, held & self._inside(box, *ends)))
        box, held = (np.stack(x, axis=1) for x in zip(*halves, strict=True))
        n = held.sum(axis=2)
        by_distance, by_angle = np.where(wide, n[:, 0] + n[:, 1], np.inf), np.where(open_, n[:, 2] + n[:, 3], np.inf)
        pick = np.where(by_distance < by_angle, 0, 2)
        used = np.zeros(n.shape, bool)
        used[np.arange(len(rows)), pick] = used[np.arange(len(rows)), pick + 1] = wide | open_
        used &= n >= self.least
        row = self._store(box[used], held[used])
        out: list = [[] if x else None for x in (wide | open_).tolist()]
        for k, (i, size) in enumerate(zip(np.nonzero(used)[0].tolist(), n[used].tolist(), strict=True)):
            out[i].append((row + k, size))
        return out

    def next(self) -> tuple[tuple[float, float, float], np.ndarray] | None:
        """((u, v, distance) of the line p . (u, v) = distance, the numbers of its points), or None when no line is left."""
        left = [row for _, row in self.heap]
        self._begin(self.box[left], self.held[left] & self.free)
        while self.heap:
            n = -self.heap[0][0]
            queue = self.waiting[n]
            rows = [queue.popleft() for _ in range(min(self.ahead, len(queue)))]
            for row, halves in zip(rows, self._split(rows), strict=True):
                heapq.heappop(self.heap)  # this row
                if halves is None:
                    d0, d1, a0, a1 = self.box[row].tolist()
                    of = np.flatnonzero(self.held[row])
                    self.free[of] = False
                    a = (a0 + a1) / 2
                    u, v = float(np.cos(a)), float(np.sin(a))
                    return (u, v, (d0 + d1) / 2 + u * self.origin[0] + v * self.origin[1]), of
                for half in halves:
                    self._keep(*half)
        return None
