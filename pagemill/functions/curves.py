"""Splines, arc lengths, projective maps and the dewarping of cylindrical pages.

X-splines are those of Blanc and Schlick (SIGGRAPH 1995): each control point has a tension from -1
(interpolating) over 0 (sharp) to 1 (smooth).
"""

from __future__ import annotations

import numpy as np


def _f(u: np.ndarray, p: float) -> np.ndarray:
    """Positive-shape blending: from 0 at 0 to 1 at 1."""
    return u**3 * (10 - p + (2 * p - 15) * u + (6 - p) * u * u)


def xspline(points, tensions, per_segment: int = 16) -> np.ndarray:
    """Points of the open spline through or near the control points, ends included."""
    p = np.asarray(points, float)
    s = np.asarray(tensions, float)
    n = len(p)
    if n == 1:
        return p.copy()
    out = []
    for k in range(n - 1):
        idx = np.clip([k - 1, k, k + 1, k + 2], 0, n - 1)
        t = np.linspace(0, 1, per_segment, endpoint=k == n - 2)
        sk, sk1 = s[k], s[k + 1]
        a = [np.zeros_like(t) for _ in range(4)]
        # influence of the point before and after, by the tension at the ends of the segment
        r1, r2 = max(sk, 0.0), max(sk1, 0.0)
        a[0] = np.where(t < r1, _f(np.clip((r1 - t) / (1 + r1), 0, 1), 2 * (1 + r1) ** 2), 0)
        a[1] = _f(np.clip((1 + r2 - t) / (1 + r2), 0, 1), 2 * (1 + r2) ** 2)
        a[2] = _f(np.clip((t + r1) / (1 + r1), 0, 1), 2 * (1 + r1) ** 2)
        a[3] = np.where(t > 1 - r2, _f(np.clip((t - 1 + r2) / (1 + r2), 0, 1), 2 * (1 + r2) ** 2), 0)
        if sk < 0 or sk1 < 0:  # interpolate: a cubic with end slopes scaled by the tensions
            q1, q2 = max(-sk, 0.0), max(-sk1, 0.0)
            m1, m2 = q1 * (p[idx[2]] - p[idx[0]]) / 2, q2 * (p[idx[3]] - p[idx[1]]) / 2
            c = t[:, None]
            out.append((2 * c**3 - 3 * c**2 + 1) * p[k] + (c**3 - 2 * c**2 + c) * m1 + (3 * c**2 - 2 * c**3) * p[k + 1] + (c**3 - c**2) * m2)
            continue
        total = sum(a)
        out.append(sum(w[:, None] * p[i] for w, i in zip(a, idx, strict=True)) / total[:, None])
    return np.concatenate(out)


def xspline_weights(tensions, per_segment: int = 16) -> np.ndarray:
    """(points, control points): how much each control point counts in each point of xspline(), which is linear in them."""
    n = len(tensions)
    unit = np.eye(n)
    return np.column_stack([xspline(np.column_stack([unit[:, k], unit[:, k]]), tensions, per_segment)[:, 0] for k in range(n)])


def fit_xspline(points, controls, tensions, fixed=(), rounds: int = 20, per_segment: int = 16, stiffness: float = 1e-3) -> np.ndarray:
    """Control points of the spline that passes nearest to `points`, by least squares in rounds: each point is taken to its nearest place on the spline, and
    the control points are solved for under the constraint that those in `fixed` stay. stiffness weighs a little against uneven steps of the rest."""
    points, c = np.asarray(points, float), np.asarray(controls, float).copy()
    weights = xspline_weights(tensions, per_segment)
    free = [k for k in range(len(c)) if k not in set(fixed)]
    bend = np.diff(np.eye(len(c)), 2, axis=0) * stiffness * len(points)
    for _ in range(rounds):
        line = weights @ c
        t = np.array([place_on_polyline(line, p) for p in points])
        k = np.minimum(t.astype(int), len(line) - 2)
        rows = weights[k] * (1 - (t - k))[:, None] + weights[k + 1] * (t - k)[:, None]
        left, right = np.vstack([rows, bend]), np.vstack([points, np.zeros((len(bend), 2))])
        right = right - left[:, list(fixed)] @ c[list(fixed)] if len(fixed) else right
        new = c.copy()
        new[free] = np.linalg.lstsq(left[:, free], right, rcond=None)[0]
        done, c = np.abs(new - c).max() < 1e-6, new
        if done:
            break
    return c


def place_on_polyline(line, to) -> float:
    """The nearest place, as a number of points and a share of the step from there."""
    line, to = np.asarray(line, float), np.asarray(to, float)
    a, d = line[:-1], np.diff(line, axis=0)
    t = np.clip(((to - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    k = int(np.argmin(((a + t[:, None] * d - to) ** 2).sum(1)))
    return k + float(t[k])


def xspline_directions(points, tensions, per_segment: int = 16) -> np.ndarray:
    """Unit tangents at the points of xspline(), by central differences."""
    line = xspline(points, tensions, per_segment)
    d = np.gradient(line, axis=0)
    return d / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-300)[:, None]


def nearest_on_polyline(line, to) -> tuple[np.ndarray, float]:
    """(nearest point, squared distance)."""
    line, to = np.asarray(line, float), np.asarray(to, float)
    a, d = line[:-1], np.diff(line, axis=0)
    t = np.clip(((to - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    q = a + t[:, None] * d
    dist = ((q - to) ** 2).sum(1)
    k = int(np.argmin(dist))
    return q[k], float(dist[k])


def arc_lengths(line) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(np.asarray(line, float), axis=0).T))])


def at_arc_length(line, lengths) -> np.ndarray:
    """Points at shares (0 to 1) of the length."""
    line, s = np.asarray(line, float), arc_lengths(line)
    t = np.asarray(lengths, float) * s[-1]
    return np.stack([np.interp(t, s, line[:, 0]), np.interp(t, s, line[:, 1])], axis=1)


def line_meets_polyline(line, p, q) -> np.ndarray | None:
    """The first point of the polyline on the infinite line through p and q."""
    line, p, q = (np.asarray(x, float) for x in (line, p, q))
    normal = np.array([-(q - p)[1], (q - p)[0]])
    side = (line - p) @ normal
    for k in range(len(line) - 1):
        if side[k] == 0 or side[k] * side[k + 1] <= 0:
            t = 0.0 if side[k] == side[k + 1] else side[k] / (side[k] - side[k + 1])
            return line[k] + t * (line[k + 1] - line[k])
    return None


def project_scalar(p, a, b) -> float:
    """Position of p's projection on the line from a (0) to b (1)."""
    a, d = np.asarray(a, float), np.asarray(b, float) - a
    return float((np.asarray(p, float) - a) @ d / (d @ d))


def project_scalars(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """project_scalar() of many points, each on a line of its own."""
    d = b - a
    return ((p - a) * d).sum(axis=1) / (d * d).sum(axis=1)


def homography(src, dst) -> np.ndarray:
    """The 3 x 3 projective map of four points to four."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def mapped(m: np.ndarray, points) -> np.ndarray:
    p = np.column_stack([np.asarray(points, float), np.ones(len(points))]) @ m.T
    return p[:, :2] / p[:, 2:]


def line_maps(pairs: np.ndarray) -> np.ndarray:
    """The projective maps of a line that take three numbers to three: pairs is (n, 3, 2), the result (n, 3) of a, b, c in (a t + b) / (c t + 1)."""
    t, u = pairs[..., 0], pairs[..., 1]
    return np.linalg.solve(np.stack([t, np.ones_like(t), -t * u], axis=-1), u[..., None])[..., 0]


class Cylinder:
    """A page bent around a vertical axis, between a top and a bottom curve (polylines from left to right).

    The four ends of the curves make a plane, in which generatrices are upright. How far a curve leaves the straight line between its ends
    tells how high the page rises there, `depth` times as much as the picture shows (MOST_RISE at most); unit x is the arc length of that profile.
    Along a generatrix, unit y is projective: 0 on the top curve, 1 on the bottom one, and on the line that stays straight as in the plane.
    """

    #: The greatest elevation, how near to a curve the straight line tells nothing, and the least weight of a place for it.
    MOST_RISE, CLOSE, LEAST_WEIGHT = 0.5, 0.05, 0.01

    def __init__(self, top, bottom, depth: float = 2.0):
        self.top, self.bottom, self.depth = np.asarray(top, float), np.asarray(bottom, float), depth
        self.image = homography([(0, 0), (1, 0), (0, 1), (1, 1)], [self.top[0], self.top[-1], self.bottom[0], self.bottom[-1]])
        self.plane = np.linalg.inv(self.image)
        self.curves = [self._forward(mapped(self.plane, c)) for c in (self.top, self.bottom)]
        x = np.unique(np.concatenate([c[:, 0] for c in self.curves]))
        on1, on2, line1, line2 = self._at(x)
        low, high = project_scalars(line1, on1, on2), project_scalars(line2, on1, on2)
        rise = np.clip(self.depth * (1 - (high - low)), -self.MOST_RISE, self.MOST_RISE)
        arc = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(rise)))])
        self.length = float(arc[-1])
        self.x, self.arc = x, arc / arc[-1]
        weight = np.abs(low + 1 - high)
        use = weight >= self.LEAST_WEIGHT
        self.straight = 0.5
        if use.any():
            at = ((high * low + low * (1 - high)) / np.where(use, low + 1 - high, 1))[use, None]
            y = mapped(self.plane, on1[use] + at * (on2[use] - on1[use]))[:, 1]
            self.straight = float((y * weight[use]).sum() / weight[use].sum())

    @staticmethod
    def _forward(points: np.ndarray) -> np.ndarray:
        """Without points that go back to the left."""
        reach = np.maximum.accumulate(points[:, 0])
        return points[np.concatenate([[True], points[1:, 0] > reach[:-1]])]

    def _at(self, x: np.ndarray):
        """For plane x: the points on the curves, and those of the plane's upper and lower edge, in the image."""
        y1, y2 = (np.interp(x, c[:, 0], c[:, 1]) for c in self.curves)
        return tuple(mapped(self.image, np.column_stack([x, y])) for y in (y1, y2, np.zeros_like(x), np.ones_like(x)))

    def _generatrices(self, x: np.ndarray):
        """(upper points, lower points, pairs of unit y and place between them)."""
        on1, on2, line1, line2 = self._at(x)
        p1, p2 = project_scalars(on1, line1, line2), project_scalars(on2, line1, line2)
        if min(abs(self.straight), abs(self.straight - 1)) < self.CLOSE:
            third, at = np.full_like(x, 0.5), (p1 + p2) / 2
        else:
            third, at = np.full_like(x, self.straight), project_scalars(mapped(self.image, np.column_stack([x, np.full_like(x, self.straight)])), line1, line2)
        return line1, line2, np.stack([np.stack([np.zeros_like(x), p1], 1), np.stack([np.ones_like(x), p2], 1), np.stack([third, at], 1)], 1)

    def plane_x(self, unit_x: np.ndarray) -> np.ndarray:
        """Beyond the ends the page goes on flat."""
        return np.interp(unit_x, self.arc, self.x) + np.minimum(unit_x, 0) + np.maximum(unit_x - 1, 0)

    def to_warped(self, unit) -> np.ndarray:
        unit = np.asarray(unit, float)
        line1, line2, pairs = self._generatrices(self.plane_x(unit[:, 0]))
        m = line_maps(pairs)
        t = (m[:, 0] * unit[:, 1] + m[:, 1]) / (m[:, 2] * unit[:, 1] + 1)
        return line1 + t[:, None] * (line2 - line1)

    def to_unit(self, points) -> np.ndarray:
        points = np.asarray(points, float)
        x = mapped(self.plane, points)[:, 0]
        line1, line2, pairs = self._generatrices(x)
        m = line_maps(pairs[..., ::-1])
        t = project_scalars(points, line1, line2)
        unit_x = np.interp(x, self.x, self.arc) + np.minimum(x - self.x[0], 0) + np.maximum(x - self.x[-1], 0)
        return np.column_stack([unit_x, (m[:, 0] * t + m[:, 1]) / (m[:, 2] * t + 1)])


def dewarp(g: np.ndarray, model: Cylinder, h: int, w: int, outside: int = 255, samples: int = 2, across: tuple[float, float] = (0.0, 1.0), down: tuple[float, float] = (0.0, 1.0)) -> np.ndarray:
    """The bent area as an upright rectangle, or what lies between other unit coordinates; each pixel is the mean of samples x samples points."""
    total = np.zeros(h * w)
    # a generatrix is found once for each column, not for each pixel
    for i in range(samples):
        x = model.plane_x(across[0] + (across[1] - across[0]) * (np.arange(w) + (i + 0.5) / samples) / w)
        line1, line2, pairs = model._generatrices(x)
        m = line_maps(pairs)
        for j in range(samples):
            y = (down[0] + (down[1] - down[0]) * (np.arange(h) + (j + 0.5) / samples) / h)[:, None]
            t = (m[:, 0] * y + m[:, 1]) / (m[:, 2] * y + 1)
            u, v = (np.floor(line1[:, k] + t * (line2 - line1)[:, k]).astype(int) for k in (0, 1))
            inside = (u >= 0) & (v >= 0) & (u < g.shape[1]) & (v < g.shape[0])
            total += np.where(inside, g[np.clip(v, 0, g.shape[0] - 1), np.clip(u, 0, g.shape[1] - 1)], outside).ravel()
    return np.floor(total / samples**2 + 0.5).reshape(h, w).astype(np.uint8)


def valid_model(top, bottom) -> bool:
    """Two curves of two points or more, from left to right, the top one above."""
    top, bottom = np.asarray(top, float), np.asarray(bottom, float)
    if len(top) < 2 or len(bottom) < 2 or top[0, 0] >= top[-1, 0] or bottom[0, 0] >= bottom[-1, 0]:
        return False
    return bool((at_arc_length(top, [0, 0.5, 1])[:, 1] < at_arc_length(bottom, [0, 0.5, 1])[:, 1]).all())
