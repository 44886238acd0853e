"""Lines, plateau peaks and despeckling against plain definitions."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators import lines
from pagemill.operators import rasters as r

seeds = st.integers(0, 10_000)


@settings(max_examples=30, deadline=None)
@given(seeds, st.sampled_from([(3, 3), (5, 5)]))
def test_peaks_by_definition(seed, window):
    v = np.random.default_rng(seed).integers(-2, 3, (12, 15))
    got = r.peaks(v, *window)
    want = np.zeros(v.shape, bool)
    seen = np.zeros(v.shape, bool)
    ry, rx = window[1] // 2, window[0] // 2
    around = lambda y, x, ry, rx: [(j, i) for j in range(max(0, y - ry), min(12, y + ry + 1)) for i in range(max(0, x - rx), min(15, x + rx + 1))]
    top = np.array([[all(v[q] <= v[y, x] for q in around(y, x, ry, rx)) for x in range(15)] for y in range(12)])
    for y in range(12):
        for x in range(15):
            if top[y, x] and not seen[y, x]:
                plateau, todo = {(y, x)}, [(y, x)]
                while todo:
                    for q in around(*todo.pop(), 1, 1):
                        if top[q] and q not in plateau:
                            plateau.add(q)
                            todo.append(q)
                good = not any(not top[q] and v[q] == v[p] for p in plateau for q in around(*p, ry, rx))
                for p in plateau:
                    seen[p] = True
                    want[p] = good
    assert np.array_equal(got, want)


def test_distance_peaks_of_a_bar():
    b = np.zeros((11, 15), bool)
    b[2:9, 2:13] = True
    assert np.argwhere(r.distance_peaks(b)).tolist() == [[5, x] for x in range(5, 10)]


def test_hough_lines_of_drawn_lines():
    degrees = np.arange(-10, 11) * 0.5
    for angle, at in ((-3.0, 40), (0.0, 60), (4.5, 25)):
        y = np.arange(200)
        x = at + y * -np.tan(np.radians(angle))
        votes, bias = lines.hough(y, np.round(x), np.ones(200, int), (200, 120), 2.0, degrees)
        assert votes.sum() == 200 * len(degrees)
        best = lines.hough_lines(votes, bias, 2.0, degrees, 100)[0]
        assert abs(best.x_at(0) - x[0]) <= 2.5 and abs(best.x_at(199) - x[-1]) <= 2.5


def page(h=300, w=420, angle=0.0, at=210, dark=90):
    g = np.full((h, w), 230, np.uint8)
    for y in range(h):
        x = int(round(at + (y - h / 2) * np.tan(np.radians(angle))))
        g[y, x - 1 : x + 3] = dark
    return g


@pytest.mark.parametrize("angle", [-4.0, -2.0, 0.0, 1.0, 2.0, 5.0])
def test_tilted_folds_are_found(angle):
    found = lines.vertical_lines(page(angle=angle))
    assert len(found) == 1
    half = 150 * np.tan(np.radians(angle))
    assert abs(found[0][0] - (210 - half)) <= 6 and abs(found[0][1] - (210 + half)) <= 6


def test_lines_of_one_place_are_one_group():
    g = np.minimum(page(at=100), page(at=300, angle=3.0))
    assert len(lines.vertical_lines(g)) == 2 and len(lines.vertical_lines(g, 1)) == 1
    assert lines.grouped([(0, 2, 9.0), (5, 6, 8.0), (1, 5, 7.0), (8, 9, 1.0)]) == [(0, 2, 9.0), (8, 9, 1.0)]
    assert lines.vertical_lines(np.full((300, 420), 200, np.uint8)) == []


def test_gray_weights_grow_with_the_level():
    w = lines.gray_weights()
    assert w[:10].tolist() == [2, 2, 3, 3, 3, 4, 4, 4, 4, 4] and (np.diff(w) >= 0).all()


def test_two_lines_of_a_cloud():
    points = [(-100, -100), (0, 0), (100, 100), (200, 200), (0, 100), (100, 0), (-100, 200)]
    finder = lines.CloudLines(points)
    first, second = finder.next(), finder.next()
    assert sorted(first[1].tolist()) == [0, 1, 2, 3] and sorted(second[1].tolist()) == [4, 5, 6] and finder.next() is None
    for bad in ({"tolerance_degrees": 0}, {"most_distance": 0}, {"least_points": 1}):
        with pytest.raises(ValueError):
            lines.CloudLines(points, **bad)


@settings(max_examples=10, deadline=None)
@given(seeds)
def test_cloud_lines_pass_their_points(seed):
    rng = np.random.default_rng(seed)
    angle, t = rng.uniform(0, np.pi), rng.uniform(-80, 80, 12)
    on = np.column_stack([np.cos(angle) * t, np.sin(angle) * t]) + rng.uniform(-20, 20, 2)
    points = np.vstack([on, rng.uniform(-100, 100, (10, 2))])
    (u, v, d), support = lines.CloudLines(points, origin=(3, -4)).next()
    assert len(support) >= 12 and abs(u * u + v * v - 1) < 1e-9
    assert (np.abs(points[support] @ (u, v) - d) <= 2.5).all()


def found_lines(points, **how):
    finder = lines.CloudLines(points, tolerance_degrees=1.0, least_points=5, **how)
    return [(line[0], line[1].tolist()) for line in (finder.next(),) if line]


def test_cloud_lines_split_together_are_those_split_one_by_one():
    for seed in (1, 2):
        cloud = np.vstack([np.random.default_rng(seed).integers(0, 10, (12, 2)) * 4.0, [(k, 2 * k) for k in range(6)]])
        assert found_lines(cloud) == found_lines(cloud, ahead=7)


def test_cloud_lines_of_scattered_rasters_in_time():
    """Splitting one box at a time took 2.7 seconds for these clouds, 0.3 are enough."""
    began = time.process_time()
    for seed in (1, 2, 3):
        cloud = np.random.default_rng(seed).permutation(np.stack(np.divmod(np.arange(400), 16), axis=1))[:38] * 4.0
        assert len(lines.CloudLines(cloud, tolerance_degrees=1.0).next()[1]) == 6 + seed
    assert time.process_time() - began < 1.5


def test_specks_stay_near_what_they_belong_to():
    b = np.zeros((80, 80), bool)
    b[10:40, 10:40] = True
    b[20:23, 46:49] = True  # 9 pixels, 6 columns away: 36 <= 9 * 12 at the strictest level
    b[60:62, 60:62] = True  # far from all
    for level in r.DESPECKLE:
        kept = r.despeckle(b, level)
        assert kept[21, 47] and kept[30, 30] and not kept[60, 60]
    b[20:23, 46:49] = False
    b[20, 46] = True  # one pixel: 36 <= 42 or 100, but not 12
    assert [bool(r.despeckle(b, k)[20, 46]) for k in ("cautious", "normal", "aggressive")] == [True, True, False]


def test_specks_hang_on_others_but_not_on_much_smaller_ones():
    b = np.zeros((60, 120), bool)
    b[10:40, 5:35] = True
    b[20:23, 40:43] = True
    b[20:23, 48:51] = True
    assert r.despeckle(b, "aggressive")[21, 49]
    c = np.zeros((60, 120), bool)
    c[10:40, 5:35] = True
    c[20, 38] = True  # one pixel, kept by the big part
    c[15:26, 45:56] = True  # 121 pixels, 17 away from the big part, would hang on one pixel: less than its share
    far = r.despeckle(c, "aggressive")
    assert far[20, 38]
    assert r.despeckle(np.zeros((4, 4), bool)).sum() == 0
    dots = np.zeros((20, 20), bool)
    dots[5, 5] = dots[9, 9] = True
    assert r.despeckle(dots).sum() == 0  # nothing big at all


def test_vertical_distance_parts_areas_at_half():
    lab = np.zeros((30, 30), np.int64)
    lab[0, 0], lab[0, 20], lab[20, 0] = 1, 2, 3
    near = r.neighbours(lab, lab > 0)
    assert near[1, 2] == 19**2 and near[1, 3] == 19**2
