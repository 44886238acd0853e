"""Array kernels against plain definitions of what they compute."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators import rasters as r


def image(seed, h=13, w=17, p=0.4):
    return np.random.default_rng(seed).random((h, w)) < p


def gray(seed, h=13, w=17):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)


seeds = st.integers(0, 10_000)


@settings(max_examples=20, deadline=None)
@given(seeds, st.integers(1, 5), st.integers(1, 5))
def test_dilate_and_erode_by_definition(seed, w, h):
    b = image(seed)
    want = np.zeros_like(b)
    for dy in range(-(h // 2), h - h // 2):
        for dx in range(-(w // 2), w - w // 2):
            want |= r.shifted(b, dy, dx, False)
    assert np.array_equal(r.dilate(b, w, h), want)
    assert np.array_equal(r.erode(b, w, h), ~r.dilate(~b, w, h, False))


@settings(max_examples=20, deadline=None)
@given(seeds)
def test_distance_map_by_definition(seed):
    b = image(seed, p=0.7)
    white = np.argwhere(~np.pad(b, 1))
    want = np.array([[((white - (y + 1, x + 1)) ** 2).sum(1).min() for x in range(b.shape[1])] for y in range(b.shape[0])])
    assert np.array_equal(r.distance_map(b), want)


@settings(max_examples=20, deadline=None)
@given(seeds)
def test_nearest_names_a_nearest_seed(seed):
    b = image(seed, p=0.1)
    dist, source = r.nearest(b)
    for y in range(b.shape[0]):
        for x in range(b.shape[1]):
            if b.any():
                sy, sx = divmod(int(source[y, x]), b.shape[1])
                assert b[sy, sx] and (sy - y) ** 2 + (sx - x) ** 2 == dist[y, x]
            else:
                assert source[y, x] == -1


@pytest.mark.parametrize("around", [r.FOUR, r.EIGHT])
@settings(max_examples=20, deadline=None)
@given(seed=seeds)
def test_labels_are_components(around, seed):
    b = image(seed)
    lab = r.labels(b, around)
    assert np.array_equal(lab > 0, b)
    want = np.where(b, np.arange(1, b.size + 1).reshape(b.shape), 0)
    while True:
        new = want
        for dy, dx in around:
            near = r.shifted(want, dy, dx, 0)
            new = np.where(b & (near > 0), np.minimum(np.where(new > 0, new, r.BIG), np.where(near > 0, near, r.BIG)), new)
        if np.array_equal(new, want):
            break
        want = new
    assert len({*zip(lab[b].tolist(), want[b].tolist(), strict=True)}) == len(set(want[b].tolist())) == lab.max(initial=0)


@settings(max_examples=15, deadline=None)
@given(seeds)
def test_gray_fill_fast_and_slow(seed):
    mask = gray(seed)
    seed_ = np.maximum(mask, gray(seed + 1))
    for around in (r.FOUR, r.EIGHT):
        assert np.array_equal(r.fill_gray(seed_, mask, around), r.fill_gray_slow(seed_, mask, around))


@settings(max_examples=15, deadline=None)
@given(seeds)
def test_binary_fill_is_gray_fill(seed):
    mask = image(seed)
    start = mask & image(seed + 1, p=0.1)
    want = r.fill_gray(np.where(start, 0, 255).astype(np.uint8), np.where(mask, 0, 255).astype(np.uint8)) == 0
    assert np.array_equal(r.fill_from(start, mask), want)


def test_reduction_doubles_single_lines():
    assert r.reduce(np.array([[1, 0, 1, 1]], bool), 4).tolist() == [[False, True]]
    assert r.reduce(np.array([[1, 1, 1], [0, 1, 1], [1, 1, 1]], bool), 3).tolist() == [[True]]


def test_rotation_of_text_is_found():
    b = np.zeros((400, 400), bool)
    b[60:340:12] = b[61:341:12] = b[62:342:12] = True
    b[:, :40] = b[:, 360:] = False
    turned = r.shear_columns(b, np.tan(np.radians(-4.5)))
    for halved in ((2, 1), (1, 1), (0, 0)):
        angle, confidence = r.find_skew(turned, coarse=halved[0], fine=halved[1])
        assert abs(abs(angle) - 4.5) <= 0.15 and confidence >= 2
    assert r.find_skew(image(1, 200, 200), coarse=0, fine=0)[1] < 2
    blank = r.find_skew(np.zeros((40, 40), bool))
    assert blank[1] == 0.0


def test_scale_keeps_levels():
    flat = np.full((10, 10), 77, np.uint8)
    for h, w in ((5, 5), (7, 3), (20, 23)):
        assert (r.scale_gray(flat, h, w) == 77).all()


def test_polynomial_surface_fits_a_plane():
    y, x = np.mgrid[0:20, 0:30]
    g = (2 * y + 3 * x).astype(np.uint8)
    assert np.abs(r.polynomial_surface(g, 2, 2).astype(int) - g).max() <= 1
    assert (r.smooth_local(g, 5, 5, 2, 2)[3:-3, 3:-3] == g[3:-3, 3:-3]).all()


def test_otsu():
    assert r.otsu(np.full((4, 4), 9, np.uint8)) == 0
    assert 10 < r.otsu(np.array([[10, 10, 200, 200]], np.uint8)) <= 200


def test_white_rectangle():
    b = np.ones((20, 30), bool)
    b[5:15, 4:20] = False
    assert r.largest_white(b, 1) == [(4, 5, 16, 10)]


def test_polygon_rules():
    square = [(1, 1), (9, 1), (9, 9), (1, 9)]
    assert r.fill_polygon((10, 10), square).sum() == 64
    twice = square + square
    assert r.fill_polygon((10, 10), twice).sum() == 0
    assert r.fill_polygon((10, 10), twice, winding=True).sum() == 64


def test_despeckle_keeps_big_and_attached_parts():
    b = np.zeros((60, 60), bool)
    b[10:30, 10:30] = True
    b[10, 32] = True  # next to the large part
    b[50, 50] = True
    kept = r.despeckle(b, "normal")
    assert kept[20, 20] and kept[10, 32] and not kept[50, 50]


def test_hull():
    assert sorted(r.hull([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)])) == [(0, 0), (0, 4), (4, 0), (4, 4)]


def test_hit_miss_replace_removes_lone_pixels():
    b = np.zeros((5, 5), bool)
    b[0, 0] = b[2, 2] = b[2, 3] = True
    assert np.argwhere(r.hit_miss_replace(b, ["   ", " - ", "   "])).tolist() == [[2, 2], [2, 3]]
