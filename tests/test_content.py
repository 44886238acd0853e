"""Page cuts and content boxes of drawn pages."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators import content, pagework, rasters, split


def letters(g, left, top, right, bottom, seed=3):
    """Lines of letter-like blobs."""
    rng = np.random.default_rng(seed)
    for y in range(top, bottom - 13, 26):
        x = left
        while x < right - 12:
            w = int(rng.integers(6, 11))
            g[y : y + 14, x : x + w] = 30
            g[y + 4 : y + 10, x + 2 : x + w - 2] = 225  # a hole, as letters have
            x += w + int(rng.integers(3, 6))
    return g


def page(h=700, w=500):
    return letters(np.full((h, w), 225, np.uint8), 90, 110, 410, 590)


def near(box, want, by):
    return box is not None and max(abs(a - b) for a, b in zip(box, want, strict=True)) <= by


def test_content_box_of_text():
    assert near(content.content_box(page()), (90, 110, 410, 590), 30)


def test_shadows_at_the_sides_are_no_content():
    g = page()
    g[:, :25] = 20
    g[-18:, :] = 20
    assert near(content.content_box(g), (90, 110, 410, 590), 30)


def test_specks_are_no_content():
    g = page()
    g[30, 30] = g[680, 470] = g[60, 250] = 0
    assert near(content.content_box(g), (90, 110, 410, 590), 30)


def test_no_content():
    assert content.content_box(np.full((400, 300), 220, np.uint8)) is None
    assert content.content_box(np.full((5, 5), 220, np.uint8)) is None


def test_content_box_scales_with_the_resolution():
    twice = np.repeat(np.repeat(page(), 2, 0), 2, 1)
    assert near(content.content_box(twice, 300), (180, 220, 820, 1180), 60)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_largest_white_rectangle_by_definition(seed):
    b = np.random.default_rng(seed).random((9, 11)) < 0.25
    found = content.WhiteSpaces(b).next(100_000)
    best = max(((y1 - y0) * (x1 - x0) for y0 in range(9) for y1 in range(y0 + 1, 10) for x0 in range(11) for x1 in range(x0 + 1, 12) if not b[y0:y1, x0:x1].any()), default=0)
    assert (0 if found is None else (found[2] - found[0]) * (found[3] - found[1])) == best
    if found:
        assert not b[found[1] : found[3], found[0] : found[2]].any()


def test_white_rectangles_keep_off_obstacles():
    spaces = content.WhiteSpaces(np.zeros((10, 20), bool))
    first = spaces.next()
    assert first == (0, 0, 20, 10)
    spaces = content.WhiteSpaces(np.zeros((10, 20), bool))
    spaces.add_obstacle((5, 0, 6, 10))
    assert spaces.next() == (6, 0, 20, 10)
    spaces.add_obstacle((6, 0, 20, 10))
    assert spaces.next() == (0, 0, 5, 10) and spaces.next() is None


def test_text_lines_of_a_histogram():
    rows = np.array([0] * 3 + [20] * 10 + [1] + [22] * 10 + [0] * 5 + [9] * 4)
    found = sorted(content.line_ranges(rows))
    assert any(a <= 3 and z <= 14 for a, z in found) and any(a >= 14 for a, z in found)


def test_blocks_shrink_to_their_content():
    blocks, ink = np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    blocks[2:10, 2:10] = blocks[12:18, 12:18] = True
    ink[4, 5] = ink[6, 7] = True
    out = content.trimmed_blocks(ink, blocks)
    y, x = np.nonzero(out)
    assert (y.min(), y.max(), x.min(), x.max(), out.sum()) == (4, 6, 5, 7, 9)


def test_blocks_at_the_sides_go_so_far():
    blocks = np.zeros((40, 40), bool)
    blocks[0:30, 18:22] = True
    out = content.without_borders(blocks)
    assert not out[:10].any() and out[10:30, 18:22].all()


def two(angle, h=400, w=600, at=300):
    g = np.full((h, w), 225, np.uint8)
    letters(g, 40, 60, 240, 340)
    letters(g, 350, 60, 560, 340, 5)
    for y in range(h):
        x = int(round(at + (y - h / 2) * np.tan(np.radians(angle))))
        g[y, x - 2 : x + 3] = 90
    return g


@pytest.mark.parametrize("angle", [-3.0, 0.0, 2.0])
def test_tilted_folds_cut_two_pages(angle):
    cut = split.split_page(two(angle), "auto", 100)
    half = 200 * np.tan(np.radians(angle))
    assert cut.kind == "two_pages" and abs(cut.cutters[0][0] - (300 - half)) <= 6 and abs(cut.cutters[0][1] - (300 + half)) <= 6
    outlines = split.page_outlines(600, 400, cut)
    left, x0, x1 = split.cut_page(two(angle), *outlines[1])
    assert x0 == 0 and abs(x1 - (300 + abs(half))) <= 7 and left.shape == (400, x1)
    if angle:
        corner = left[0, -1] if half > 0 else left[-1, -1]
        assert corner == 255  # beyond the tilted edge


def test_two_pages_without_a_fold_are_cut_at_white_space():
    g = np.full((500, 800), 225, np.uint8)
    letters(g, 60, 60, 340, 440)
    letters(g, 470, 60, 740, 440, 5)
    cut = split.split_page(g, "auto", 150)
    assert cut.kind == "two_pages" and abs(split.middle(cut.cutters[0]) - 405) <= 25


def test_one_page_rules():
    at = lambda x: (float(x), float(x))
    cut = lambda *xs, kind="auto": split.cut_at_lines(kind, 1, [at(x) for x in xs], 200)
    assert cut() == split.Layout("single_uncut") and cut(100) == split.Layout("single_uncut")
    assert cut(10) == split.Layout("page_plus_offcut", (at(10), at(200))) and cut(190) == split.Layout("page_plus_offcut", (at(0), at(190)))
    assert cut(10, 190) == split.Layout("page_plus_offcut", (at(10), at(190)))
    assert cut(10, 30) == split.Layout("page_plus_offcut", (at(30), at(200)))  # both far on one side: the nearer one
    assert cut(kind="page_plus_offcut") is None
    assert split.cut_at_lines("auto", 2, [at(90), at(105), at(10)], 200) == split.Layout("two_pages", (at(105),))
    assert split.cut_at_lines("auto", 2, [at(10)], 200) is None


def test_offcuts():
    assert split.offcut_cut("auto", [(0, 20), (40, 180)], 200, True, False).cutters[0] == (30.0, 30.0)
    assert split.offcut_cut("auto", [(20, 180)], 200, True, False).cutters[0] == (10.0, 10.0)
    assert split.offcut_cut("auto", [(20, 150), (180, 200)], 200, False, True).cutters[1] == (165.0, 165.0)
    assert split.offcut_cut("auto", [(0, 180)], 200, True, False).kind == "single_uncut"
    assert split.offcut_cut("page_plus_offcut", [], 200, True, False).cutters == ((0.0, 0.0), (200.0, 200.0))


def test_edge_spans_within_a_fifteenth_go():
    assert split.without_edge_spans([(0, 3), (20, 120), (130, 133)]) == [(20, 120)]
    assert split.without_edge_spans([(0, 50), (60, 100)]) == [(0, 50), (60, 100)]
    assert split.without_edge_spans([(0, 5)]) == [(0, 5)] and split.without_edge_spans([]) == []


def test_horizontal_shadows_go_before_the_angle_is_sought():
    b = np.zeros((300, 400), bool)
    b[:12] = True
    b[100:104, 50:350] = True
    out = pagework.without_shadows(b, 100)
    assert not out[:12].any() and out[100:104, 50:350].all()
    assert rasters.reduced(b, 0) is b
