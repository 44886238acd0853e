import numpy as np

from pagemill.functions import curves
from pagemill.operators import dewarp
from test_content import letters


def flat_page(h=500, w=700):
    return letters(np.full((h, w), 225, np.uint8), 40, 40, 660, 460)


def curl(g, lift=24.0):
    """The page drawn as if its middle rose: rows bend upwards."""
    h, w = g.shape
    x = np.arange(w)
    rise = lift * np.sin(x / w * np.pi)
    out = np.full_like(g, 225)
    for c in range(w):
        src = np.clip(np.round(np.arange(h) + rise[c] * (1 - 0.5 * np.arange(h) / h)).astype(int), 0, h - 1)
        out[:, c] = g[src, c]
    return out


def test_lines_of_a_page_are_traced():
    lines = dewarp.text_lines(flat_page() < 128)
    assert len(lines) >= 14 and all(np.ptp(line[:, 1]) < 3 for line in lines)
    bent = dewarp.text_lines(curl(flat_page()) < 128)
    assert len(bent) >= 14 and np.median([np.ptp(line[:, 1]) for line in bent]) > 10


def test_flat_pages_stay_as_they_are():
    g = flat_page()
    assert dewarp.find_model(g < 128) is None and dewarp.flattened(g) is g


def test_curled_pages_become_flat():
    g = curl(flat_page())
    before = dewarp.waviness(dewarp.text_lines(g < 128), None)
    out = dewarp.flattened(g, 2.0)
    after = dewarp.waviness(dewarp.text_lines(out < 128), None)
    assert out.shape == g.shape and before > 10 and after < before / 8
    ink = lambda a: (a < 128).sum()
    assert 0.8 < ink(out) / ink(g) < 1.25


def test_pages_without_lines_have_no_model():
    rng = np.random.default_rng(2)
    assert dewarp.find_model(rng.random((200, 300)) < 0.02) is None
    assert dewarp.find_model(np.zeros((50, 50), bool)) is None


def test_a_flat_model_carried_beyond_its_curves_is_the_page():
    g = flat_page(100, 120)
    model = curves.Cylinder([(30, 20), (90, 20)], [(30, 80), (90, 80)])
    corners = model.to_unit(np.array([[0.0, 0.0], [120.0, 100.0]]))
    out = curves.dewarp(g, model, 100, 120, across=(corners[0, 0], corners[1, 0]), down=(corners[0, 1], corners[1, 1]))
    assert np.array_equal(out, g)
