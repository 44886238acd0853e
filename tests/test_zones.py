import numpy as np

from pagemill.functions import curves
from pagemill.operators import rasters
from pagemill.sources import zones


def test_fit_finds_the_control_points_again():
    tensions = [-1, -1, -1, -1]
    truth = np.array([(0, 0), (30, 20), (60, -10), (100, 5)], float)
    points = curves.xspline(truth, tensions, 40)
    start = truth + np.array([(0, 0), (3, -8), (-4, 9), (0, 0)])
    found = curves.fit_xspline(points, start, tensions, fixed=(0, 3), stiffness=0.0)
    line = curves.xspline(found, tensions, 40)
    assert np.array_equal(found[[0, 3]], truth[[0, 3]])
    assert max(curves.nearest_on_polyline(line, p)[1] for p in points) < 0.05


def test_weights_and_directions():
    p, t = np.array([(0, 0), (5, 5), (10, 0), (15, 3)], float), [0, 1, -1, 0]
    w = curves.xspline_weights(t)
    assert np.allclose(w @ p, curves.xspline(p, t)) and np.allclose(w.sum(axis=1), 1)
    d = curves.xspline_directions([(0, 0), (10, 0)], [0, 0])
    assert np.allclose(d, [(1, 0)] * len(d))


def test_closed_polygons():
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert zones.closed_polygon(square) == [(0, 0), (10, 0), (10, 10), (0, 10)]
    round_ = zones.closed_polygon(square, [1] * 4)
    inside = rasters.fill_polygon((12, 12), round_)
    assert 20 < inside.sum() < 100 and inside[5, 5]


def test_zones_as_xml(spark, tmp_path):
    rows = [(1, "painter2", None, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]), (2, "fill", 200, [(1.5, 1.0), (2.0, 2.0)]), (3, "other", None, [(0.0, 0.0)] * 3)]
    d = spark.createDataFrame(rows, f"page long, kind string, level int, points {zones.POINT}")
    zones.write_zones(d, str(tmp_path / "z"))
    back = sorted(tuple(r) for r in zones.read_zones(spark, str(tmp_path / "z")).select("page", "kind", "level", "points").collect())
    assert [(r[0], r[1], r[2], [tuple(p) for p in r[3]]) for r in back] == [r for r in rows if r[0] < 3]
    assert {r.page: (r.area, r.valid) for r in zones.with_area(d).collect()} == {1: (6.0, True), 2: (0.0, False), 3: (0.0, False)}


def test_frames_and_blits():
    f = rasters.framed(4, 5, 9, 200)
    assert f.sum() == 14 * 200 + 6 * 9 and (f[1:-1, 1:-1] == 9).all()
    g = rasters.drawn_over(np.zeros((4, 4), np.uint8), np.full((3, 3), 7, np.uint8), 2, -1)
    assert np.argwhere(g).tolist() == [[2, 0], [2, 1], [3, 0], [3, 1]]
    assert np.allclose(rasters.polynomial_line(np.arange(10) ** 2.0, 2), np.arange(10) ** 2)
