import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import curves
from pagemill.operators import pagework, rasters, split
from pagemill.plans import cli, stages
from pagemill.sources import images
from pagemill.streaming import pages as stream


def sheet(h=240, w=170, left=30, right=140, top=40, bottom=200):
    """A page with lines of text."""
    rng = np.random.default_rng(4)
    g = np.full((h, w), 235, np.uint8)
    for y in range(top, bottom - 9, 18):
        for x in range(left, right - 8, 10):
            if rng.random() < 0.9 or x == left:
                g[y : y + 9, x : x + 8] = 20
    return g


def two_pages():
    g = np.hstack([sheet(), sheet()])
    g[:, 168:172] = 90
    return g


def table(spark, planes):
    return spark.createDataFrame([(i, *g.shape, bytearray(g.tobytes())) for i, g in enumerate(planes)], "img int, height int, width int, data binary")


def test_estimates(spark):
    rows = {(r.img, r.sub_page): r for r in stages.estimate(table(spark, [sheet(), two_pages(), np.full((60, 50), 255, np.uint8)])).collect()}
    assert {k for k in rows if k[0] == 1} == {(1, 1), (1, 2)}
    assert abs(rows[1, 1].x1 - 170) <= 5  # lines are five pixels thick
    one = rows[0, 0]
    assert one.angle == 0 and abs(one.left + one.x0 - 30) <= 3 and abs(one.top - 40) <= 3 and abs(one.bottom - 200) <= 8
    assert [r.left for k, r in rows.items() if k[0] == 2] == [None]


def test_all_stages_give_pages_of_one_size(spark):
    out = stages.run(table(spark, [sheet(), sheet(top=80)]), dpi=100).collect()
    assert len({(r.height, r.width) for r in out}) == 1
    for r in out:
        g = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
        assert set(np.unique(g)) == {0, 255} and (g == 0).sum() > 3000


def test_stored_parameters_are_reused(spark):
    fresh = stages.estimate(table(spark, [sheet(), sheet()]))
    stored = fresh.select("img", "sub_page", F.when(F.col("img") == 0, "manual").otherwise("auto").alias("mode"), *[(F.col(c) + F.when(F.col("img") == 0, 10).otherwise(0)).alias(f"stored_{c}") for c in ("x0", "x1", "y0", "y1")], F.lit(1.5).alias("stored_angle"), *[F.lit(v).cast("int").alias(f"stored_{c}") for c, v in (("left", 50), ("right", 60), ("top", 70), ("bottom", 80))])
    got = {r.img: r for r in stages.reuse(fresh, stored).collect()}
    assert got[0].stale and (got[0].left, got[0].top, got[0].angle) == (40, 60, 1.5)
    assert not got[1].stale and (got[1].left, got[1].angle) == (50, 1.5)
    again = stages.reuse(fresh, stored).collect()
    assert sorted(again) == sorted(got.values())


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    planes = [sheet(), sheet(top=90), two_pages()]
    for i, g in enumerate(planes):
        (tmp_path / "in" / f"{i}.tif").write_bytes(images.tiff_bytes(g, (100, 100)))
    (tmp_path / "in" / "broken.tif").write_bytes(b"II*\0")
    stream.estimates_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    cols = [f.split()[0] for f in stages.ESTIMATES.split(", ")]
    want = stages.estimate(stream.decoded(files)).select(cols).collect()
    assert sorted(map(str, spark.read.schema(stages.ESTIMATES).parquet(str(tmp_path / "t")).select(cols).collect())) == sorted(map(str, want))
    sizes = stream.page_sizes(spark, str(tmp_path / "t"), 100).select(F.round("page_w", 6), F.round("page_h", 6)).distinct().count()
    assert sizes == 1


def test_two_page_cut_prefers_balance_then_width():
    assert split.two_page_cut([(10, 100), (110, 190), (260, 350)], 360) == 225
    assert split.two_page_cut([(10, 100)], 360) == 180  # well on one side: the middle
    assert split.two_page_cut([(10, 200)], 360) == 215  # beside the content
    assert split.two_page_cut([], 360) == 180
    # of gaps that part nearly as well as the best one the widest
    assert split.two_page_cut([(0, 100), (104, 110), (140, 240)], 240) == 125


@pytest.mark.parametrize(("counts", "least", "gap", "want"), [([0, 1, 1, 0], 1, 1, [(1, 3)]), ([1, 0, 1, 0, 0, 1], 2, 2, [(0, 3)]), ([1, 0, 0, 1], 2, 3, [(0, 4)]), ([], 1, 1, [])])
def test_spans(counts, least, gap, want):
    assert split.spans(np.array(counts), least, gap) == want


def test_rendering_modes():
    g = sheet()
    bw, specks = pagework.rendered(g, "bw", fill=[(10, [(0, 0), (20, 0), (20, 20), (0, 20)])])
    assert set(np.unique(bw)) == {0, 255} and (bw[:20, :20] == 0).all() and specks.dtype == bool
    color, _ = pagework.rendered(g, "color")
    assert color.max() == 254
    picture = g.copy()
    picture[60:140, 40:120] = (np.arange(80) + 60).astype(np.uint8)
    mixed, _ = pagework.rendered(picture, "mixed", normalize=False)
    assert len(np.unique(mixed[70:130, 50:110])) > 20 and set(np.unique(mixed[:30])) <= {0, 255}
    erased, _ = pagework.rendered(picture, "mixed", normalize=False, zones=[("eraser3", [(0, 0), (170, 0), (170, 240), (0, 240)])])
    assert set(np.unique(erased)) == {0, 255}


def test_background_of_uneven_light():
    g = sheet().astype(int) - np.linspace(0, 80, 170).astype(int)
    flat = pagework.normalised(np.clip(g, 0, 255).astype(np.uint8))
    assert np.median(flat[:30, :20]) > 240 and np.median(flat[:30, -20:]) > 240


def test_options():
    o = cli.parse(["--layout=2", "--layout-direction=rl", "--orientation=left", "--margins=3", "--margins-left=9", "--dpi-x=200", "--output-dpi=300", "--deskew=auto", "--content-box=1x2:30x40", "a.tif", "out"])
    assert (o.layout, o.right_to_left, o.rotation, o.margins["left"], o.dpi, o.output_dpi) == ("two_pages", True, 270, 3.0, (200, 600), (300, 300))
    assert o.deskew_mode == "manual" and o.content_box == (1, 2, 30, 40) and o.inputs == ("a.tif",) and o.output == "out"
    for bad in (["--orientation=none", "a"], ["--layout=3", "a"], ["--start-filter=7", "a"], []):
        with pytest.raises(cli.UsageError):
            cli.parse(bad)


def test_curves():
    line = [(0, 0), (10, 0), (10, 10)]
    assert curves.at_arc_length(line, [0, 0.5, 1]).tolist() == [[0, 0], [10, 0], [10, 10]]
    assert curves.nearest_on_polyline(line, (5, 3))[1] == 9
    assert curves.line_meets_polyline(line, (0, 5), (20, 5)).tolist() == [10, 5]
    square, quad = [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (10, 1), (9, 8), (1, 9)]
    assert np.allclose(curves.mapped(curves.homography(square, quad), square), quad)
    for tension in (-1, 0):
        s = curves.xspline([(0, 0), (5, 5), (10, 0)], [tension] * 3)
        assert np.allclose(s[0], (0, 0)) and np.allclose(s[-1], (10, 0)) and curves.nearest_on_polyline(s, (5, 5))[1] < 1e-6
    smooth = curves.xspline([(0, 0), (5, 5), (10, 0)], [0, 1, 0])
    assert smooth[:, 1].max() < 5


def test_flat_cylinder_is_the_identity():
    g = sheet()
    h, w = g.shape
    flat = curves.Cylinder([(0, 0), (w, 0)], [(0, h), (w, h)])
    assert np.array_equal(curves.dewarp(g, flat, h, w), g)
    x = np.linspace(0, w, 30)
    bent = curves.Cylinder(np.column_stack([x, 10 + 5 * np.sin(x / 40)]), np.column_stack([x, 200 + 5 * np.sin(x / 40)]))
    p = np.random.default_rng(0).random((50, 2))
    assert np.allclose(bent.to_unit(bent.to_warped(p)), p, atol=1e-6)
    assert curves.valid_model(bent.top, bent.bottom) and not curves.valid_model(bent.bottom, bent.top)


def bent(depth=2.0, lift=30.0):
    x = np.linspace(20, 380, 60)
    bow = np.sin((x - 20) / 360 * np.pi)
    return curves.Cylinder(np.column_stack([x, 60 - lift * bow]), np.column_stack([x, 240 + 5 * bow]), depth)


def test_depth_changes_the_profile_and_maps_are_inverse():
    p = np.random.default_rng(1).random((200, 2))
    places = {}
    for depth in (0.0, 0.5, 1.0, 3.0):
        m = bent(depth)
        assert np.allclose(m.to_unit(m.to_warped(p)), p, atol=1e-6)
        places[depth] = m.to_warped(p)
        for y, curve in ((0.0, m.top), (1.0, m.bottom)):  # the curves are the edges
            q = m.to_warped(np.column_stack([np.linspace(0, 1, 50), np.full(50, y)]))
            assert max(curves.nearest_on_polyline(curve, z)[1] for z in q) < 1e-6
    assert np.abs(places[0.5] - places[3.0]).max() > 2 and bent(3.0).length > bent(0.5).length > bent(0.0).length
    assert abs(bent(0.0).length - 1) < 1e-9  # a flat profile is as long as the plane is wide


def test_bent_lines_come_out_straight():
    m = bent()
    g = np.full((300, 400), 255, np.uint8)
    for y in (0.25, 0.5, 0.75):
        for u, v in np.round(m.to_warped(np.column_stack([np.linspace(0, 1, 3000), np.full(3000, y)]))).astype(int).tolist():
            g[v - 1 : v + 2, u] = 0
    flat = curves.dewarp(g, m, 200, 360)
    for y in (50, 100, 150):
        assert (flat[y - 2 : y + 3].min(axis=0) < 100).mean() > 0.97
    assert (flat[[25, 75, 125, 175]] == 255).mean() > 0.97


def test_skew_of_a_turned_page():
    text = sheet(400, 400, 40, 360, 40, 360)
    angle, confidence = pagework.skew(pagework.rotated(text, 3.0))
    assert abs(abs(angle) - 3) <= 0.3 and confidence >= 2
    back = pagework.skew(pagework.rotated(pagework.rotated(text, 3.0), -angle))
    assert abs(back[0]) <= 0.3
    assert rasters.find_skew(np.zeros((50, 50), bool))[1] == 0.0
