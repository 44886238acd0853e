"""The command line drives the stages: each option changes what comes out."""

import io
import os
import sys

import numpy as np
import pytest

from pagemill import __main__ as entry
from pagemill.plans import batch, cli
from pagemill.sources import images, project
from test_stages import sheet, two_pages


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("scans")
    (d / "p10.tif").write_bytes(images.tiff_bytes(sheet(), (100, 100)))
    (d / "p2.png").write_bytes(images.png_bytes(sheet(top=80), (100, 100)))
    return d


@pytest.fixture(scope="module")
def scan(spark, folder, tmp_path_factory):
    """(pages, {file name: plane}) of a run with these options."""

    def run(*args, inputs=None):
        out, work = tmp_path_factory.mktemp("out"), tmp_path_factory.mktemp("work")
        o = cli.parse(["--dpi=100", "--output-dpi=100", *args, *(inputs or [str(folder)]), str(out)])
        found = batch.run(spark, o, str(work))
        files = {os.path.relpath(os.path.join(d, n), out): images.tiff_plane(open(os.path.join(d, n), "rb").read(), 0) for d, _, names in os.walk(out) for n in names}
        if "files" in found:
            assert {r.name for r in found["files"].collect()} == set(files)
        return sorted(found["pages"].collect(), key=lambda r: (r.img, r.sub_page)), files, found

    return run


@pytest.fixture(scope="module")
def plain(scan):
    return scan()


def test_files_come_out_in_natural_order_and_of_one_size(plain):
    pages, files, found = plain
    assert [r.img for r in pages] == [0, 1] and {n for n in files if "/" not in n} == {"p2.tif", "p10.tif"}
    assert len({files[n].shape for n in ("p2.tif", "p10.tif")}) == 1 and set(np.unique(files["p2.tif"])) == {0, 255}
    assert found["errors"].count() == 0


def test_margins_and_alignment(scan, plain):
    wide = scan("--margins=30")[1]["p2.tif"]
    assert wide.shape[0] > plain[1]["p2.tif"].shape[0] + 100 and wide.shape[1] > plain[1]["p2.tif"].shape[1] + 100
    left = scan("--margins-left=40")[1]["p2.tif"]
    assert left.shape[1] > plain[1]["p2.tif"].shape[1] + 100 and left.shape[0] == plain[1]["p2.tif"].shape[0]
    rows = lambda g: np.flatnonzero((g == 0).any(axis=1))
    top, bottom = (scan(f"--alignment-vertical={k}")[1]["p2.tif"] for k in ("top", "bottom"))
    assert rows(top)[0] < rows(plain[1]["p2.tif"])[0] < rows(bottom)[0]
    own = scan("--alignment=original")[1]
    assert own["p2.tif"].shape[0] < own["p10.tif"].shape[0]


def test_orientation_angle_and_content_box(scan, plain):
    turned = scan("--orientation=left", "--layout=1")[1]["p10.tif"]
    assert turned.shape[1] > turned.shape[0]
    assert [r.angle for r in scan("--rotate=2.5", "--end-filter=4")[0]] == [2.5, 2.5]
    pages = scan("--content-box=10x20:60x70", "--end-filter=4")[0]
    assert [(r.left, r.top, r.right, r.bottom) for r in pages] == [(10, 20, 70, 90)] * 2


def test_layouts(scan, folder, tmp_path):
    (tmp_path / "both.tif").write_bytes(images.tiff_bytes(two_pages(), (100, 100)))
    inputs = [str(tmp_path / "both.tif")]
    assert {n for n in scan(inputs=inputs)[1] if "/" not in n} == {"both_1L.tif", "both_2R.tif"}
    assert {n for n in scan("--layout-direction=rl", inputs=inputs)[1] if "/" not in n} == {"both_2L.tif", "both_1R.tif"}
    assert {n for n in scan("--layout=1", inputs=inputs)[1] if "/" not in n} == {"both.tif"}
    assert [r.layout for r in scan("--layout=2", "--end-filter=2")[0]] == ["two_pages"] * 4
    # options of stages before the first one are not set up
    assert [r.layout for r in scan("--layout=2", "--start-filter=3", "--end-filter=4")[0]] == ["single_uncut"] * 2


def test_end_filter(scan):
    pages, files, found = scan("--end-filter=3")
    assert not files and "files" not in found and [r.left for r in pages] == [None, None]
    pages, files, found = scan("--end-filter=5")
    assert not files and all(r.page_w > 0 for r in pages)


def test_output_options(scan, folder, plain, tmp_path):
    twice = scan("--output-dpi=200")[1]["p10.tif"]
    assert all(abs(a - 2 * b) <= 2 for a, b in zip(twice.shape, plain[1]["p10.tif"].shape, strict=True))
    gray = scan("--color-mode=color_grayscale")[1]["p10.tif"]
    assert len(np.unique(gray)) > 2 or 235 in gray
    white = scan("--color-mode=color_grayscale", "--white-margins")[1]["p10.tif"]
    assert (white == 254).sum() > (gray == 254).sum()  # paper around the content comes along unless margins are white
    uneven = np.clip(sheet().astype(int) - np.linspace(0, 90, 240).astype(int)[:, None], 0, 255).astype(np.uint8)
    (tmp_path / "u.png").write_bytes(images.png_bytes(uneven, (100, 100)))
    shades = [scan("--color-mode=color_grayscale", "--white-margins", *more, inputs=[str(tmp_path / "u.png")])[1]["u.tif"] for more in ([], ["--normalize-illumination"])]
    paper = lambda g: g[(g > 100) & (g < 254)]
    assert np.std(paper(shades[1])) < np.std(paper(shades[0]))
    dark = scan("--threshold=60")[1]["p10.tif"]
    assert (dark == 0).sum() >= (plain[1]["p10.tif"] == 0).sum()
    assert any(n.startswith("cache/automask/") for n in scan("--color-mode=mixed")[1])


def test_despeckling_and_its_specks(scan, tmp_path):
    g = sheet(400, 300, 40, 260, 60, 340)
    g[352, 150] = g[200, 268] = 0
    (tmp_path / "s.png").write_bytes(images.png_bytes(g, (100, 100)))
    box = "--content-box=20x40:260x330"
    off, hard = (scan(f"--despeckle={k}", box, inputs=[str(tmp_path / "s.png")])[1] for k in ("off", "aggressive"))
    assert (off["s.tif"] == 0).sum() > (hard["s.tif"] == 0).sum()
    assert "cache/speckles/s.tif" in hard and "cache/speckles/s.tif" not in off


def test_dewarping(scan, tmp_path):
    from test_dewarp import curl, flat_page

    (tmp_path / "c.png").write_bytes(images.png_bytes(curl(flat_page()), (100, 100)))
    inputs, options = [str(tmp_path / "c.png")], ("--layout=1", "--rotate=0")
    off, auto = (scan(*options, f"--dewarping={k}", inputs=inputs)[1]["c.tif"] for k in ("off", "auto"))
    deep = scan(*options, "--dewarping=auto", "--depth-perception=3", inputs=inputs)[1]["c.tif"]
    assert not np.array_equal(off, auto) and not np.array_equal(auto, deep)


def test_names_projects_and_broken_files(spark, scan, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(sys, "stdin", io.StringIO(f"{folder}/p10.tif\n{folder}/p2.png\n"))
    assert len(scan("--end-filter=2", inputs=["-"])[0]) == 2
    out = tmp_path / "p.xml"
    scan(f"--output-project={out}", "--end-filter=2")
    back = project.read_project(spark, str(out))
    assert back["images"].count() == 2 and back["pages"].count() == 2
    assert len(scan("--end-filter=2", inputs=[str(out)])[0]) == 2
    (tmp_path / "bad.tif").write_bytes(b"II*\0")
    pages, _, found = scan("--end-filter=2", inputs=[str(folder / "p2.png"), str(tmp_path / "bad.tif")])
    assert len(pages) == 1 and found["errors"].count() == 1


def test_same_names_from_two_folders_get_numbers(scan, tmp_path):
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "x.png").write_bytes(images.png_bytes(sheet(), (100, 100)))
    files = scan(inputs=[str(tmp_path / "a" / "x.png"), str(tmp_path / "b" / "x.png")])[1]
    assert {n for n in files if "/" not in n} == {"x.tif", "x(1).tif"}


def test_entry(spark, folder, tmp_path, capsys):
    assert entry.main([]) == 1 and entry.main(["--layout=9", "a", "b"]) == 1
    assert entry.main(["--dpi=100", "--output-dpi=100", f"--work={tmp_path}/w", str(folder), f"{tmp_path}/o"]) == 0
    assert capsys.readouterr().out.startswith("2 pages, ") and os.path.exists(f"{tmp_path}/o/p2.tif")
