import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.sources import images, project


def plane(h=37, w=53, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 5000, bytes(range(256)) * 40, np.random.default_rng(0).integers(0, 4, 30000).astype(np.uint8).tobytes()])
def test_lzw_round_trip(data):
    assert images.lzw_decode(images.lzw_encode(data)) == data


def test_files_round_trip(spark, tmp_path):
    g = plane()
    b = g < 90
    (tmp_path / "a.tif").write_bytes(images.tiff_bytes(g, (300, 600)))
    (tmp_path / "b.tif").write_bytes(images.tiff_bytes(b, (200, 200)))
    (tmp_path / "c.png").write_bytes(images.png_bytes(g, (150, 150)))
    (tmp_path / "d.pgm").write_bytes(b"P5\n53 37\n255\n" + g.tobytes())
    (tmp_path / "e.txt").write_bytes(b"not an image")
    (tmp_path / "f.tif").write_bytes(b"II*\0\xff\xff\xff\x00")
    found = {r.file_path.rsplit("/", 1)[1]: r for r in images.read_metadata(spark, str(tmp_path)).collect()}
    assert [tuple(found[n])[1:6] for n in ("a.tif", "b.tif", "c.png", "d.pgm")] == [(0, 53, 37, 300, 600), (0, 53, 37, 200, 200), (0, 53, 37, 150, 150), (0, 53, 37, 0, 0)]
    assert found["e.txt"].error and found["f.tif"].error
    planes = {r.file_path.rsplit("/", 1)[1]: r for r in images.read_planes(spark, str(tmp_path)).collect()}
    for n in ("a.tif", "c.png", "d.pgm"):
        assert np.array_equal(np.frombuffer(planes[n].data, np.uint8).reshape(37, 53), g)
    assert np.array_equal(np.frombuffer(planes["b.tif"].data, np.uint8).reshape(37, 53) == 0, b)


def test_jpeg_metadata():
    head = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x01\x00\x48\x00\x60\x00\x00\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00"
    assert images.metadata_of(head) == [(32, 16, 72, 96)]


def test_project_round_trip(spark, tmp_path):
    i = spark.createDataFrame([(1, "/a b/x&y.tif", 0, 2, False, False, 100, 200, 300, 300), (2, "/a b/z.tif", 1, 1, True, False, 10, 20, 72, 72), (3, "/a b/z.tif", 2, 1, False, False, 1, 2, 0, 0)], "image_ord long, file_path string, page int, sub_pages int, left_removed boolean, right_removed boolean, width int, height int, dpi_x int, dpi_y int")
    p = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 2, False), (3, 0, False)], "image_ord long, sub_page int, selected boolean")
    xml = project.project_xml(i, p, "/out", "RTL")
    path = tmp_path / "p.xml"
    path.write_text(xml.replace("</pages>", '<page id="99" imageId="77" subPage="left"/></pages>'))
    back = project.read_project(spark, str(path))
    cols = ["file_path", "page", "sub_pages", "left_removed", "right_removed", "width", "height", "dpi_x", "dpi_y"]
    assert sorted(map(tuple, back["images"].select(cols).collect())) == sorted(map(tuple, i.select(cols).collect()))
    joined = back["pages"].join(back["images"].select("image_id", "file_path", "page"), "image_id")
    want = p.join(i.select("image_ord", "file_path", "page"), "image_ord")
    cols = ["file_path", "page", "sub_page", "selected"]
    assert sorted(map(tuple, joined.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_listed_files(spark, tmp_path):
    (tmp_path / "list").write_text("a.tif  b.tif\n\n c.tif\n")
    assert sorted(r.file_path for r in images.listed_files(spark, str(tmp_path / "list")).select(F.col("file_path")).collect()) == ["a.tif", "b.tif", "c.tif"]


def gray_of(rgb):
    return ((rgb[..., 0].astype(int) * 11 + rgb[..., 1].astype(int) * 16 + rgb[..., 2].astype(int) * 5) >> 5).astype(np.uint8)


def tiff(w, h, strips, rows, bits=8, compression=1, kind=1, samples=1, predictor=1, colors=(), order="<"):
    """A TIFF of these strips."""
    import struct

    body, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(body))
        body += s + b"\0" * (len(s) % 2)
    at = 8 + len(body)
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * samples), (259, 3, [compression]), (262, 3, [kind]), (273, 4, offsets), (277, 3, [samples]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor])]
    tags += [(320, 3, list(colors))] if colors else []
    extra, entries, more = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, t, v in tags:
        packed = struct.pack(order + ("H" if t == 3 else "I") * len(v), *v)
        place = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(order + "I", extra + len(more))
        more += packed if len(packed) > 4 else b""
        entries += struct.pack(order + "HHI", tag, t, len(v)) + place
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + body + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + more


def test_kinds_of_tiff():
    import zlib

    g = plane(11, 13)
    rgb = np.random.default_rng(4).integers(0, 256, (11, 13, 3)).astype(np.uint8)
    two = [g[:6].tobytes(), g[6:].tobytes()]
    assert np.array_equal(images.tiff_plane(tiff(13, 11, two, 6), 0), g)
    assert np.array_equal(images.tiff_plane(tiff(13, 11, [zlib.compress(s) for s in two], 6, compression=8, order=">"), 0), g)
    runs = b"".join(bytes([12]) + r.tobytes() for r in g)
    assert np.array_equal(images.tiff_plane(tiff(13, 11, [runs], 11, compression=32773), 0), g)
    assert images.packbits_decode(bytes([254, 7, 1, 5, 6, 128])) == bytes([7, 7, 7, 5, 6])
    assert np.array_equal(images.tiff_plane(tiff(13, 11, [g.tobytes()], 11, kind=0), 0), 255 - g)
    assert np.array_equal(images.tiff_plane(tiff(13, 11, [rgb.tobytes()], 11, kind=2, samples=3), 0), gray_of(rgb))
    assert np.array_equal(images.tiff_plane(images.tiff_bytes(rgb, (300, 300)), 0), gray_of(rgb)) and images.metadata_of(images.tiff_bytes(rgb, (300, 300))) == [(13, 11, 300, 300)]
    diff = np.diff(g, axis=1, prepend=np.zeros((11, 1), np.uint8)).astype(np.uint8)
    assert np.array_equal(images.tiff_plane(tiff(13, 11, [diff.tobytes()], 11, predictor=2), 0), g)
    colors = np.random.default_rng(5).integers(0, 256, (256, 3))
    assert np.array_equal(images.tiff_plane(tiff(13, 11, [g.tobytes()], 11, kind=3, colors=(colors.T << 8).ravel().tolist()), 0), gray_of(colors[g]))
    four = g >> 4
    packed = np.pad(four, ((0, 0), (0, 1)))
    assert np.array_equal(images.tiff_plane(tiff(13, 11, [(packed[:, ::2] << 4 | packed[:, 1::2]).tobytes()], 11, bits=4), 0), four * 17)
    wide = g.astype("<u2") << 8 | 3
    assert np.array_equal(images.tiff_plane(tiff(13, 11, [wide.tobytes()], 11, bits=16), 0), g)
    with pytest.raises(ValueError):
        images.tiff_plane(tiff(13, 11, two, 6, compression=7), 0)


def test_kinds_of_png():
    import struct
    import zlib

    def png(w, h, depth, color, rows, palette=b""):
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return images.PNG + chunk(b"IHDR", struct.pack(">2I5B", w, h, depth, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")

    g = plane(9, 8)
    rgb = np.random.default_rng(6).integers(0, 256, (9, 8, 3)).astype(np.uint8)
    assert np.array_equal(images.png_plane(png(8, 9, 8, 2, [r.tobytes() for r in rgb])), gray_of(rgb))
    assert np.array_equal(images.png_plane(png(8, 9, 1, 0, [np.packbits(r > 127).tobytes() for r in g])), np.where(g > 127, 255, 0))
    assert np.array_equal(images.png_plane(png(8, 9, 16, 0, [(r.astype(">u2") << 8).astype(">u2").tobytes() for r in g])), g)
    colors = np.random.default_rng(7).integers(0, 256, (256, 3)).astype(np.uint8)
    assert np.array_equal(images.png_plane(png(8, 9, 8, 3, [r.tobytes() for r in g], colors.tobytes())), gray_of(colors[g]))
