"""Projects as XML: a catalog of directories, files, images and pages with ids from one counter, and back."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTORY = "_id LONG, _path STRING"
FILE = "_id LONG, _dirId LONG, _name STRING"
IMAGE = "_id LONG, _subPages INT, _fileId LONG, _fileImage INT, _removed STRING, size STRUCT<_width: INT, _height: INT>, dpi STRUCT<_horizontal: INT, _vertical: INT>"
PAGE = "_id LONG, _imageId LONG, _subPage STRING, _selected STRING"
SUB_PAGES = ("single", "left", "right")


def read_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images and pages of a project; rows whose keys lead nowhere, or that lack one, go."""

    def rows(tag, schema):
        return spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(schema).load(path)

    dirs = rows("directory", DIRECTORY).where("_id IS NOT NULL AND _path IS NOT NULL").select(F.col("_id").alias("dir_id"), F.col("_path").alias("dir"))
    files = rows("file", FILE).where("_id IS NOT NULL AND _name IS NOT NULL").select(F.col("_id").alias("file_id"), F.col("_dirId").alias("dir_id"), F.col("_name").alias("name")).join(dirs, "dir_id")
    images = rows("image", IMAGE).where("_id IS NOT NULL").select(
        F.col("_id").alias("image_id"), F.col("_subPages").alias("sub_pages"), F.col("_fileId").alias("file_id"), F.coalesce("_fileImage", F.lit(0)).alias("page"),
        F.coalesce(F.col("_removed") == "L", F.lit(False)).alias("left_removed"), F.coalesce(F.col("_removed") == "R", F.lit(False)).alias("right_removed"),
        F.col("size._width").alias("width"), F.col("size._height").alias("height"), F.col("dpi._horizontal").alias("dpi_x"), F.col("dpi._vertical").alias("dpi_y"),
    ).join(files.select("file_id", F.concat_ws("/", "dir", "name").alias("file_path")), "file_id")
    sub = F.array_position(F.array(*map(F.lit, SUB_PAGES)), F.col("_subPage")).cast("int") - 1
    pages = rows("page", PAGE).select(F.col("_id").alias("page_id"), F.col("_imageId").alias("image_id"), sub.alias("sub_page"), F.coalesce(F.col("_selected") == "selected", F.lit(False)).alias("selected"))
    return {"images": images, "pages": pages.where("sub_page >= 0").join(images.select("image_id"), "image_id")}


def project_xml(images: DataFrame, pages: DataFrame, output_directory: str = "", direction: str = "LTR") -> str:
    """The text of a project. images: image_ord, file_path, page, sub_pages, left_removed, right_removed, width, height, dpi_x,
    dpi_y; pages: image_ord, sub_page, selected. One document is made by the driver, as the file is one document."""
    taken: dict[tuple, int] = {}

    def number(*key):
        return taken.setdefault(key, len(taken) + 1)

    rows, of = images.orderBy("image_ord").collect(), pages.orderBy("image_ord", "sub_page").collect()
    dirs, files, shown, subs = [], [], [], []
    for r in rows:
        d, _, name = r.file_path.rpartition("/")
        if ("d", d) not in taken:
            dirs.append(f"<directory id={quoteattr(str(number('d', d)))} path={quoteattr(d)}/>")
        if ("f", r.file_path) not in taken:
            files.append(f"<file id={quoteattr(str(number('f', r.file_path)))} dirId={quoteattr(str(number('d', d)))} name={quoteattr(name)}/>")
        removed = ' removed="L"' if r.left_removed else ' removed="R"' if r.right_removed else ""
        dpi = f'<dpi horizontal="{r.dpi_x}" vertical="{r.dpi_y}"/>'
        shown.append(f'<image id="{number("i", r.image_ord)}" subPages="{r.sub_pages}" fileId="{number("f", r.file_path)}" fileImage="{r.page}"{removed}><size width="{r.width}" height="{r.height}"/>{dpi}</image>')
    for p in of:
        selected = ' selected="selected"' if p.selected else ""
        subs.append(f'<page id="{number("p", p.image_ord, p.sub_page)}" imageId="{number("i", p.image_ord)}" subPage="{SUB_PAGES[p.sub_page]}"{selected}/>')
    part = lambda tag, items: f"<{tag}>\n" + "\n".join(items) + f"\n</{tag}>"
    body = "\n".join(part(t, x) for t, x in (("directories", dirs), ("files", files), ("images", shown), ("pages", subs)))
    return f"<project outputDirectory={quoteattr(output_directory)} layoutDirection={quoteattr(direction)}>\n{body}\n</project>\n"
