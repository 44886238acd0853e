"""The stages over image files, by the command line's options: files in, files and a project out."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.operators import catalog, layout
from pagemill.plans import cli, stages
from pagemill.sources import images, project

#: The stages by number.
ORIENTATION, SPLIT, DESKEW, CONTENT, LAYOUT, OUTPUT = range(1, 7)


def effective(o: cli.Options) -> cli.Options:
    """Options of stages before the first one to be set up keep their defaults."""
    plain = cli.Options()
    of_stage = {ORIENTATION: ("rotation",), SPLIT: ("layout",), DESKEW: ("deskew_mode", "angle"), CONTENT: ("content_box", "content_detection"), LAYOUT: ("margins", "align_h", "align_v")}
    back = {name: getattr(plain, name) for stage, names in of_stage.items() if stage < o.start_filter for name in names}
    return cli.replace(o, **back)


def input_files(spark: SparkSession, o: cli.Options) -> list[str]:
    """The names given; '-' stands for names from the standard input, and a project for the files of its images."""
    names: list[str] = []
    for name in o.inputs:
        if name == "-":
            names += sys.stdin.read().split()
        elif name.lower().endswith(".xml"):
            names += [r.file_path for r in project.read_project(spark, name)["images"].select("file_path").distinct().collect()]
        else:
            names.append(name)
    return names


def image_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """img (place in the natural order of names), file_path, file_name, page, height, width, data, error."""
    planes = images.read_planes(spark, names)
    named = planes.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1)).withColumn("key__", text.natural_key(F.col("file_name")))
    return catalog.ordered(named.withColumn("page", F.coalesce("page", F.lit(0))), "key__", "file_path", "page", name="img").drop("key__")


def output_names(pictures: DataFrame, right_to_left: bool) -> DataFrame:
    """img, label: images with the same name from different folders get numbers."""
    paths = pictures.groupBy("file_path", "file_name").agg(F.min("img").alias("first"))
    return pictures.select("img", "file_path", "file_name", "page").join(layout.numbered(paths, ["file_name"], "first", "label").select("file_path", "label"), "file_path").drop("file_path")


def run(spark: SparkSession, o: cli.Options, work: str) -> dict[str, DataFrame]:
    """pages (estimates, from stage 5 on with sizes), errors (img, error of images that can't be taken), and from stage 6 on files (name, size) below o.output.

    work: a folder that driver and executors share; images, estimates and pages are written there once, so that nothing is decoded twice.
    """
    o = effective(o)
    dpi = o.dpi[0]

    def kept(d: DataFrame, name: str) -> DataFrame:
        d.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    pictures = kept(image_table(spark, input_files(spark, o)), "images")
    angle = o.angle if o.deskew_mode == "manual" else None
    box = None if o.content_box is None else (int(o.content_box[0]), int(o.content_box[1]), int(o.content_box[0] + o.content_box[2]), int(o.content_box[1] + o.content_box[3]))
    pages = kept(stages.estimate(pictures, o.rotation, o.layout, angle, dpi, box, o.content_detection, min(o.end_filter, CONTENT)), "estimates")
    found = {"pages": pages.where("error IS NULL").drop("error"), "errors": pages.where("error IS NOT NULL").select("img", "error")}
    if o.end_filter >= LAYOUT:
        found["pages"] = pages = kept(stages.laid_out(pages, dpi, margins={f"margin_{k}": v for k, v in o.margins.items()}, align=(o.align_h, o.align_v)), "layout")
    if o.end_filter >= OUTPUT:
        rendered = stages.render(
            pictures, pages, dpi, o.rotation, o.output_dpi[0], mode=o.color_mode, threshold=o.threshold, normalize=o.color_mode != "color" or (o.normalize_illumination and o.white_margins),
            level=o.despeckle, white_margins=o.color_mode != "color" or o.white_margins, dewarping=o.dewarping, depth=o.depth_perception,
        )
        named = kept(rendered.join(output_names(pictures, o.right_to_left), "img"), "rendered")
        name = text.output_name(F.col("file_name"), F.col("label"), F.col("page"), F.col("sub_page"), o.right_to_left)
        out = named.withColumn("name", name)
        bw = o.color_mode == "bw"
        parts = [out.select("name", "height", "width", "data", F.lit(bw).alias("binary"))]
        parts.append(out.where("specks > 0").select(F.concat(F.lit("cache/speckles/"), "name").alias("name"), "height", "width", F.col("speckles").alias("data"), F.lit(True).alias("binary")))
        if o.color_mode == "mixed":
            parts.append(out.select(F.concat(F.lit("cache/automask/"), "name").alias("name"), "height", "width", F.col("mask").alias("data"), F.lit(True).alias("binary")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        found["files"] = kept(images.write_tiffs(every, o.output, o.output_dpi), "files")
    if o.output_project:
        shown = found["pages"]
        of = pictures.where("error IS NULL").join(shown.groupBy("img").agg(F.count(F.lit(1)).cast("int").alias("sub_pages")), "img")
        xml = project.project_xml(
            of.select(F.col("img").alias("image_ord"), "file_path", "page", "sub_pages", F.lit(False).alias("left_removed"), F.lit(False).alias("right_removed"), "width", "height", F.lit(o.dpi[0]).alias("dpi_x"), F.lit(o.dpi[1]).alias("dpi_y")),
            shown.select(F.col("img").alias("image_ord"), "sub_page", F.lit(False).alias("selected")), o.output, "RTL" if o.right_to_left else "LTR",
        )
        images.write_file(o.output_project, xml.encode())
    return found
