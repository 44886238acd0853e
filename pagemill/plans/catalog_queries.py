"""Queries over page catalogs, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry, text
from pagemill.operators import catalog, layout, updates
from pagemill.sources import derived, zones

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_base: bool = True):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (derived.SQL if with_base else "") + sql.replace("ANCHOR", str(ANCHOR))
        return f

    return keep


#: Position of a page that exists at every scale.
ANCHOR = 202
IMG = ["img_ord", "file_path", "page"]
NORMAL = r""", norm AS (SELECT * REPLACE (left_removed AND NOT (sub_pages = 2 OR (left_removed AND right_removed)) AS left_removed,
  right_removed AND NOT (sub_pages = 2 OR (left_removed AND right_removed)) AS right_removed) FROM images WHERE sub_pages IN (1, 2)),
pages AS (SELECT norm.*, CASE WHEN sub_pages = 2 THEN 1 + half WHEN left_removed THEN 2 WHEN right_removed THEN 1 ELSE 0 END AS sub_page, img_ord * 2 + half AS ord
  FROM norm, unnest(range(0, sub_pages)) AS u(half))
"""


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page_view(derived.images(spark, d))


@query("SELECT file_id, file_path, page::INT AS page FROM expanded")
def file_images(spark: SparkSession, d: str) -> DataFrame:
    return catalog.expand_files(derived.files(spark, d)).select("file_id", "file_path", F.col("page").cast("int").alias("page"))


@query(NORMAL + "SELECT img_ord, file_path, page, sub_page::INT AS sub_page, ord FROM pages")
def page_view(spark: SparkSession, d: str) -> DataFrame:
    return pages_of(spark, d).select(*IMG, "sub_page", "ord")


@query(NORMAL + "SELECT img_ord, (CASE WHEN sub_pages = 2 THEN 3 - sub_page ELSE sub_page END)::INT AS sub_page, ord FROM pages")
def page_view_right_to_left(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page_view(derived.images(spark, d), right_to_left=True).select("img_ord", "sub_page", "ord")


@query(NORMAL + "SELECT img_ord, file_path, page, 0 AS sub_page FROM norm")
def image_view(spark: SparkSession, d: str) -> DataFrame:
    return catalog.image_view(derived.images(spark, d)).select(*IMG, "sub_page")


@query("SELECT img_ord, CASE WHEN CASE WHEN img_ord % 4 IN (0, 2) THEN width * dpi_y > height * dpi_x ELSE height * dpi_x > width * dpi_y END THEN 2 ELSE 1 END AS n FROM images")
def auto_page_count(spark: SparkSession, d: str) -> DataFrame:
    n = catalog.auto_page_count(F.col("width"), F.col("height"), F.col("dpi_x"), F.col("dpi_y"), F.col("img_ord") % 4 * 90)
    return derived.images(spark, d).select("img_ord", n.alias("n"))


@query(NORMAL + "SELECT img_ord, sub_pages, left_removed, right_removed FROM norm")
def normalised_halves(spark: SparkSession, d: str) -> DataFrame:
    return catalog.normalise_halves(derived.images(spark, d)).select("img_ord", "sub_pages", "left_removed", "right_removed")


@query(NORMAL + "SELECT img_ord, CASE WHEN left_removed <> right_removed THEN 1 ELSE 2 END AS sub_pages FROM norm")
def set_layout_two_pages(spark: SparkSession, d: str) -> DataFrame:
    return catalog.set_layout(catalog.normalise_halves(derived.images(spark, d)), F.lit(2)).select("img_ord", "sub_pages")


@query(NORMAL + """, gone AS (SELECT img_ord, max((sub_page = 0)::INT) AS r0, max((sub_page = 1)::INT) AS r1, max((sub_page = 2)::INT) AS r2 FROM pages WHERE ord % 7 = 3 GROUP BY img_ord)
SELECT img_ord, (CASE WHEN coalesce(r0, 0) = 1 THEN 0 ELSE sub_pages - coalesce(r1, 0) - coalesce(r2, 0) END)::INT AS n, left_removed OR coalesce(r1, 0) = 1 AS l, right_removed OR coalesce(r2, 0) = 1 AS r
FROM norm LEFT JOIN gone USING (img_ord) WHERE n > 0""")
def remove_pages(spark: SparkSession, d: str) -> DataFrame:
    images = catalog.normalise_halves(derived.images(spark, d))
    left = catalog.remove_pages(images, catalog.page_view(images).where("ord % 7 = 3").select("img_ord", "sub_page"))
    return left.select("img_ord", F.col("sub_pages").cast("int").alias("n"), F.col("left_removed").alias("l"), F.col("right_removed").alias("r"))


@query(NORMAL + "SELECT img_ord, CASE WHEN sub_pages = 1 AND left_removed AND img_ord % 3 = 0 THEN 2 ELSE sub_pages END AS n, left_removed AND NOT (sub_pages = 1 AND img_ord % 3 = 0) AS l FROM norm")
def restore_pages(spark: SparkSession, d: str) -> DataFrame:
    images = catalog.normalise_halves(derived.images(spark, d))
    back = images.where("img_ord % 3 = 0").select("img_ord", F.lit(catalog.LEFT).alias("sub_page"))
    return catalog.restore_pages(images, back).select("img_ord", F.col("sub_pages").alias("n"), F.col("left_removed").alias("l"))


@query("""SELECT file_path, page, row_number() OVER (ORDER BY pos, img_ord) - 1 AS ord FROM (SELECT img_ord, file_path, page, img_ord::DOUBLE AS pos FROM images
UNION ALL SELECT -img_ord, '/new' || file_path, page, CASE WHEN img_ord % 50 = 10 THEN 'inf'::DOUBLE ELSE img_ord + CASE WHEN img_ord % 20 = 0 THEN -0.5 ELSE 0.5 END END FROM images WHERE img_ord % 10 = 0)""")
def insert_images(spark: SparkSession, d: str) -> DataFrame:
    images = derived.images(spark, d).select(*IMG)
    end = F.col("img_ord") % 50 == 10
    new = images.where("img_ord % 10 = 0").select((-F.col("img_ord")).alias("img_ord"), F.concat(F.lit("/new"), "file_path").alias("file_path"), "page", F.when(~end, F.col("img_ord")).alias("anchor"), (end | (F.col("img_ord") % 20 == 0)).alias("before"))
    return catalog.insert_images(images, new).select("file_path", "page", "ord")


DPI = r""", status AS (SELECT *, CASE WHEN dpi_x <= 1 THEN 'undefined' WHEN dpi_x < 150 THEN 'too_small' WHEN dpi_x > 9999 THEN 'too_large' WHEN width::DOUBLE / dpi_x * 25.4::DOUBLE > 500 THEN 'too_small_for_size' ELSE 'ok' END AS status_x,
  CASE WHEN dpi_y <= 1 THEN 'undefined' WHEN dpi_y < 150 THEN 'too_small' WHEN dpi_y > 9999 THEN 'too_large' WHEN height::DOUBLE / dpi_y * 25.4::DOUBLE > 500 THEN 'too_small_for_size' ELSE 'ok' END AS status_y FROM images)
"""


@query(DPI + "SELECT img_ord, status_x, status_y, status_x = 'ok' AND status_y = 'ok' AS dpi_ok FROM status")
def dpi_status(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_dpi_status(derived.images(spark, d)).select("img_ord", "status_x", "status_y", "dpi_ok")


@query(DPI + "SELECT width, height, count(*) AS n, min(img_ord) AS first_ord FROM status WHERE NOT (status_x = 'ok' AND status_y = 'ok') GROUP BY width, height")
def need_fixing(spark: SparkSession, d: str) -> DataFrame:
    bad = catalog.with_dpi_status(derived.images(spark, d)).where("NOT dpi_ok")
    return bad.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"), F.min("img_ord").alias("first_ord"))


@query(NORMAL + "SELECT img_ord, sub_page::INT AS sub_page FROM pages WHERE ord >= (SELECT ord FROM pages WHERE ord = ANCHOR)")
def select_followers(spark: SparkSession, d: str) -> DataFrame:
    return catalog.followers(pages_of(spark, d), F.col("ord") == ANCHOR).select("img_ord", "sub_page")


@query(NORMAL + ", dense AS (SELECT img_ord, sub_page, row_number() OVER (ORDER BY ord) - 1 AS ord, ord = ANCHOR AS base FROM pages) SELECT img_ord, sub_page::INT AS sub_page FROM dense WHERE (ord - (SELECT ord FROM dense WHERE base)) % 2 = 0")
def select_every_other(spark: SparkSession, d: str) -> DataFrame:
    dense = catalog.ordered(pages_of(spark, d).withColumn("key", F.col("ord")).drop("ord"), "key")
    return catalog.every_other(dense, F.col("key") == ANCHOR).select("img_ord", "sub_page")


@query(NORMAL + ", dense AS (SELECT img_ord, sub_page, row_number() OVER (ORDER BY ord) - 1 AS rn, ord FROM pages WHERE ord % 3 <> 2) SELECT img_ord, sub_page::INT AS sub_page FROM dense WHERE (rn - (SELECT rn FROM dense WHERE ord = ANCHOR)) % 2 = 0")
def select_every_other_of_selection(spark: SparkSession, d: str) -> DataFrame:
    chosen = pages_of(spark, d).where("ord % 3 <> 2").withColumn("key", F.col("ord")).drop("ord")
    return catalog.every_other(catalog.ordered(chosen, "key"), F.col("key") == ANCHOR).select("img_ord", "sub_page")


@query("SELECT img_ord, CASE WHEN img_ord % 6 = 2 THEN 90 ELSE 0 END AS rotation FROM images")
def apply_scope(spark: SparkSession, d: str) -> DataFrame:
    images = derived.images(spark, d).select("img_ord")
    scope = images.where("img_ord % 6 = 2").withColumn("new", F.lit(90))
    return images.join(scope, "img_ord", "left").select("img_ord", F.coalesce("new", F.lit(0)).alias("rotation"))


LAYOUT = r""", lay AS (SELECT i.img_ord, i.img_ord AS ord, CASE WHEN s.img_ord IS NULL THEN 10 ELSE margin_left END::DOUBLE AS ml, CASE WHEN s.img_ord IS NULL THEN 5 ELSE margin_top END::DOUBLE AS mt,
  CASE WHEN s.img_ord IS NULL THEN 10 ELSE margin_right END::DOUBLE AS mr, CASE WHEN s.img_ord IS NULL THEN 5 ELSE margin_bottom END::DOUBLE AS mb, coalesce(content_w, -1)::DOUBLE AS cw, coalesce(content_h, -1)::DOUBLE AS ch,
  CASE WHEN s.img_ord IS NULL THEN 'center' ELSE align_h END AS ah, CASE WHEN s.img_ord IS NULL THEN 'center' ELSE align_v END AS av FROM images i LEFT JOIN settings s USING (img_ord)),
hard AS (SELECT *, CASE WHEN cw >= 0 AND ch >= 0 THEN cw + ml + mr ELSE 0 END::DOUBLE AS hw, CASE WHEN cw >= 0 AND ch >= 0 THEN ch + mt + mb ELSE 0 END::DOUBLE AS hh, ah IS NOT NULL AND av IS NOT NULL AS al FROM lay),
agg AS (SELECT coalesce(max(hw) FILTER (al), 0) AS aw, coalesce(max(hh) FILTER (al), 0) AS ah2 FROM hard)
"""


def laid_out(spark: SparkSession, d: str) -> DataFrame:
    images = derived.images(spark, d).select("img_ord", F.col("img_ord").alias("ord"))
    return layout.with_defaults(images, derived.settings(spark, d))


@query(LAYOUT + "SELECT img_ord, ml AS margin_left, mt AS margin_top, mr AS margin_right, mb AS margin_bottom, ah AS align_h, av AS align_v FROM lay")
def params_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    return laid_out(spark, d).select("img_ord", "margin_left", "margin_top", "margin_right", "margin_bottom", "align_h", "align_v")


@query(LAYOUT + "SELECT aw AS agg_w, ah2 AS agg_h FROM agg")
def aggregate_hard_size(spark: SparkSession, d: str) -> DataFrame:
    return layout.aggregate_size(layout.hard_sizes(laid_out(spark, d)))


@query(LAYOUT + """SELECT img_ord, coalesce((SELECT max(h2.hw) FROM hard h2 WHERE h2.al AND h2.ord <> h.ord AND h2.hw >= (SELECT min(hw) FROM (SELECT hw FROM hard WHERE al ORDER BY hw DESC LIMIT 2))), 0) AS loo_w,
coalesce((SELECT max(h2.hh) FROM hard h2 WHERE h2.al AND h2.ord <> h.ord AND h2.hh >= (SELECT min(hh) FROM (SELECT hh FROM hard WHERE al ORDER BY hh DESC LIMIT 2))), 0) AS loo_h FROM hard h""")
def leave_one_out_size(spark: SparkSession, d: str) -> DataFrame:
    return layout.leave_one_out(layout.hard_sizes(laid_out(spark, d))).select("img_ord", "loo_w", "loo_h")


SOFT = LAYOUT + r""", soft AS (SELECT hard.*, aw, ah2, CASE WHEN al AND aw - hw > 0 THEN CASE ah WHEN 'left' THEN 0 WHEN 'right' THEN aw - hw ELSE (aw - hw) * 0.5 END ELSE 0 END::DOUBLE AS sl,
  CASE WHEN al AND ah2 - hh > 0 THEN CASE av WHEN 'top' THEN 0 WHEN 'bottom' THEN ah2 - hh ELSE (ah2 - hh) * 0.5 END ELSE 0 END::DOUBLE AS st FROM hard, agg),
full_ AS (SELECT *, CASE WHEN al AND aw - hw > 0 THEN aw - hw - sl ELSE 0 END::DOUBLE AS sr, CASE WHEN al AND ah2 - hh > 0 THEN ah2 - hh - st ELSE 0 END::DOUBLE AS sb FROM soft)
"""


@query(SOFT + "SELECT img_ord, sl AS soft_left, sr AS soft_right, st AS soft_top, sb AS soft_bottom FROM full_")
def soft_margins(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_sizes(laid_out(spark, d)).select("img_ord", "soft_left", "soft_right", "soft_top", "soft_bottom")


@query(SOFT + "SELECT img_ord, (hw + sl + sr) AS page_w, (hh + st + sb) AS page_h FROM full_")
def final_page_size(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: settings or defaults, aggregate over all pages, soft margins, size of each page."""
    return layout.page_sizes(laid_out(spark, d)).select("img_ord", "page_w", "page_h")


@query(LAYOUT + "SELECT (aw <> (SELECT coalesce(max(hw) FILTER (al AND img_ord % 9 <> 4), 0) FROM hard)) OR (ah2 <> (SELECT coalesce(max(hh) FILTER (al AND img_ord % 9 <> 4), 0) FROM hard)) AS changed FROM agg")
def aggregate_changed(spark: SparkSession, d: str) -> DataFrame:
    before = laid_out(spark, d)
    return layout.changed(before, before.withColumn("align_h", F.when(F.col("img_ord") % 9 != 4, F.col("align_h"))))


@query("SELECT img_ord FROM settings WHERE img_ord % 3 <> 0")
def drop_orphans(spark: SparkSession, d: str) -> DataFrame:
    return layout.drop_orphans(derived.settings(spark, d), derived.images(spark, d).where("img_ord % 3 <> 0")).select("img_ord")


@query("SELECT img_ord FROM images WHERE img_ord NOT IN (SELECT img_ord FROM settings WHERE content_w >= 0 AND content_h >= 0)")
def undefined_pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.undefined_pages(derived.images(spark, d), derived.settings(spark, d)).select("img_ord")


@query(LAYOUT + "SELECT img_ord, row_number() OVER (ORDER BY (cw < 0 OR ch < 0), CASE WHEN cw >= 0 AND ch >= 0 THEN hw END NULLS FIRST, ord) - 1 AS rank FROM hard")
def order_by_width(spark: SparkSession, d: str) -> DataFrame:
    r = layout.by_size(layout.hard_sizes(laid_out(spark, d)), "w", margins=True)
    return catalog.ordered(r, "incomplete__", "size__", "ord", name="rank").select("img_ord", "rank")


@query(LAYOUT + "SELECT img_ord, row_number() OVER (ORDER BY (cw < 0 OR ch < 0), CASE WHEN cw >= 0 AND ch >= 0 THEN ch END NULLS FIRST, ord) - 1 AS rank FROM hard")
def order_by_content_height(spark: SparkSession, d: str) -> DataFrame:
    r = layout.by_size(layout.hard_sizes(laid_out(spark, d)), "h", margins=False)
    return catalog.ordered(r, "incomplete__", "size__", "ord", name="rank").select("img_ord", "rank")


@query("SELECT img_ord, row_number() OVER (ORDER BY img_ord % 13 = 0, CASE WHEN img_ord % 4 = 3 THEN 100 ELSE img_ord % 4 END, img_ord) - 1 AS rank FROM images")
def order_by_split_type(spark: SparkSession, d: str) -> DataFrame:
    """Incomplete pages last; the automatic type (3 here) counts as 100."""
    o = F.col("img_ord")
    r = derived.images(spark, d).withColumns({"incomplete__": o % 13 == 0, "type__": F.when(o % 4 == 3, 100).otherwise(o % 4)})
    return catalog.ordered(r, "incomplete__", "type__", "img_ord", name="rank").select("img_ord", "rank")


@query("""SELECT file_name, row_number() OVER (ORDER BY key, file_name) - 1 AS rank FROM (SELECT file_name, list_transform(regexp_extract_all(file_name, '[0-9]+|[^0-9]'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN t::BIGINT ELSE 9223372036854775807 END) AS key FROM (SELECT DISTINCT file_name FROM files))""")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    names = derived.files(spark, d).select("file_name").distinct().withColumn("key", text.natural_key(F.col("file_name")))
    return catalog.ordered(names, "key", "file_name", name="rank").select("file_name", "rank")


FOLD = DPI + r"""SELECT width, height, count(*) AS n, min(img_ord) AS first_ord, CASE WHEN min(pair) = max(pair) THEN min(pair).x ELSE 0 END AS dpi_x, CASE WHEN min(pair) = max(pair) THEN min(pair).y ELSE 0 END AS dpi_y
FROM (SELECT *, {'x': CASE WHEN dpi_x <= 1 OR dpi_y <= 1 THEN 0 ELSE dpi_x END, 'y': CASE WHEN dpi_x <= 1 OR dpi_y <= 1 THEN 0 ELSE dpi_y END} AS pair FROM status WHERE %s) GROUP BY width, height"""


@query(FOLD.replace("%s", "true"))
def fold_dpi_by_size(spark: SparkSession, d: str) -> DataFrame:
    return layout.fold_metadata(catalog.with_dpi_status(derived.images(spark, d)))


@query(FOLD.replace("%s", "NOT (status_x = 'ok' AND status_y = 'ok')"))
def fold_bad_dpi_by_size(spark: SparkSession, d: str) -> DataFrame:
    return layout.fold_metadata(catalog.with_dpi_status(derived.images(spark, d)), only_bad=True)


@query(DPI + "SELECT bool_and(status_x = 'ok' AND status_y = 'ok') AS all_ok FROM status")
def all_dpis_ok(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_dpi_status(derived.images(spark, d)).agg(F.bool_and("dpi_ok").alias("all_ok"))


@query("SELECT file_path, min(img_ord) AS first_ord, count(*) AS n, string_agg(width::VARCHAR || 'x' || height::VARCHAR, ',' ORDER BY img_ord) AS sizes FROM images GROUP BY file_path")
def regroup_by_file(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("img_ord", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("s"))
    g = derived.images(spark, d).groupBy("file_path").agg(F.min("img_ord").alias("first_ord"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(one)).alias("x"))
    return g.select("file_path", "first_ord", "n", F.array_join("x.s", ",").alias("sizes"))


@query("SELECT file_path, min(file_id) AS file_id, file_name, row_number() OVER (PARTITION BY file_name ORDER BY min(file_id)) - 1 AS label FROM files GROUP BY file_path, file_name")
def disambiguation_labels(spark: SparkSession, d: str) -> DataFrame:
    one = derived.files(spark, d).groupBy("file_path", "file_name").agg(F.min("file_id").alias("file_id"))
    return layout.numbered(one, ["file_name"], "file_id", "label")


@query("""SELECT img_ord, regexp_replace(f.file_name, '\\.[^.]*$', '') || CASE WHEN f.file_id % 3 > 0 THEN '(' || (f.file_id % 3)::VARCHAR || ')' ELSE '' END || CASE WHEN page > 0 THEN '_page' || lpad(page::VARCHAR, 4, '0') ELSE '' END
|| CASE img_ord % 3 WHEN 1 THEN '_2L' WHEN 2 THEN '_1R' ELSE '' END || '.tif' AS out_name FROM images JOIN files f USING (file_id)""".replace("\\\\", "\\"))
def output_names(spark: SparkSession, d: str) -> DataFrame:
    i = derived.images(spark, d).join(derived.files(spark, d).select("file_id", "file_name"), "file_id")
    name = text.output_name(F.col("file_name"), F.col("file_id") % 3, F.col("page"), F.col("img_ord") % 3, right_to_left=True)
    return i.select("img_ord", name.alias("out_name"))


@query("SELECT file_id, coalesce(m.target, file_path) AS file_path FROM files LEFT JOIN (SELECT DISTINCT file_path AS p, '/moved' || file_path AS target FROM files WHERE file_path LIKE '/scans/Brand1/%') m ON m.p = file_path")
def relinked_paths(spark: SparkSession, d: str) -> DataFrame:
    f = derived.files(spark, d)
    moves = f.where(F.col("file_path").startswith("/scans/Brand1/")).select("file_path", F.concat(F.lit("/moved"), "file_path").alias("target")).distinct()
    return f.join(moves, "file_path", "left").select("file_id", F.coalesce("target", "file_path").alias("file_path"))


@query("SELECT file_id, CASE WHEN file_path = '/scans/Brand2' THEN '/new' WHEN file_id % 2 = 0 AND starts_with(file_path, '/scans/Brand2/') THEN '/new' || substr(file_path, 14) ELSE file_path END AS path FROM files")
def prefix_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return derived.files(spark, d).select("file_id", text.rewrite_prefix(F.col("file_path"), F.col("file_id") % 2 == 0, "/scans/Brand2", "/new").alias("path"))


@query("SELECT target, count(*) AS n FROM (SELECT DISTINCT file_path, '/flat/' || file_name AS target FROM files) GROUP BY target HAVING count(*) > 1")
def merged_targets(spark: SparkSession, d: str) -> DataFrame:
    t = derived.files(spark, d).select("file_path", F.concat(F.lit("/flat/"), "file_name").alias("target")).distinct()
    return t.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT DISTINCT dirname AS dir, file_name AS name, i.page FROM (SELECT *, regexp_replace(file_path, '/[^/]*$', '') AS dirname FROM files) f JOIN images i USING (file_id) WHERE file_id % 10 <> 3")
def foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """Directories, files and images joined by key; images of unknown files go."""
    f = derived.files(spark, d).where("file_id % 10 <> 3").withColumn("dir", F.regexp_replace("file_path", "/[^/]*$", ""))
    dirs = f.select("dir").distinct()
    return derived.images(spark, d).select("file_id", "page").join(f.select("file_id", "dir", "file_name"), "file_id").join(dirs, "dir").select("dir", F.col("file_name").alias("name"), "page").distinct()


@query("SELECT img_ord, coalesce(u.w, width) AS width, coalesce(u.x, dpi_x) AS dpi_x FROM images LEFT JOIN (SELECT file_id AS f, page AS p, width + 1 AS w, dpi_x + 10 AS x FROM images WHERE img_ord % 8 = 1) u ON u.f = file_id AND u.p = page")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """Newer metadata replaces that of the same file and page (pages keep the numbers they were given)."""
    i = derived.images(spark, d)
    new = i.where("img_ord % 8 = 1").select("file_id", "page", (F.col("width") + 1).alias("w"), (F.col("dpi_x") + 10).alias("x"))
    return i.join(new, ["file_id", "page"], "left").select("img_ord", F.coalesce("w", "width").alias("width"), F.coalesce("x", "dpi_x").alias("dpi_x"))


@query("""SELECT img_ord, CASE WHEN img_ord % 4 = 0 THEN true ELSE (img_ord % 6 = 1) END AS stale, CASE WHEN img_ord % 4 = 0 THEN (img_ord % 90)::DOUBLE
WHEN img_ord % 3 = 0 THEN (img_ord % 7)::DOUBLE WHEN img_ord % 6 = 1 THEN (img_ord % 90)::DOUBLE ELSE (img_ord % 7)::DOUBLE END AS angle FROM images""")
def stale_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Cached angles: missing for some pages, made for another rotation for others; manual ones stay."""
    o = F.col("img_ord")
    pages = derived.images(spark, d).select("img_ord", (o % 2 * 90).alias("rotation"), (o % 90).cast("double").alias("fresh"))
    params = pages.where("img_ord % 4 <> 0").select("img_ord", F.when(o % 3 == 0, "manual").otherwise("auto").alias("mode"), (F.col("rotation") + F.when(o % 6 == 1, 90).otherwise(0)).alias("stored_rotation"), (o % 7).cast("double").alias("angle"))
    s = layout.stale(pages, params, "img_ord", ["rotation"])
    return s.select("img_ord", "stale", layout.merge_params(s, "fresh", "angle").alias("angle"))


@query("SELECT img_ord, width::DOUBLE * 25.4::DOUBLE / dpi_x AS w_mm, (margin_left * dpi_x / 25.4::DOUBLE) AS m_px, floor(dpi_x / 0.0254::DOUBLE + 0.5)::INT AS dpm FROM images JOIN settings USING (img_ord) WHERE dpi_x > 1")
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    j = derived.images(spark, d).join(derived.settings(spark, d), "img_ord").where("dpi_x > 1")
    return j.select("img_ord", geometry.px_to_mm(F.col("width").cast("double"), F.col("dpi_x")).alias("w_mm"), geometry.mm_to_px(F.col("margin_left"), F.col("dpi_x")).alias("m_px"), geometry.dpm(F.col("dpi_x")).alias("dpm"))


@query("""SELECT img_ord, CASE img_ord % 4 WHEN 1 THEN height - y WHEN 2 THEN width - x WHEN 3 THEN y ELSE x END::DOUBLE AS tx, CASE img_ord % 4 WHEN 1 THEN x WHEN 2 THEN height - y WHEN 3 THEN width - x ELSE y END::DOUBLE AS ty
FROM (SELECT *, img_ord % 100 AS x, img_ord % 71 AS y FROM images)""")
def quarter_turns(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("img_ord")
    m = geometry.quarter_turn(o % 4 * 90, F.col("width"), F.col("height"))
    t = derived.images(spark, d).select("img_ord", geometry.apply(m, o % 100, o % 71).alias("p"))
    return t.select("img_ord", F.col("p.x").alias("tx"), F.col("p.y").alias("ty"))


@query("""SELECT img_ord, round(px * sqrt(1.0::DOUBLE) / 1, 6) AS w_mm FROM (SELECT img_ord, (width - 20) * (least(dpi_x, dpi_y)::DOUBLE / dpi_x) * 25.4::DOUBLE / least(dpi_x, dpi_y) AS px FROM images WHERE dpi_x > 1 AND dpi_y > 1)""")
def content_size_mm(spark: SparkSession, d: str) -> DataFrame:
    """Width in mm of a content box through the page's transform; rotations keep lengths."""
    i = derived.images(spark, d).where("dpi_x > 1 AND dpi_y > 1")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    m = geometry.page_transform(w, h, F.col("dpi_x"), F.col("dpi_y"), F.lit(0), (F.col("img_ord") % 5).cast("double"))
    size = geometry.rect_size_mm(m, F.lit(10.0), F.lit(10.0), w - 10, h - 10, F.least("dpi_x", "dpi_y"))
    return i.select("img_ord", F.round(size["w"], 6).alias("w_mm"))


@query("SELECT file_id, CASE file_id % 4 WHEN 0 THEN '/scans/a/' || file_name WHEN 1 THEN 'scans/' || file_name WHEN 2 THEN '' ELSE '/' || file_name END AS path FROM files")
def normalised_paths(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("/scans//x/../a/./"), F.lit("scans\\b\\..\\"), F.lit("a/../../"), F.lit("/x/y/../../")), (F.col("file_id") % 4 + 1).cast("int"))
    return derived.files(spark, d).select("file_id", text.normalise_path(F.concat(raw, "file_name")).alias("path"))


@query("SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'aggressive' WHEN 1 THEN 'normal' ELSE 'off' END AS level FROM files")
def parsed_levels(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("aggressive"), F.lit("sturdy"), F.lit("off")), (F.col("file_id") % 3 + 1).cast("int"))
    return derived.files(spark, d).select("file_id", text.parse_enum(raw, text.DESPECKLE_LEVELS).alias("level"))


@query(NORMAL + "SELECT img_ord, sub_page::INT AS sub_page FROM pages WHERE ord NOT IN (SELECT ord FROM pages WHERE ord % 4 = 1) AND ord IN (SELECT ord FROM pages WHERE ord % 3 = 0)")
def page_sets(spark: SparkSession, d: str) -> DataFrame:
    p = pages_of(spark, d)
    return p.join(p.where("ord % 3 = 0").select("ord"), "ord", "left_semi").join(p.where("ord % 4 = 1").select("ord"), "ord", "left_anti").select("img_ord", "sub_page")


@query(NORMAL + "SELECT img_ord, sub_page::INT AS sub_page FROM pages WHERE sub_page = 0 OR img_ord % 6 <> 0")
def exclusive_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of halves go where a whole page was written since."""
    p = pages_of(spark, d).select("img_ord", "sub_page")
    whole = derived.images(spark, d).where("img_ord % 6 = 0").select("img_ord")
    return p.where("sub_page <> 0").join(whole, "img_ord", "left_anti").unionByName(p.where("sub_page = 0"))


@query(NORMAL + "SELECT img_ord, sub_page::INT AS sub_page FROM pages WHERE sub_page <> 0 OR img_ord % 6 <> 0")
def exclusive_halves(spark: SparkSession, d: str) -> DataFrame:
    """The other way round: the output of a whole page goes where one of its halves was written since."""
    p = pages_of(spark, d).select("img_ord", "sub_page")
    halves = derived.images(spark, d).where("img_ord % 6 = 0").select("img_ord")
    return p.where("sub_page = 0").join(halves, "img_ord", "left_anti").unionByName(p.where("sub_page <> 0"))


@query(LAYOUT + "SELECT img_ord, row_number() OVER (ORDER BY (cw < 0 OR ch < 0), CASE WHEN cw >= 0 AND ch >= 0 THEN hh END NULLS FIRST, ord) - 1 AS rank FROM hard")
def order_by_height(spark: SparkSession, d: str) -> DataFrame:
    r = layout.by_size(layout.hard_sizes(laid_out(spark, d)), "h", margins=True)
    return catalog.ordered(r, "incomplete__", "size__", "ord", name="rank").select("img_ord", "rank")


@query(LAYOUT + "SELECT img_ord, row_number() OVER (ORDER BY (cw < 0 OR ch < 0), CASE WHEN cw >= 0 AND ch >= 0 THEN cw END NULLS FIRST, ord) - 1 AS rank FROM hard")
def order_by_content_width(spark: SparkSession, d: str) -> DataFrame:
    r = layout.by_size(layout.hard_sizes(laid_out(spark, d)), "w", margins=False)
    return catalog.ordered(r, "incomplete__", "size__", "ord", name="rank").select("img_ord", "rank")


@query("SELECT file_id, CASE file_id % 4 WHEN 1 THEN 'color' WHEN 2 THEN 'mixed' ELSE 'bw' END AS mode, CASE file_id % 4 WHEN 2 THEN 'auto' WHEN 3 THEN 'manual' ELSE 'off' END AS dewarping FROM files")
def parsed_modes(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("file_id") % 4 + 1).cast("int"))
    return derived.files(spark, d).select("file_id", text.parse_enum(pick("bw", "color", "mixed", "grey"), text.COLOR_MODES).alias("mode"), text.parse_enum(pick("off", "on", "auto", "manual"), text.DEWARPING_MODES).alias("dewarping"))


#: Stored split settings and actions on them, by rules on the position of an image.
KINDS = ("single_uncut", "page_plus_offcut", "two_pages")
STORED = """, stored AS (SELECT img_ord, CASE img_ord % 5 WHEN 0 THEN 'auto' WHEN 1 THEN ['single_uncut', 'page_plus_offcut', 'two_pages'][img_ord % 3 + 1] END AS layout_type, CASE WHEN img_ord % 5 IN (1, 2) THEN ['single_uncut', 'page_plus_offcut', 'two_pages'][img_ord % 3 + 1] END AS kind FROM images WHERE img_ord % 5 < 3),
action AS (SELECT img_ord, img_ord % 4 < 2 AS set_type, ['single_uncut', 'page_plus_offcut', 'two_pages'][img_ord % 7 % 3 + 1] AS layout_type, img_ord % 4 > 0 AS set_kind, ['single_uncut', 'page_plus_offcut', 'two_pages'][img_ord % 11 % 3 + 1] AS kind FROM images WHERE img_ord % 6 < 4),
merged AS (SELECT coalesce(s.img_ord, a.img_ord) AS img_ord, a.img_ord IS NOT NULL AS touched, s.layout_type AS own_type, s.kind AS own_kind,
  CASE WHEN a.set_type THEN a.layout_type ELSE s.layout_type END AS new_type, CASE WHEN a.set_kind THEN a.kind ELSE s.kind END AS new_kind FROM stored s FULL JOIN action a ON a.img_ord = s.img_ord),
judged AS (SELECT *, touched AND new_kind IS NOT NULL AND coalesce(new_type, 'two_pages') <> 'auto' AND new_kind <> coalesce(new_type, 'two_pages') AS bad FROM merged)
"""


def stored_settings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = F.col("img_ord")
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), (x % 3 + 1).cast("int"))
    i = derived.images(spark, d).select("img_ord")
    stored = i.where("img_ord % 5 < 3").select("img_ord", F.when(o % 5 == 0, "auto").when(o % 5 == 1, kind(o)).alias("layout_type"), F.when((o % 5).isin(1, 2), kind(o)).alias("kind"))
    return stored, i.where("img_ord % 6 < 4").select("img_ord", (o % 4 < 2).alias("set_type"), kind(o % 7).alias("layout_type"), (o % 4 > 0).alias("set_kind"), kind(o % 11).alias("kind"))


@query(STORED + "SELECT img_ord, new_type AS layout_type, CASE WHEN NOT bad THEN new_kind END AS kind FROM judged WHERE new_type IS NOT NULL OR (NOT bad AND new_kind IS NOT NULL)")
def updated_settings(spark: SparkSession, d: str) -> DataFrame:
    """Parameters that conflict with a page's new layout type go."""
    return updates.update(*stored_settings(spark, d), default="two_pages")


@query(STORED + "SELECT img_ord, CASE WHEN bad THEN own_type ELSE new_type END AS layout_type, CASE WHEN bad THEN own_kind ELSE new_kind END AS kind, bad AS conflict FROM judged WHERE bad OR new_type IS NOT NULL OR new_kind IS NOT NULL")
def conditionally_updated_settings(spark: SparkSession, d: str) -> DataFrame:
    """Updates that would conflict are refused and flagged."""
    return updates.conditional_update(*stored_settings(spark, d), default="two_pages")


@query(STORED + "SELECT img_ord, NULL::VARCHAR AS layout_type, kind FROM stored WHERE kind IS NULL OR kind = 'two_pages'")
def layout_type_for_all(spark: SparkSession, d: str) -> DataFrame:
    return updates.set_type_for_all(stored_settings(spark, d)[0], "two_pages")


@query("""SELECT img_ord, CASE WHEN w > 0 AND h > 0 THEN 10.0 ELSE width / 2.0::DOUBLE - 0.01::DOUBLE END::DOUBLE AS left_, CASE WHEN w > 0 AND h > 0 THEN (20 + h)::DOUBLE ELSE height / 2.0::DOUBLE + 0.01::DOUBLE END::DOUBLE AS bottom_
FROM (SELECT *, img_ord % 4 * 50 AS w, img_ord % 3 * 70 AS h FROM images)""")
def empty_content(spark: SparkSession, d: str) -> DataFrame:
    """Empty content boxes become a point in the middle of the page."""
    o = F.col("img_ord")
    page = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.col("width").cast("double").alias("right"), F.col("height").cast("double").alias("bottom"))
    box = geometry.content_or_point(F.lit(10.0), F.lit(20.0), 10.0 + o % 4 * 50, 20.0 + o % 3 * 70, page)
    return derived.images(spark, d).select("img_ord", box["left"].alias("left_"), box["bottom"].alias("bottom_"))


@query(""", q AS (SELECT img_ord, radians(img_ord % 9 - 4) AS t, width - 20 AS w, height - 30 AS h, margin_left AS ml, margin_top AS mt, margin_right AS mr, margin_bottom AS mb FROM images JOIN settings USING (img_ord))
SELECT img_ord, round(10 * cos(t) - 15 * sin(t) - ml * cos(t) + mt * sin(t), 6) AS x0, round(10 * sin(t) + 15 * cos(t) - ml * sin(t) - mt * cos(t), 6) AS y0,
round((10 + w) * cos(t) - (15 + h) * sin(t) + mr * cos(t) - mb * sin(t), 6) AS x2, round((10 + w) * sin(t) + (15 + h) * cos(t) + mr * sin(t) + mb * cos(t), 6) AS y2 FROM q""")
def page_quads(spark: SparkSession, d: str) -> DataFrame:
    """Turned content boxes with hard margins along their own sides: upper left and lower right corner."""
    i = derived.images(spark, d).join(derived.settings(spark, d), "img_ord")
    rect = F.struct(F.lit(10.0).alias("left"), F.lit(15.0).alias("top"), (F.col("width") - 10.0).alias("right"), (F.col("height") - 15.0).alias("bottom"))
    q = geometry.extend_quad(geometry.quad(geometry.rotation(F.col("img_ord") % 9 - 4, F.lit(0.0), F.lit(0.0)), rect), *[F.col(f"margin_{k}") for k in ("left", "top", "right", "bottom")])
    at = lambda k, c: F.round(F.get("q", F.lit(k))[c], 6)
    return i.select("img_ord", q.alias("q")).select("img_ord", at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(2, "x").alias("x2"), at(2, "y").alias("y2"))


@query(""", s AS (SELECT img_ord, 100 * 300.0::DOUBLE / dpi_x AS x, 50 * 300.0::DOUBLE / dpi_y AS y, width * 300.0::DOUBLE / dpi_x AS w, height * 300.0::DOUBLE / dpi_y AS h, radians(img_ord % 5) AS t FROM images WHERE dpi_x > 1 AND dpi_y > 1),
r AS (SELECT *, CASE img_ord % 4 WHEN 1 THEN h - y WHEN 2 THEN w - x WHEN 3 THEN y ELSE x END - 12 - 100 AS dx, CASE img_ord % 4 WHEN 1 THEN x WHEN 2 THEN h - y WHEN 3 THEN w - x ELSE y END - 8 - 150 AS dy FROM s)
SELECT img_ord, round((dx * cos(t) - dy * sin(t) + 100 - 5) * 2, 4) AS tx, round((dx * sin(t) + dy * cos(t) + 150 - 7) * 2, 4) AS ty FROM r""")
def affine_chain(spark: SparkSession, d: str) -> DataFrame:
    """A point through scale, quarter turn, crop, rotation, crop and scale."""
    i = derived.images(spark, d).where("dpi_x > 1 AND dpi_y > 1")
    rect = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("left", "top", "right", "bottom"), strict=True)])
    w, h, o = F.col("width").cast("double"), F.col("height").cast("double"), F.col("img_ord")
    m = geometry.chain(w, h, F.col("dpi_x"), F.col("dpi_y"), F.lit(300.0), o % 4 * 90, rect(12, 8, 212, 308), o % 5, rect(5, 7, 150, 250), F.lit(600.0))
    p = i.select("img_ord", geometry.apply(m, F.lit(100.0), F.lit(50.0)).alias("p"))
    return p.select("img_ord", F.round("p.x", 4).alias("tx"), F.round("p.y", 4).alias("ty"))


@query("""SELECT img_ord, round(CASE WHEN t < 0 THEN px * px + py * py WHEN t > 1 THEN (px - 40) * (px - 40) + (py - 30) * (py - 30) ELSE pow(px - t * 40, 2) + pow(py - t * 30, 2) END, 6)::DOUBLE AS squared,
round((py * (img_ord % 5 + 6) - px * 4) / (30.0::DOUBLE * (img_ord % 5 + 6) - 160), 6) AS met
FROM (SELECT *, (px * 40 + py * 30) / 2500.0::DOUBLE AS t FROM (SELECT img_ord, (img_ord % 100)::DOUBLE AS px, (img_ord % 37)::DOUBLE AS py FROM images))""")
def segments_and_lines(spark: SparkSession, d: str) -> DataFrame:
    """Squared distance of a point from the segment (0, 0) to (40, 30), and where that line meets one through the point."""
    o = F.col("img_ord")
    px, py = (o % 100).cast("double"), (o % 37).cast("double")
    met = geometry.line_intersection(F.lit(0.0), F.lit(0.0), F.lit(40.0), F.lit(30.0), px, py, px + o % 5 + 6, py + 4)
    return derived.images(spark, d).select("img_ord", F.round(geometry.segment_distance(px, py, F.lit(0.0), F.lit(0.0), F.lit(40.0), F.lit(30.0)), 6).alias("squared"), F.round(met, 6).alias("met"))


@query("SELECT img_ord, ((img_ord % 256) * 11 + (img_ord * 7 % 256) * 16 + (img_ord * 13 % 256) * 5) >> 5 AS gray FROM images")
def gray_of_colours(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("img_ord")
    return derived.images(spark, d).select("img_ord", geometry.to_gray(o % 256, o * 7 % 256, o * 13 % 256).alias("gray"))


@query("SELECT img_ord, img_ord % 5 < 3 AS same FROM images")
def same_polygons(spark: SparkSession, d: str) -> DataFrame:
    """A quad against itself, begun elsewhere, backwards, with a corner moved, and with a corner less."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    a, b, c, e = pt(zero, zero), pt(w, zero), pt(w, h), pt(zero, h)
    close = pt(w + 1e-6, h - 1e-6)
    o = F.col("img_ord") % 5
    other = F.when(o == 0, F.array(a, b, c, e)).when(o == 1, F.array(close, e, a, b)).when(o == 2, F.array(e, c, b, a)).when(o == 3, F.array(a, b, pt(w + 1, h), e)).otherwise(F.array(a, b, c))
    return derived.images(spark, d).select("img_ord", geometry.same_polygon(F.array(a, b, c, e), other).alias("same"))


@query("SELECT img_ord, CASE WHEN img_ord % 4 = 0 THEN 0 WHEN img_ord % 4 = 1 THEN width * height / 2.0 ELSE width * height END::DOUBLE AS area, img_ord % 4 <> 0 AS valid FROM images")
def zone_areas(spark: SparkSession, d: str) -> DataFrame:
    """Zones that are a line, a triangle, a rectangle and a rectangle drawn the other way round."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, o = F.lit(0.0), F.col("img_ord") % 4
    a, b, c, e = pt(zero, zero), pt(w, zero), pt(w, h), pt(zero, h)
    points = F.when(o == 0, F.array(a, c)).when(o == 1, F.array(a, b, c)).when(o == 2, F.array(a, b, c, e)).otherwise(F.array(e, c, b, a))
    return zones.with_area(derived.images(spark, d).select("img_ord", points.alias("points"))).select("img_ord", "area", "valid")
