"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

DataFrame expressions only. Words are lower-cased and lose their punctuation, and a text's shingles are its SHINGLE
consecutive words, hashed; so are each template's. A template of more than MOST_SHINGLES shingles is cut
into pieces of MOST_SHINGLES (or LONG_PIECE; the last ends with it), which are looked for like templates of their own; any of them
retrieves it. A template, or piece, of s shingles belongs to the scale k with 2^(k-1) < s <= 2^k; it is looked for in windows of 2 * 2^k shingles that begin every
2^k shingles, so one window holds all of it, and the Jaccard similarity of window and template is
s / 2^(k+1) or more, over a quarter. Each of BANDS bands is one value (rows = 1), the least or the
greatest under one of BANDS / 2 permutations, each as likely as J to be of a shingle of both: a window
with a template of similarity J shares a band with probability 1 - (1 - J)^BANDS, with 16 bands
99.0 % at a quarter and 99.998 % at a half. At a containment of CONTAINMENT the least similarity is 8 of 33 (98.8 %, nine
shingles), for a piece with as large a share 13 of 35 or 52 of 140 (99.9 %); a long template is missed only if all pieces are. Windows of a larger scale take their values from those of
the scale below. Templates of at most DIRECT shingles need no bands: a window is one shingle, and each of theirs retrieves them.

Three steps. A pass over the documents keeps the band values that any template has, looked up in literal sets; documents with
such hits, the few that are candidates, are written with their shingles. Their hits meet the table of template bands in an equi-join, which
names the templates of each document. Each named template is verified: the share of its shingles that the document contains, which stands
at CONTAINMENT or more. The tables of bands and templates are broadcast; they hold TEMPLATES_A_PASS templates at most, and more
templates take more passes.

Templates of fewer than SHINGLE words are one shingle of all their words, found by lookup. A template with marks (MARKS) stands only if the
document holds the marks too: they tell versions apart whose notices differ in a word. A licence whose text holds that of another
(BSD-3-Clause that of BSD-2-Clause) matches both.

Null and empty texts match nothing; repeated rows match alike; a document matches a template once. Documents without a match give no
row, an empty table gives none. Texts of any length are taken whole, and columns other than id and text are not looked at.
"""

from __future__ import annotations

import string
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.op05_url_filter import LOWER, UPPER
from pagemill.llm.op06_quality_rules import words
from pagemill.llm.shared import WORD, let, table, written

SHINGLE = 5
BANDS = 16
CONTAINMENT = 0.8
MOST_SHINGLES = 16
#: Templates of more than LONG shingles are cut into pieces of LONG_PIECE, to have fewer literals.
LONG, LONG_PIECE = 256, 64
#: Templates of so many shingles or fewer are retrieved by each shingle.
DIRECT = 8
#: Templates whose bands are looked up in one pass over the documents.
TEMPLATES_A_PASS = 500

PUNCTUATION = string.punctuation + "\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u00ab\u00bb\u2022"
HIT = "array<struct<scale:int,start:int,band:int,value:bigint>>"
RESULT = "doc_id long, template string, containment double, n_windows long"

#: (template id, text): one-line notices, headers of files, and the full texts (without copyright lines) in licenses/.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Licensed under the MIT License"),
    ("GPL-2.0-notice", "under the GNU General Public License, version 2"),
    ("GPL-3.0-notice", "under the GNU General Public License, version 3"),
    ("LGPL-2.1-notice", "under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0-notice", "under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0-notice", "under the Mozilla Public License, version 2.0"),
)
GNU = "it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
HEADERS = (
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-2.0-header", GNU.format("General Public License", 2)),
    ("GPL-3.0-header", GNU.format("General Public License", 3)),
    ("LGPL-2.1-header", GNU.format("Lesser General Public License", 2.1)),
    ("LGPL-3.0-header", GNU.format("Lesser General Public License", 3)),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
TEXTS = tuple((f"{p.stem}-text", p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("licenses").glob("*.txt")))
TEMPLATES = NOTICES + HEADERS + TEXTS

#: What a document must hold besides, SHINGLE words each or more.
MARKS = {
    "GPL-3.0": ("general public license version 3",),
    "GPL-2.0-notice": ("general public license version 2",),
    "GPL-3.0-notice": ("general public license version 3",),
    "LGPL-2.1-notice": ("general public license version 2.1",),
    "LGPL-3.0-notice": ("general public license version 3",),
    "MPL-2.0-notice": ("mozilla public license version 2.0",),
    "GPL-2.0-header": ("gnu general public license as", "either version 2 of the"),
    "GPL-3.0-header": ("gnu general public license as", "either version 3 of the"),
    "LGPL-2.1-header": ("lesser general public license as", "either version 2.1 of the"),
    "LGPL-3.0-header": ("lesser general public license as", "either version 3 of the"),
    "LGPL-2.0-text": ("gnu library general public license",),
    "LGPL-2.1-text": ("gnu lesser general public license",),
}


def normal(text: Column) -> Column:
    """Lower case, without punctuation."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER + PUNCTUATION, LOWER)


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of every `size` consecutive words, in order."""

    def of(h):
        return F.when(F.size(h) < size, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))

    return let(F.transform(words(normal(text)), lambda w: F.xxhash64(w)), of)


def pieces(s: Column) -> Column:
    """All of s, MOST_SHINGLES or LONG_PIECE at a time."""

    def cut(n: int) -> Column:
        last = F.greatest(F.size(s) - n, F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(s) / n).cast("int") - 1), lambda i: F.slice(s, F.least(i * n, last) + 1, n))

    return F.when(F.size(s) > LONG, cut(LONG_PIECE)).otherwise(cut(MOST_SHINGLES))


def scale_of(n: int) -> int:
    """The k with 2^(k-1) < n <= 2^k."""
    return (n - 1).bit_length()


def permuted(h: Column, k: int) -> Column:
    return F.transform(h, lambda x: F.xxhash64(x, F.lit(k)))


def scan(docs: DataFrame, templates=TEMPLATES, size: int = SHINGLE, bands: int = BANDS, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", marks=MARKS) -> DataFrame:
    """doc_id, template, containment, n_windows (that shared a band)."""
    spark, found = docs.sparkSession, None
    for i in range(0, len(templates), TEMPLATES_A_PASS):
        part = _scan(docs, templates[i : i + TEMPLATES_A_PASS], size, bands, containment, id_col, text_col, marks)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], RESULT) if found is None else found


def _scan(docs: DataFrame, templates, size: int, bands: int, containment: float, id_col: str, text_col: str, marks) -> DataFrame | None:
    spark = docs.sparkSession
    marked = [(a, b) for a, _ in templates for b in marks.get(a, ())]
    must = spark.createDataFrame(marked, "template string, mark string").groupBy("template").agg(F.array_distinct(F.flatten(F.collect_list(shingles(F.col("mark"), size)))).alias("must"))
    t = spark.createDataFrame([(i, str(a), b) for i, (a, b) in enumerate(templates)], "key int, template string, text string").join(F.broadcast(must), "template", "left")
    whole = F.coalesce(*[F.when(F.size(words(normal(F.col("text")))) == m, F.get(shingles(F.col("text"), m), 0)) for m in range(1, size)], F.lit(None).cast("long"))
    t = t.select("key", "template", "must", F.size(words(normal(F.col("text")))).alias("n_words"), F.array_distinct(shingles(F.col("text"), size)).alias("s"), whole.alias("whole"))
    t = written(t.where("n_words > 0"), "license-templates")

    short = t.where(F.col("n_words") < size).select("key", (-F.col("n_words")).alias("scale"), F.lit(0).alias("band"), F.col("whole").alias("value")).collect()
    pieced = t.where(F.size("s") > 0).select("key", F.explode(pieces(F.col("s"))).alias("piece"))
    values = F.flatten(F.array(*[let(permuted(F.col("piece"), k), lambda y: F.array(F.array_min(y), F.array_max(y))) for k in range(bands // 2)]))
    known = [tuple(r) for r in short]
    for r in pieced.withColumn("bands", values).collect():
        few = len(r.piece) <= DIRECT
        known += [(r.key, 0 if few else scale_of(len(r.piece)), 0 if few else k, v) for k, v in enumerate(r.piece if few else r.bands)]
    if not known:
        return None
    wanted: dict[int, dict[int, set]] = {}
    for _, scale, band, v in known:
        wanted.setdefault(scale, {}).setdefault(band, set()).add(v)
    scales = sorted(k for k in wanted if k > 0)

    def from_scale(k: int, b: Column) -> list[Column]:
        """The hits at scale k, whose block extremes are b, and those above."""
        mine = hits(b, k, wanted[k]) if k in wanted else None
        above = let(paired(b, bands), lambda b: F.concat(*from_scale(k + 1, b))) if k < scales[-1] else None
        return [x for x in (mine, above) if x is not None]

    def of(h: Column) -> Column:
        found = [places(h, 0, wanted[0][0])] if 0 in wanted else []
        if scales:
            found.append(F.when(F.size(h) > 0, let(blocks(h, 2 ** scales[0], bands), lambda b: F.concat(*from_scale(scales[0], b)))).otherwise(F.array().cast(HIT)))
        found += [places(shingles(docs[text_col], -m), m, wanted[m][0]) for m in wanted if m < 0]
        return F.struct(h.alias("h"), F.concat(*found).alias("hits"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), let(shingles(docs[text_col], size), of).alias("x"))
    candidates = written(rows.select("row", "doc_id", "x.h", "x.hits").where(F.size("hits") > 0), "license-candidates")
    table_of_bands = F.broadcast(spark.createDataFrame(known, "key int, scale int, band int, value long"))
    hit = candidates.select("row", F.explode("hits").alias("x")).select("row", "x.*")
    named = hit.join(table_of_bands, ["scale", "band", "value"]).groupBy("row", "key").agg(F.size(F.collect_set(F.struct("scale", "start"))).cast("long").alias("n_windows"))
    each = candidates.select("row", "doc_id", "h").join(named, "row").join(F.broadcast(t), "key")
    n = F.size("s")
    share = F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("h", "s")) / n.cast("double"))
    held = F.coalesce(F.size(F.array_except("must", "h")) == 0, F.lit(True))
    return each.where(held).select("doc_id", "template", share.alias("containment"), "n_windows").where(F.col("containment") >= containment)


def blocks(h: Column, step: int, bands: int) -> Column:
    """The bands' values for the blocks of `step` shingles: fields lo and hi of each permutation."""
    starts = F.sequence(F.lit(0), F.size(h) - 1, F.lit(step))

    def of(p):
        # least and greatest pass over the nulls behind the end; slice() would copy the whole array each time
        lo = F.transform(starts, lambda i: F.least(*[F.get(p, i + j) for j in range(step)]))
        hi = F.transform(starts, lambda i: F.greatest(*[F.get(p, i + j) for j in range(step)]))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.struct(*[let(permuted(h, k), of).alias(f"m{k}") for k in range(bands // 2)])


def with_next(b: Column, band: int):
    """Of block i and the one after it, the value in a band; even bands are the least values."""
    x = b[f"m{band // 2}"]["hi" if band % 2 else "lo"]
    choose = F.greatest if band % 2 else F.least
    return lambda i: choose(F.get(x, i), F.get(x, i + 1))


def paired(b: Column, bands: int) -> Column:
    """Values for blocks twice as long."""
    starts = F.sequence(F.lit(0), F.size(b["m0"]["lo"]) - 1, F.lit(2))
    of = lambda band: F.transform(starts, with_next(b, band))
    return F.struct(*[F.struct(of(2 * k).alias("lo"), of(2 * k + 1).alias("hi")).alias(f"m{k}") for k in range(bands // 2)])


def hits(b: Column, k: int, wanted: dict[int, set]) -> Column:
    """The windows (a block of 2^k shingles and the next) and bands whose values are wanted."""
    step = 2**k

    def any_band(i):
        said = F.lit(False)
        for band, values in wanted.items():
            said = said | with_next(b, band)(i).isin(list(values))
        return said

    def each_band(i):
        return F.array(*[F.struct(F.lit(k).alias("scale"), (i * step).cast("int").alias("start"), F.lit(band).alias("band"), with_next(b, band)(i).alias("value")) for band in wanted])

    found = F.filter(F.sequence(F.lit(0), F.size(b["m0"]["lo"]) - 1), any_band)
    return F.flatten(F.transform(found, each_band)).cast(HIT)


def places(h: Column, scale: int, wanted: set) -> Column:
    """The shingles that are wanted themselves."""
    at = F.filter(F.transform(h, lambda x, i: F.struct(F.lit(scale).alias("scale"), i.alias("start"), F.lit(0).alias("band"), x.alias("value"))), lambda x: x["value"].isin(list(wanted)))
    return F.coalesce(at, F.array().cast(HIT)).cast(HIT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("n_windows")


def _sql() -> str:
    """All documents against all templates, without bands."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in TEMPLATES)
    marks = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, found in MARKS.items() for b in found)
    normal = f"regexp_extract_all(translate(coalesce(text, ''), {quoted(UPPER + PUNCTUATION)}, {quoted(LOWER)}), {quoted(WORD)})"
    grams = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
    return f"""
WITH template AS (SELECT name, {normal} AS w FROM (VALUES {values}) AS v(name, text)),
mark AS (SELECT name, unnest({grams}) AS g FROM (SELECT name, {normal} AS w FROM (VALUES {marks}) AS v(name, text)) WHERE len(w) >= 5),
wanted AS (SELECT name, unnest({grams}) AS g FROM template WHERE len(w) >= 5),
size AS (SELECT name, count(*) AS n FROM wanted GROUP BY name),
doc AS (SELECT row_number() OVER () AS r, doc_id, {normal} AS w FROM documents),
gram AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM doc WHERE len(w) >= 5) JOIN (SELECT DISTINCT g FROM wanted UNION SELECT g FROM mark) USING (g)),
hit AS (SELECT r, name, count(*) AS k FROM gram JOIN wanted USING (g) GROUP BY r, name),
need AS (SELECT name, count(DISTINCT g) AS n FROM mark GROUP BY name),
has AS (SELECT r, name, count(DISTINCT g) AS n FROM gram JOIN mark USING (g) GROUP BY r, name)
SELECT doc.doc_id, hit.name AS template, hit.k::DOUBLE / size.n AS containment FROM hit JOIN size USING (name) JOIN doc USING (r)
LEFT JOIN need ON need.name = hit.name LEFT JOIN has ON has.r = hit.r AND has.name = hit.name
WHERE hit.k::DOUBLE / size.n >= {CONTAINMENT} AND (need.n IS NULL OR has.n = need.n)
"""


ORACLE_SQL = _sql()
