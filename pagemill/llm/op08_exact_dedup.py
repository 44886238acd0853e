"""Exact dedup: groups by a 128-bit content hash, confirmed by comparing bytes.

Texts are equal when they are identical without white space ([\\x20\\x09-\\x0D]). Of equal texts
the row with the most code points stays, then the smallest id (a null id comes last), then the first
in the input, so exactly one row of each group is kept. Null texts count as empty, and empty
texts are equal to each other.

Steps, DataFrame functions only:

1. Row number, id, length and SHA-256 of each normalised text are written once, without the texts.
2. Grouped by the first 128 bits, with partial sums before the shuffle: a group of any size is
   one row for each task.
3. Texts are read again for groups of two or more only, and each is compared with the text that
   its group keeps. This is an equi-join of rows with one row of each group, no aggregation
   follows it, so adaptive execution splits a hot group over tasks.
4. Members whose bytes differ (a collision) form groups of their own, by hash and bytes.

docs is read more than once and must give its rows in the same order, as files do; a group whose kept row isn't
found again, or a row to keep that holds something else, raises an error. Repeated rows are equal texts; an empty table gives no rows; other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import CHANGED, SPACES, discard, mark, picked, table, without, written


def _best():
    """The row that stays: longest, smallest id, first."""
    return F.max(F.struct(F.col("n_chars_"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus"), (-F.col("row")).alias("back")))


def grouped_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_hex: int = 32) -> tuple[DataFrame, int]:
    """(doc_id, keep_id, group_size, kept, text_sha256, row, mark: one row for each row of docs; how many there are).

    hash_hex: hexadecimal digits of the SHA-256 that make the grouping hash; 32 are 128 bits.
    row: monotonically_increasing_id() of the row in docs. mark: a hash of its id and text.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    key = docs[id_col].cast("long")
    full = docs.select(key.alias("doc_id"), F.char_length(text).cast("long").alias("n_chars_"), without(text, SPACES).alias("norm"), F.monotonically_increasing_id().alias("row"), mark(key, docs[text_col]).alias("mark"))
    full = full.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("h", F.substring("text_sha256", 1, hash_hex))
    slim = written(full.select("row", "mark", "doc_id", "n_chars_", "text_sha256"), "exact-hashes").withColumn("h", F.substring("text_sha256", 1, hash_hex))

    groups = slim.groupBy("h").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select("h", (-F.col("best.minus")).alias("keep_id"), (-F.col("best.back")).alias("keep_row"), "group_size"), "exact-groups")
    multi = groups.where("group_size > 1").select("h", "keep_row")

    members = written(full.join(multi, "h").select("h", "row", "doc_id", "n_chars_", "norm", "text_sha256", (F.col("row") == F.col("keep_row")).alias("stays")), "exact-members")
    keepers = members.where("stays").select("h", F.col("norm").alias("keep_norm"))
    # a group without the row that it keeps has changed since the first reading
    differs = F.when(F.col("keep_norm").isNull(), F.raise_error(F.lit(CHANGED)).cast("boolean")).otherwise(F.col("norm") != F.col("keep_norm"))
    compared = members.where("NOT stays").join(keepers, "h", "left").where(differs)
    strays = written(compared.select("h", "row", "doc_id", "n_chars_", "norm", "text_sha256"), "exact-collisions")
    discard(members)
    found = slim.join(groups, "h")
    if not strays.head(1):
        return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row", "mark"), slim.count()
    own = strays.groupBy("h", "norm").agg(_best().alias("best"), F.count(F.lit(1)).alias("own_size"), F.first("text_sha256").alias("text_sha256"))
    own = own.select("h", "text_sha256", (-F.col("best.minus")).alias("own_id"), (-F.col("best.back")).alias("own_row"), "own_size")
    gone = strays.groupBy("h").agg(F.count(F.lit(1)).alias("gone"))
    found = found.join(gone, "h", "left").join(own, ["h", "text_sha256"], "left")
    is_own = F.col("own_size").isNotNull()
    found = found.select(
        "doc_id",
        F.when(is_own, F.col("own_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(is_own, F.col("own_size")).otherwise(F.col("group_size") - F.coalesce(F.col("gone"), F.lit(0))).alias("group_size"),
        (F.col("row") == F.coalesce("own_row", "keep_row")).alias("kept"),
        "text_sha256",
        "row",
        "mark",
    )
    return found, slim.count()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """grouped_rows() without marks: doc_id, keep_id, group_size, kept, text_sha256, row."""
    return grouped_rows(docs, id_col, text_col, **options)[0].drop("mark")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found, rows = grouped_rows(docs, id_col, text_col, **options)
    return picked(docs, written(found.where("kept").select("row", "mark"), "exact-kept"), rows, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS rn,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
