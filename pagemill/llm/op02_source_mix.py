"""Mixing sources to target weights by hash-threshold histograms.

Targets: a source gets a share of the budget by weight, at most `cap` times its size; what is cut
off goes to the others by weight. With sources ordered by cap over weight, the level that all
uncut sources share per unit of weight is found from running sums in one pass.

Choice: a document is repeated floor(target / size of its source) times, and once more if its hash
lies below the source's threshold, so a larger budget takes all that a smaller one takes. The
threshold comes from histograms: sizes summed by source and leading hash bits; the bucket in which
the running sum passes the budget is split by the next bits, and only it, until a single hash
value is left. Nothing is sorted by hash, and a source of any size is at most BUCKETS rows a task.

Null sources are a source, last in order. Null texts have size 0. Rows with equal id and text share
their hash and their fate; what a source takes misses its target by less than the rows of the one
hash value at the boundary. Sources without words have target 0. Reruns agree. An empty table gives no rows; other
columns are not looked at, and mixed() keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import WORD, table, written

WEIGHTS = (3, 1, 2)
LEVEL_BITS = 15
LEVELS = 4
#: Up to so many sources (a row of some 100 bytes each) the table of sources is broadcast; beyond, rows are shuffled by source.
BROADCAST_SOURCES = 50_000


def document_hash(key: Column, text: Column) -> Column:
    """60 bits that depend on id and text only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), text)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """source, source_size, target from source, source_size. Runs over one row a source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    by = Window.orderBy("ratio", "rank")
    w = w.withColumn("cut", F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("cut")) / F.col("rest"))
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(every)
    return w.withColumn("at", first["level"]).select("source", "source_size", F.least(F.col("most").cast("double"), F.coalesce("at", F.lit(0.0)) * F.col("weight")).alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key, text = docs[id_col], docs[text_col]
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(key.alias("doc_id"), docs[source_col].alias("source"), size.alias("size"), document_hash(key, text).alias("h__"))


def small(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def thresholds(slim: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> tuple[DataFrame, int]:
    """source, source_size, target, whole, left, prefix for each source, and how many there are. slim: source, size, h__."""
    sizes = written(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n = sizes.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets(sizes, weights, share, cap).withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = written(state.withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long")), "mix-state")

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["source"].eqNullSafe(b["source"])

    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        h = slim.select("source", "size", F.shiftright("h__", shift + LEVEL_BITS).alias("top"), F.shiftright("h__", shift).alias("bucket"))
        hist = h.groupBy("source", "top", "bucket").agg(F.sum("size").alias("n")) if level == 0 else None
        if hist is None:  # only the boundary bucket of the level before
            b = small(state.where("prefix is not null").select(F.col("source").alias("b_source"), F.col("prefix").alias("b_prefix")), n)
            h = h.join(b, h["source"].eqNullSafe(b["b_source"]) & (h["top"] == b["b_prefix"]))
            hist = h.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.select("source", "bucket", "n", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
        joined = hist.join(small(state, n), same(hist, state)).where((F.col("before") + F.col("upto")).cast("double") > F.col("left"))
        at = joined.groupBy(hist["source"]).agg(F.min(F.struct("bucket", (F.col("before") + F.col("upto") - F.col("n")).alias("below"))).alias("x"))
        at = at.select(F.col("source").alias("x_source"), "x")
        state = state.join(at, state["source"].eqNullSafe(at["x_source"]), "left").select("source", "source_size", "target", "whole", "left", F.coalesce("x.below", "before").alias("before"), F.col("x.bucket").alias("prefix"))
        state = written(state, "mix-state")

    return state, n


def copies() -> Column:
    """How often a row is taken; without a boundary everything fits."""
    below = F.col("prefix").isNull() | (F.col("h__") < F.col("prefix"))
    return (F.col("whole") + F.when(below & (F.col("left") > 0), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, a row for each row of docs."""
    slim = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    state, n = thresholds(slim, weights, share, cap)
    s = small(state.withColumnRenamed("source", "s_source"), n)
    rows = slim.join(s, slim["source"].eqNullSafe(s["s_source"]))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    slim = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    state, n = thresholds(slim, weights, share, cap)
    s = small(state.select(F.col("source").alias("s_source"), "whole", "left", "prefix"), n)
    d = docs.select(F.struct("*").alias("doc"), docs[source_col].alias("d_source"), document_hash(docs[id_col], docs[text_col]).alias("h__"))
    taken = d.join(s, d["d_source"].eqNullSafe(s["s_source"])).select("doc", copies().alias("copies")).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, [3, 1, 2][k % 3 + 1] AS weight FROM r),
c AS (SELECT *, 2 * source_size AS most, (2 * source_size)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c),
x AS (SELECT level AS lam FROM l WHERE ratio >= level ORDER BY ratio, k LIMIT 1),
g AS (SELECT source, source_size, least(most::DOUBLE, lam * weight) AS target FROM l, x),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
d AS (SELECT t.*, source_size, target, whole, target - whole * source_size AS remain,
  sum(size) OVER (PARTITION BY t.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM t JOIN f ON t.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto::DOUBLE <= remain THEN 1 ELSE 0 END))::BIGINT AS taken FROM d
"""
