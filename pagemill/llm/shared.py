"""Shared folders, scratch tables and small helpers used by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where it is unset and driver and executors are one process (master local[...]) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


CHANGED = "the input gave other rows on a later reading; write it to a table first"


def mark(key: Column, text: Column) -> Column:
    """A hash of what a row holds, by which a later reading is known to give the same rows."""
    return F.xxhash64(key, text)


def picked(docs: DataFrame, stay: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay, with their columns as they are, whatever their names.

    stay: row (monotonically_increasing_id() in docs) and mark of each. rows: how many docs had when it was read before. Another number,
    or a row that holds something else now, raises an error.
    """
    if docs.count() != rows:
        raise RuntimeError(CHANGED)
    d = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"), mark(docs[id_col].cast("long"), docs[text_col]).alias("mark"))
    s = stay.select(F.col("row").alias("stay_row"), F.col("mark").alias("stay_mark"))
    same = F.when(F.col("mark") == F.col("stay_mark"), True).otherwise(F.raise_error(F.lit(CHANGED)).cast("boolean"))
    return d.join(s, d["row"] == s["stay_row"]).where(same).select("doc.*")


def write_atomic(uri: str, data: bytes) -> None:
    """Put a file at uri from an executor; a retried task overwrites it with equal bytes."""
    if uri.startswith("file:") or "://" not in uri:
        path = uri.removeprefix("file:")
        path = "/" + path.lstrip("/")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        with open(temp, "wb") as out:
            out.write(data)
        os.replace(temp, path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    temp = f"{path}.{uuid.uuid4().hex}"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(temp) as out:
        out.write(data)
    system.move(temp, path)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Characters of the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def without(text: Column, chars: str) -> Column:
    """text without any of these (ASCII) characters; byte searches, no regular expression."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def parts(df: DataFrame) -> int:
    """Partitions for a shuffle of all of df: the session's number, or those df is read in if there are more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
