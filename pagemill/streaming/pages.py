"""The stages over a stream of image files.

Each micro-batch's files are decoded, their stages 1 to 4 run, and the estimates appended; the page size,
which depends on all pages, is taken over the whole table of estimates after each batch, so replaying
the stream gives what one batch over all files gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.plans import stages
from pagemill.sources import images


def decoded(files: DataFrame) -> DataFrame:
    """img (a hash of the path), height, width, data, error of single-image files; what can't be decoded has an error and no data."""

    def run(batches):
        for b in batches:
            for img, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    g = np.ascontiguousarray(images.plane_of(data.as_py(), 0))
                    row = (img, *g.shape, g.tobytes(), None)
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed stream
                    row = (img, None, None, None, f"{type(e).__name__}: {e}")
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["img", "height", "width", "data", "error"])

    return files.select(F.xxhash64(F.element_at(F.split("path", "/"), -1)).alias("img"), "content").mapInArrow(run, "img long, height int, width int, data binary, error string")


def estimates_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, glob: str = "*.tif") -> StreamingQuery:
    """Append the estimates of new files to the Parquet folder `table`, each batch in a folder of its own, so a repeated
    batch replaces itself."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        stages.estimate(decoded(batch)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_sizes(spark: SparkSession, table: str, dpi: int) -> DataFrame:
    """The layout over all estimates so far."""
    return stages.laid_out(spark.read.schema(stages.ESTIMATES).parquet(table), dpi)
