"""Streams of entries into a dataset: each micro-batch is a generation, staged and published whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..sources.store import Dataset, append
from ..operators.access import compact
from ..scratch import written

BATCH = "stream.batch"


def publish_batches(ds: Dataset, stream: DataFrame, checkpoint: str, key: str, col: str, value: str):
    """Starts a query that appends each batch of the stream as new rows, one for each key of the batch.

    A batch that is run again after a failure is known by its number, which is published with it, and isn't
    appended twice.
    """
    def batch(df: DataFrame, number: int) -> None:
        current = ds.refresh()
        if int(current.attributes.get(f"{BATCH}:{checkpoint}", -1)) >= number:
            return
        t = written(df.select(F.col(key).alias("row"), F.col(col).cast("bigint").alias("col"), F.col(value).cast("double").alias("value")), "batch")
        keys = written(compact(t.select("row").distinct().withColumn("keep", F.lit(True)), "row"), "batch-rows")
        n = keys.count()
        if n:
            entries = t.groupBy("row", "col").agg(F.sum("value").alias("value")).join(keys, "row").select(F.col("new_row").alias("row"), "col", "value")
            obs = keys.select(F.col("new_row").alias("row"), F.col("row").cast("string").alias("barcode"), F.lit(number).cast("bigint").alias(BATCH.replace(".", "_")))
            append(current, SparseMatrix(entries, n, current.shape[1], obs), {f"{BATCH}:{checkpoint}": str(number)})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n) by tumbling windows, with a watermark for late rows; works on tables too."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
