"""A stream of delivered rules or units, audited as it arrives: only groups not seen before are reported.

The state is a table of fingerprints in a folder, the stream's counterpart of a baseline. Each micro-batch is written
under its number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_keys(batch: DataFrame, state: DataFrame | None, key: str) -> DataFrame:
    """``(fingerprint, copies)`` of a batch's keys that the state does not hold."""
    grouped = batch.where(F.col(key).isNotNull()).groupBy(F.sha2(key, 256).alias("fingerprint")).agg(F.count("*").alias("copies"))
    return grouped if state is None else grouped.join(state.select("fingerprint"), "fingerprint", "left_anti")


def watch_keys(stream: DataFrame, key: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep ``folder`` (batch=N) up to date with the keys first seen in each batch of ``stream``."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        state = spark.read.parquet(folder).where(F.col("batch") != number) if exists else None
        new_keys(batch, state, key).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_deliveries(stream: DataFrame, at: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Deliveries for each window and repository, with a watermark: rows later than ``late`` are left out, null times too."""
    timed = stream.where(F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp"))
    return timed.withWatermark("_at", late).groupBy(F.window("_at", width), "repo").agg(F.count("*").alias("deliveries")).select("window.start", "window.end", "repo", "deliveries")
