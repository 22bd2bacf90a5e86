"""Event-time windows over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import ensure_checkpoint_dir


def tumbling(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum of ``value`` per window and event_type; events more than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start_at"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events at most ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start_at"), "user_id", "n")


def drained(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Result of a streaming aggregation over all that its source holds now (``Trigger.AvailableNow``), as a table in the shared checkpoint folder.

    ``complete`` keeps every window, also those that the watermark hasn't closed. The last batch replaces what earlier ones wrote, so a batch that is
    run again changes nothing; an empty source gives an empty table.
    """
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
