"""Append-only edit log: latest-wins state, ordered renames and incremental replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import ensure_checkpoint_dir

SCHEMA = "seq bigint, op string, assembly string, token bigint, name string, old string, text string"


def comments(log: DataFrame) -> DataFrame:
    """Latest comment of each (assembly, token); an empty text deletes it. Partial maxima in the map tasks. Null seq counts as oldest."""
    last = log.where("op = 'comment'").groupBy("assembly", "token").agg(F.max(F.struct("seq", "text")).alias("x"))
    return last.select("assembly", "token", F.col("x.text").alias("text")).where("text <> ''")


def renames(log: DataFrame) -> DataFrame:
    """All renames of each (assembly, token) as rows with their place in log order."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("assembly", "token").orderBy("seq")
    return log.where("op = 'rename'").select("assembly", "token", F.row_number().over(w).alias("pos"), "old", "name")


def pending(log: DataFrame, synced: int) -> DataFrame:
    """Entries after the high-water mark."""
    return log.where(F.col("seq") > synced)


def replay(spark: SparkSession, log_dir: str, state_dir: str) -> int:
    """Take every new file of the log into the state table and return the new high-water mark.

    A file source with Trigger.AvailableNow reads what has come since the last call (its checkpoint is the cursor); each batch overwrites one
    folder of its own id, so a batch that is repeated after a failure changes nothing.
    """
    ensure_checkpoint_dir(spark)
    stream = spark.readStream.schema(SCHEMA).json(log_dir)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_dir}/log/batch={n}")
        # The batch's own mark, so that no later call reads the log for it.
        batch.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("bigint").alias("seq")).write.mode("overwrite").parquet(f"{state_dir}/marks/batch={n}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state_dir}/cursor").trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        return spark.read.parquet(f"{state_dir}/marks").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    except Exception as e:  # no file has come yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return 0
        raise


def state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The log as taken in so far, each seq once."""
    return spark.read.parquet(f"{state_dir}/log").drop("batch").dropDuplicates(["seq"])
