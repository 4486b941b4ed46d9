"""Event windows, sessions and a change feed; each works on a static table and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """events with ts as an instant, as watermarks need it."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if late else e


def windows(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Count and sum of values by window and type; day is the window's first day."""
    g = timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events of a user no further apart than gap."""
    g = timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def change_feed(spark: SparkSession, folder: str, schema: str, root: str, checkpoint: str, key: str = "id"):
    """A query that upserts each batch of arriving Parquet files into a snapshot table; call processAllAvailable or awaitTermination."""
    from ..operators.dml import upsert
    from ..sources.snapshot import Snapshot

    store = Snapshot(spark, root, None)

    def merge(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        store.write(upsert(store.read(), new, key) if store.version() else new)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
