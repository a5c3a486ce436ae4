"""Streams of events: windowed counts and newest rows, kept by upsert.

A file source is read to its end (availableNow). Each micro-batch appends what changed under its own
epoch folder, so a batch that is run again overwrites its folder; readers take the newest epoch of a key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import shared_dir, table


def upserted(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream of updates to its end; the newest row of each key."""
    spark, place = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/epoch={epoch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, epoch long").parquet(f"{place}/rows")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v")).select(*keys, "v.*")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parque[t]"  # as a pattern, as a stream of a single file isn't read by its plain path
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return upserted(counts.select("event_type", F.unix_timestamp("w.start").alias("start_s"), "n"), ["event_type", "start_s"])


def stream_newest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user; of equal times the largest id. Each batch is reduced before it is kept."""
    newest = events(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return upserted(newest.select("user_id", "e.event_id", "e.event_type"), ["user_id"])


QUERIES = {"stream_hourly_counts": stream_hourly_counts, "stream_newest_event": stream_newest_event}
ORACLES = {
    "stream_hourly_counts": "SELECT event_type, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start_s, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_newest_event": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1",
}
