"""The same rows by batch and by stream: events that arrive in files, some of them twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlens.storage import fresh_path
from partlens.streaming import ingest as I


def _arrivals(spark, d):
    """Events as files in which every fifth event comes again."""
    path = fresh_path(spark, "arrivals")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    again = e.where("event_id % 5 = 0")
    e.unionByName(again).repartition(4).write.parquet(path)
    return path, e.schema


def stream_dedup_events(spark, d):
    """Events once each, though files repeat some; draining twice adds nothing."""
    path, schema = _arrivals(spark, d)
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    for _ in range(2):
        I.drain(I.once(I.arriving(spark, path, schema), "event_id", "ts", "60 days"), state, I.append_batches(out))
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


def stream_idempotent_sink(spark, d):
    """At least once in, once out: each batch adds only rows of keys that the table lacks, so repeats in other batches are left out."""
    path, schema = _arrivals(spark, d)
    out, state = fresh_path(spark, "table"), fresh_path(spark, "table-state")

    def write(batch, number: int) -> None:
        one = batch.groupBy("event_id").agg(F.min_by(F.struct("user_id", "event_type"), "ts").alias("x")).select("event_id", "x.*")
        if number:
            known = spark.read.parquet(out).where(f"batch < {number}").select("event_id")
            one = one.join(known, "event_id", "left_anti")
        one.write.mode("overwrite").parquet(f"{out}/batch={number}")

    I.drain(I.arriving(spark, path, schema, files=2), state, write)
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


def stream_hourly_counts(spark, d):
    """Counts by event-time window, in update mode: the last count of a window is what all its rows give."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    path, out, state = (fresh_path(spark, x) for x in ("windows-in", "windows", "windows-state"))
    e.repartition(3).write.parquet(path)
    counts = I.windowed_counts(I.arriving(spark, path, e.schema, files=1), "ts", "1 hour", "event_type", delay="90 days")
    counts.writeStream.outputMode("update").foreachBatch(I.append_batches(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    x = spark.read.parquet(out)
    return x.groupBy(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type").agg(F.max("n").alias("n"))


QUERIES = {f.__name__: f for f in (stream_dedup_events, stream_idempotent_sink, stream_hourly_counts)}
ORACLE_SQL = {
    "stream_dedup_events": "SELECT event_id, user_id, event_type FROM events",
    "stream_idempotent_sink": "SELECT event_id, user_id, event_type FROM events",
    "stream_hourly_counts": "SELECT strftime(ts, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
