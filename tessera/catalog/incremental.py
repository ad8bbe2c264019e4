"""Incremental stages and streams over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch, table
from tessera.streaming import incremental as I


def _delivered(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Events delivered as an append-only folder, some of them twice."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    folder = scratch(spark, "events")
    e.repartition(4).write.parquet(folder)
    e.where("event_id % 10 = 0").coalesce(1).write.mode("append").parquet(folder)
    return folder, e


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Structured Streaming: repeated deliveries dropped on their key within the watermark."""
    folder, e = _delivered(spark, sf)
    out, mark = scratch(spark, "deduped"), scratch(spark, "mark")
    unique = I.deduplicated(I.stream(spark, folder, e.schema), ["event_id"], "ts", "60 days")
    unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("ts")


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts with a watermark: the windows that are closed when the input ends."""
    folder, e = _delivered(spark, sf)
    out = scratch(spark, "daily")
    counts = I.windowed_counts(I.deduplicated(I.stream(spark, folder, e.schema), ["event_id"], "ts", "2 days"), "ts", "1 day", ["event_type"], None)
    counts.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", scratch(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def resumable_stage(spark: SparkSession, sf: str) -> DataFrame:
    """A stage run twice over a growing folder works each key once; failures are rows."""
    folder, e = _delivered(spark, sf)
    out, log, mark = scratch(spark, "out"), scratch(spark, "log"), scratch(spark, "mark")

    def work(df: DataFrame) -> DataFrame:
        return I.within_work_cap(df.dropDuplicates(["event_id"]), F.col("value"), 90)

    for _ in range(2):
        I.run_once(I.stream(spark, folder, e.schema), work, out, log, "event_id", mark).awaitTermination()
    done = spark.read.schema("key string, status string, at string").json(log)
    return done.groupBy(F.when(F.col("status") == "ok", "ok").otherwise("failed").alias("state")).agg(F.countDistinct("key").alias("n_keys"))


def guarded_work(spark: SparkSession, sf: str) -> DataFrame:
    """Failure as data: rows whose work raises keep their key and carry the error."""
    e = table(spark, sf, "events").select("event_id", "value")

    def inverse(row: dict) -> dict:
        if row["event_id"] % 7 == 0:
            raise ZeroDivisionError
        return {"event_id": row["event_id"], "doubled": float(row["value"]) * 2}

    return I.guarded(e, inverse, "event_id bigint, doubled double")


def latest_event(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return I.latest_state(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


QUERIES = {f.__name__: f for f in (stream_dedupe, stream_windows, resumable_stage, guarded_work, latest_event)}
SQL = {
    "resumable_stage": "SELECT CASE WHEN value > 90 THEN 'failed' ELSE 'ok' END AS state, count(DISTINCT event_id) AS n_keys FROM events GROUP BY 1",
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2",
    "stream_dedupe": "SELECT event_id, user_id, event_type, value FROM events",
    "guarded_work": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value * 2 END AS doubled, CASE WHEN event_id % 7 = 0 THEN 'failed:ZeroDivisionError' ELSE 'ok' END AS status FROM events",
    "latest_event": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
