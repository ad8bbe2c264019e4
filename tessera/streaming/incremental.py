"""Incremental stages on Structured Streaming: an append-only folder in, a deduplicated table and a manifest out.

A micro-batch writes its data before it records its keys, so a stage that dies in between does the keys again and
never loses one; the checkpoint folder remembers which files were taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.ranking import first_per_key
from tessera.session import cut


def stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100, form: str = "parquet") -> DataFrame:
    """An append-only folder as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)


def deduplicated(events: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Keep-first on the natural key; state is bounded by the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, width: str, by: list[str], late: str | None = "1 day") -> DataFrame:
    """Tumbling counts with a watermark for late rows (None: the stream has one already)."""
    marked = events.withWatermark(at, late) if late else events
    return marked.groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def run_once(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, manifest: str, key: str, checkpoint: str) -> StreamingQuery:
    """Work on what is new and stop: data first, then the keys as done or failed (column status).

    Each batch has a folder of its own under ``out`` and ``manifest``, so a batch that runs again replaces what it wrote before."""

    def batch(df: DataFrame, number: int) -> None:
        done = cut(work(df))
        done.where("status = 'ok'").write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.select(F.col(key).cast("string").alias("key"), "status", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).write.mode("overwrite").json(f"{manifest}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within_work_cap(df: DataFrame, work: Column, cap: int) -> DataFrame:
    """Rows whose work would exceed the cap are kept as failed rows and not worked on."""
    return df.withColumn("status", F.when(work > cap, F.concat(F.lit("failed:over_cap_"), work.cast("string"))).otherwise(F.lit("ok")))


def guarded(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Failure as data: ``work`` (one pandas row in, a dict out) that raises gives a row with status ``failed:<error>``."""
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    rows.append({**dict.fromkeys(names), **work(row), "status": "ok"})
                except Exception as e:  # noqa: BLE001 - the row carries its error
                    rows.append({**dict.fromkeys(names), **{k: v for k, v in row.items() if k in names}, "status": f"failed:{type(e).__name__}"})
            yield pd.DataFrame(rows, columns=[*names, "status"])

    return df.mapInPandas(run, f"{schema}, status string")


def latest_state(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The batch counterpart of the stream: one row a natural key."""
    return first_per_key(rows, key, order)
