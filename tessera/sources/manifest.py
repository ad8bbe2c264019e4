"""Append-only manifests of what a resumable stage has done: the latest status of a key counts."""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.clusters import collapsed_status, failure_reason
from tessera.sources.files import read_jsonl

SCHEMA = "key string, status string, at string"


def append(path: str, entries: list[dict]) -> None:
    """Write and sync: what is recorded as done was flushed before."""
    with open(path, "a", encoding="utf-8") as f:
        for e in entries:
            f.write(json.dumps({"at": datetime.datetime.now(datetime.timezone.utc).isoformat(), **e}) + "\n")
        f.flush()
        os.fsync(f.fileno())


def read(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return read_jsonl(spark, path, StructType.fromDDL(SCHEMA)).where("key is not null")


def latest(manifest: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row a key: its last entry by time, then status."""
    by = order or ["at", "status"]
    top = manifest.groupBy("key").agg(F.max(F.struct(*by, *[c for c in manifest.columns if c not in (*by, "key")])).alias("e"))
    return top.select("key", *(F.col(f"e.{c}").alias(c) for c in by), *(F.col(f"e.{c}").alias(c) for c in manifest.columns if c not in (*by, "key")))


def pending(keys: DataFrame, key: str, manifest: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Rows whose key is not done; failed keys count as done unless they are to be tried again."""
    done = latest(manifest)
    if retry_failed:
        done = done.where("status = 'ok'")
    return keys.join(done.select(F.col("key").alias(key)), key, "left_anti")


def counts(manifest: DataFrame) -> DataFrame:
    return latest(manifest).groupBy(collapsed_status("status").alias("status")).agg(F.count("*").alias("n"))


def failures(manifest: DataFrame) -> DataFrame:
    return latest(manifest).where("status like 'failed%'").select("key", failure_reason("status").alias("reason"))
