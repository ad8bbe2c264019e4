"""Writers.  A rewrite goes to a new place first and replaces the old one only when it is whole."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ranking import first_per_key


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def rebuild(df: DataFrame, path: str, layout: list[str] | None = None) -> None:
    """Fresh table.  ``layout``: sort inside files, so that row-group statistics prune like an index."""
    out = df.sortWithinPartitions(*layout) if layout else df
    out.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in order; a missing one is null, an unknown one dropped, values cast softly."""
    return df.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """INSERT OR REPLACE: the new row of a key replaces the old; of several new ones the first by ``order`` counts."""
    tagged = [old.withColumn("__turn", F.lit(1)), new.withColumn("__turn", F.lit(0))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_per_key(rows, key, [F.col("__turn"), *(order or [])]).drop("__turn")


def upsert(df_new: DataFrame, path: str, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Upsert into a Parquet table.  The new table is written aside and takes the old one's name when it is whole, so that at every
    moment one whole table is there (under ``path``, or under ``path``.old for the moment of the change)."""
    spark = df_new.sparkSession
    path = path.rstrip("/")
    upserted(spark.read.parquet(path), df_new, key, order).write.mode("overwrite").parquet(f"{path}.new")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, now, old = (hadoop(f"{path}{end}") for end in (".new", "", ".old"))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not (fs.rename(now, old) and fs.rename(new, now)):
        raise OSError(f"{path} could not be replaced; the old table is {path}.old, the new one {path}.new")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def refresh(df: DataFrame, path: str) -> None:
    """DELETE and INSERT in one: the same input gives the same table, however often it runs."""
    df.write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str, order: list[str]) -> None:
    """A maintained table: sorted over all files, with a header."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def merge_report(path: str, sections: dict[str, dict]) -> dict:
    """A report by sections: those of this run replace their old form, all others stay."""
    try:
        with open(path, encoding="utf-8") as f:
            report = json.load(f)
    except FileNotFoundError:
        report = {}
    report |= sections
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=1, sort_keys=True)
    return report


def analyse(df: DataFrame, name: str) -> None:
    """Column statistics of a saved table for the cost-based optimiser."""
    df.write.mode("overwrite").saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
