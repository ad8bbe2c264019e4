"""Running totals and ranks over a whole table without a single-partition window.

The rows are range-partitioned in the wanted order, each partition is summed, the partition totals (one row a
partition, the only thing that is broadcast) become offsets, and the rest happens inside partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``sums``: the total over the rows up to and with this one.  ``order`` must be total."""
    placed = cut(df.withColumns({f"__v_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy("__part").agg(*(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("__part", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "__part").withColumns({k: F.col(f"__o_{k}") + F.sum(f"__v_{k}").over(inside) for k in sums})
    return out.drop("__part", *(f"__{x}_{k}" for k in sums for x in "vo"))


def ordinal(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1, 2, 3 ... over the whole table."""
    return running(df, order, {name: F.lit(1).cast("bigint")})


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """One row a distinct value: its rank (ties share the mean of their positions) and the number of its ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    return running(counts, [F.col(value)], {"__upto": F.col("ties")}).select(value, "ties", (F.col("__upto") - (F.col("ties") - 1) / 2.0).alias(name))
