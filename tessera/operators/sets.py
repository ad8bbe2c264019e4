"""Set operations on keys and keyed labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks; a null key equals no key and stays."""
    return a.select(*key).distinct().join(b.select(*key), key, "left_anti")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def flag(df: DataFrame, members: DataFrame, key: list[str], name: str) -> DataFrame:
    """1 where the key is among ``members``, else 0."""
    marked = members.select(*key).distinct().withColumn(name, F.lit(1))
    return df.drop(name).join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys each side has and how many they share."""
    x = a.select(F.col(key).alias("k")).distinct().withColumn("a", F.lit(1))
    y = b.select(F.col(key).alias("k")).distinct().withColumn("b", F.lit(1))
    return x.join(y, "k", "full").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))


def claim(df: DataFrame, key: str, label: str, priority: list[str]) -> DataFrame:
    """Each key goes to the first label of ``priority`` that has it."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(label))
    return df.where(place > 0).groupBy(key).agg(F.min(place).alias("__p")).select(key, F.element_at(F.array(*map(F.lit, priority)), F.col("__p").cast("int")).alias(label))


def unambiguous(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with exactly one label, with it."""
    return df.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("__max")).where(F.col(label) == F.col("__max")).drop("__max")


def updated(df: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` overwritten where ``changes`` (one row a key) has a value."""
    new = changes.select(*key, *(F.col(c).alias(f"__new_{c}") for c in columns))
    out = df.join(new, key, "left")
    for c in columns:
        old: Column = F.col(c) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"__new_{c}"), old))
    return out.drop(*(f"__new_{c}" for c in columns))
