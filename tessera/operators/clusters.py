"""Series of rows that bridge the same unordered pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import key_profile


def pair_series(df: DataFrame, a: str, b: str, member: str, source: str, size: str, balance: str, row_id: str) -> DataFrame:
    """One row a pair of different names: distinct members and sources, exact median size, sorted members, widest row.

    The median comes from distributed selection, so that a hot pair is never gathered in one task."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).withColumns({"name_a": F.least(a, b), "name_b": F.greatest(a, b)})
    widest = F.max(F.struct(F.col(balance), F.col(size), F.col(row_id)))
    series = rows.groupBy("name_a", "name_b").agg(F.count("*").alias("n_rows"), F.countDistinct(member).alias("n_members"), F.countDistinct(source).alias("n_sources"), widest.alias("__w"))
    median = key_profile(rows.select("name_a", "name_b", size), ["name_a", "name_b"], size, [0.5]).select("name_a", "name_b", F.col("q_50").alias("median_size"))
    return series.join(median, ["name_a", "name_b"], "left").select("name_a", "name_b", "n_rows", "n_members", "n_sources", "median_size", F.col(f"__w.{row_id}").alias("widest_id"), F.col(f"__w.{balance}").alias("widest_balance"))


def leading(series: DataFrame, most: int, least_members: int = 1) -> DataFrame:
    return series.where(F.col("n_members") >= least_members).orderBy(F.desc("n_members"), F.desc("n_sources"), "name_a", "name_b").limit(most)


def representative(df: DataFrame, key: list[str], by: list[str], carry: list[str]) -> DataFrame:
    """The row of each key with the largest ``by`` (all columns of it in turn), so that the pick is never arbitrary."""
    best = df.groupBy(*key).agg(F.max(F.struct(*by, *[c for c in carry if c not in by])).alias("__r"))
    return best.select(*key, *(F.col(f"__r.{c}").alias(c) for c in dict.fromkeys([*by, *carry])))


def collapsed_status(status: Column | str) -> Column:
    """``failed:<reason>`` counts as failed."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(F.startswith(s, F.lit("failed")), F.lit("failed")).otherwise(s)


def failure_reason(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(F.startswith(s, F.lit("failed:")), F.split_part(s, F.lit(":"), F.lit(2)))


def relaxed(df: DataFrame, criteria: dict[str, Column], give_up: list[str], order: list[Column], n: int) -> DataFrame:
    """The n rows that need the fewest criteria given up, in the order in which criteria may be given up.

    A row's level is the longest prefix of ``give_up`` it needs; rows failing a criterion outside it never come."""
    firm = [c for name, c in criteria.items() if name not in give_up]
    kept = df
    for c in firm:
        kept = kept.where(c)
    level = F.lit(0)
    for i, name in enumerate(give_up, 1):
        level = F.when(~F.coalesce(criteria[name], F.lit(False)), F.lit(i)).otherwise(level)
    return kept.withColumn("relaxed", level).orderBy("relaxed", *order).limit(n)
