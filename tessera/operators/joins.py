"""Joins beyond plain equality: interval overlap, distance, pairs, precedence merge, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _slots(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def overlaps(left: DataFrame, right: DataFrame, key: str, low: tuple[str, str], high: tuple[str, str], least: int = 1, width: int = 256) -> DataFrame:
    """Pairs of closed intervals of equal key that share at least ``least`` points.

    Both sides are cut into slots of ``width``, so that a hot key spreads over its slots; a pair is kept in the slot
    where its overlap begins, so it comes out once.  Columns of ``right`` must differ from those of ``left`` but for the key."""
    a = left.withColumn("__slot", _slots(F.col(low[0]), F.col(high[0]), width))
    b = right.withColumn("__slot", _slots(F.col(low[1]), F.col(high[1]), width))
    begin, end = F.greatest(low[0], low[1]), F.least(high[0], high[1])
    met = a.join(b, [key, "__slot"]).where((end - begin + 1 >= least) & (F.floor(begin / width) == F.col("__slot")))
    return met.withColumn("shared", end - begin + 1).drop("__slot")


def best_overlap(windows: DataFrame, candidates: DataFrame, key: str, low: tuple[str, str], high: tuple[str, str], score: str, window_id: list[str], least: int = 1, absent: float | None = 0.0) -> DataFrame:
    """Each window with the best score of the candidates that overlap it (``absent`` where none does) and their number.

    Give distinct windows, and candidates aggregated to one row an interval: pairs are then bounded by positions, not by rows."""
    met = overlaps(windows, candidates, key, low, high, least).groupBy(*window_id).agg(F.max(score).alias("best"), F.count("*").alias("n_overlaps"))
    out = windows.join(met, window_id, "left").withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0)))
    return out if absent is None else out.withColumn("best", F.coalesce("best", F.lit(absent)))


def no_overlap(windows: DataFrame, others: DataFrame, key: str, low: tuple[str, str], high: tuple[str, str], window_id: list[str]) -> DataFrame:
    """Windows that nothing overlaps."""
    return windows.join(overlaps(windows, others, key, low, high).select(*window_id).distinct(), window_id, "left_anti")


def within(left: DataFrame, right: DataFrame, at: tuple[list[str], list[str]], cutoff: float, group: list[str] | None = None) -> DataFrame:
    """Pairs of points at most ``cutoff`` apart (inclusive), by a grid of cells of that size; ``distance`` is added.

    Only one side is copied into the neighbouring cells.  Columns of the sides must differ, but for ``group``."""
    cell = lambda c: F.floor(F.col(c) / F.lit(cutoff))
    axes = range(len(at[0]))
    a = left.withColumns({f"__c{i}": cell(at[0][i]) for i in axes})
    b = right
    for i in axes:
        near = F.explode(F.array(*(cell(at[1][i]) + d for d in (-1, 0, 1))))
        b = b.withColumn(f"__c{i}", near)
    squares = reduce(lambda x, y: x + y, [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(*at)])
    met = a.join(b, [*(group or []), *(f"__c{i}" for i in axes)]).withColumn("distance", F.sqrt(squares))
    return met.where(F.col("distance") <= cutoff).drop(*(f"__c{i}" for i in axes))


def nearest(left: DataFrame, right: DataFrame, at: tuple[list[str], list[str]], left_id: list[str], cutoff: float, group: list[str] | None = None) -> DataFrame:
    """The smallest distance of each left point to a right point within ``cutoff``; null where there is none."""
    found = within(left, right, at, cutoff, group).groupBy(*left_id).agg(F.min("distance").alias("nearest"))
    return left.join(found, left_id, "left")


def pairs(df: DataFrame, group: list[str], order: str, label: str) -> DataFrame:
    """Unordered pairs of a bounded group's rows with different labels, the lower ``order`` first (suffixes _a and _b).

    For groups bounded by what they are (the interfaces of one ligand copy); not for keys of unknown size."""
    other = [c for c in df.columns if c not in group]
    a = df.select(*group, *(F.col(c).alias(f"{c}_a") for c in other))
    b = df.select(*group, *(F.col(c).alias(f"{c}_b") for c in other))
    return a.join(b, group).where((F.col(f"{order}_a") < F.col(f"{order}_b")) & (F.col(f"{label}_a") != F.col(f"{label}_b")))


def merge(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge of two keyed tables; a blank or null of the first gives way to the second."""
    a = first.select(key, *(F.col(c).cast("string").alias(f"__a_{c}") for c in columns))
    b = second.select(key, *(F.col(c).cast("string").alias(f"__b_{c}") for c in columns))
    return a.join(b, key, "full").select(key, *(F.coalesce(F.nullif(F.trim(f"__a_{c}"), F.lit("")), F.col(f"__b_{c}")).alias(c) for c in columns))


def chain_lookup(df: DataFrame, lookup: DataFrame, group: str, sides: tuple[str, str], list_column: str, value: str, separator: str = ",") -> DataFrame:
    """Both sides' labels (``auth/sub``; the part before ``/`` counts) resolved through a delimited list column of the group's rows."""
    each = lookup.select(group, F.explode(F.split(list_column, separator)).alias("__label"), F.col(value).alias("__value")).where("__value is not null")
    each = each.withColumn("__label", F.trim("__label")).groupBy(group, "__label").agg(F.min("__value").alias("__value"))
    for side, out in zip(sides, (f"{value}_a", f"{value}_b")):
        one = each.select(group, F.col("__label").alias(f"__{side}"), F.col("__value").alias(out))
        df = df.withColumn(f"__{side}", F.trim(F.split_part(side, F.lit("/"), F.lit(1)))).join(one, [group, f"__{side}"]).drop(f"__{side}")
    return df.where(F.col(f"{value}_a") != F.col(f"{value}_b"))


def agreement(sets: dict[str, DataFrame], key: str, least: int = 2) -> DataFrame:
    """Keys that stand in at least ``least`` of the named sets, with how many."""
    tagged = [df.select(F.col(key).alias("key"), F.lit(name).alias("source")) for name, df in sets.items()]
    return reduce(DataFrame.unionByName, tagged).where("key is not null").groupBy("key").agg(F.countDistinct("source").alias("n_sources")).where(F.col("n_sources") >= least)


def lookup_or_keep(df: DataFrame, column: str, names: DataFrame, name: str, value: str) -> DataFrame:
    """``column`` replaced by ``value`` of the matching ``name`` (smallest, if several), or kept where there is none."""
    one = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(column)).agg(F.min(value).alias("__found"))
    return df.join(one, column, "left").withColumn(column, F.coalesce("__found", column)).drop("__found")


def one_sided(pairs: DataFrame, members: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Pairs of which exactly one side is a member, with which one it is (``member_side`` a or b); an unknown side is no member."""
    held = members.where(F.col(key).isNotNull()).select(F.col(key)).distinct()
    flags = lambda side, flag: held.select(F.col(key).alias(side), F.lit(True).alias(flag))
    both = pairs.join(flags(left, "__in_a"), left, "left").join(flags(right, "__in_b"), right, "left")
    a, b = (F.coalesce(c, F.lit(False)) for c in ("__in_a", "__in_b"))
    return both.where(a != b).withColumn("member_side", F.when(a, F.lit("a")).otherwise(F.lit("b"))).drop("__in_a", "__in_b")
