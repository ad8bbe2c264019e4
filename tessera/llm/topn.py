"""Top N rows of every group with a consistent tie rule, by a hot-cold split.

Exact group counts divide the groups: a group with at least ``hot_share`` of all rows is hot, and there are at most
1 / ``hot_share`` of those, so their keys can be broadcast at any size of the data.  Hot rows are sorted over the
cluster by salted ranges (group, order, salt), each range keeps its first N rows of each group, and the few
survivors are ranked.  All other groups go through an ordinary window.  The two results are united.

Defined results: rows with a null group key belong to no group and are left out; null and NaN order values come
last in either direction; ties beyond the given order are broken by all other columns, so that the same rows
come out however the data is partitioned; repeated rows count each; a group smaller than N comes out whole; an
empty table gives an empty result; a column named like the rank is kept as ``in_<rank>``; columns starting with
``__`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut

SALTS = 16


def _order(df: DataFrame, group: list[str], order: list[tuple[str, str]]) -> list[Column]:
    kinds = {f.name: f.dataType for f in df.schema}
    given = [c for c, _ in order]
    rest = [(c, "asc") for c in sorted(df.columns) if c not in given and c not in group and not isinstance(kinds[c], T.MapType)]
    out = []
    for name, direction in [*order, *rest]:
        c = F.col(f"`{name}`")
        if isinstance(kinds[name], (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last())
    return out


def top_n(df: DataFrame, group: list[str], order: list[tuple[str, str]], n: int, hot_share: float = 0.01, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in ``order`` ([(column, 'asc' | 'desc')]), with their rank."""
    if rank in df.columns:
        df = df.withColumnRenamed(rank, f"in_{rank}")
    rows = cut(df.where(" and ".join(f"`{g}` is not null" for g in group)))
    by = _order(rows, group, order)
    counts = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    hot = cut(counts.where(F.col("__n") >= F.lit(max(1.0, hot_share * rows.count()))).select(*group))

    ranked = Window.partitionBy(*group).orderBy(*by)
    cold_top = rows.join(F.broadcast(hot), group, "left_anti").withColumn(rank, F.row_number().over(ranked)).where(F.col(rank) <= n)

    salted = rows.join(F.broadcast(hot), group, "left_semi").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    ranged = salted.repartitionByRange(*(F.col(f"`{g}`") for g in group), *by, F.col("__salt")).sortWithinPartitions(*group, *by).drop("__salt")
    heads = ranged.mapInPandas(_heads(group, n), ranged.schema)
    hot_top = heads.withColumn(rank, F.row_number().over(ranked)).where(F.col(rank) <= n)
    return cold_top.unionByName(hot_top)


def _heads(group: list[str], n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first n rows of each group of a sorted partition."""
        last, taken = None, 0
        for batch in batches:
            if batch.empty:
                continue
            at = batch.groupby(group, sort=False, dropna=False).cumcount()
            keys = batch[group].itertuples(index=False, name=None)
            first = next(keys)
            carried = taken if first == last else 0
            if carried:
                at = at + carried * (batch[group] == pd.Series(first, index=group)).all(axis=1)
            last = tuple(batch[group].iloc[-1])
            taken = int(at.iloc[-1]) + 1
            yield batch[at < n]

    return run
