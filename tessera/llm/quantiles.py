"""Mergeable percentile summaries with a deterministic error bound, by buffer collapsing.

A summary holds sorted buffers of ``k`` values; a buffer has a weight, the number of inputs each of its values
stands for.  Two buffers of equal weight w collapse into one of weight 2w by taking every second position of
their merged order, the odd and the even positions in turn.  Such a collapse moves any rank by at most w, and
buffers only ever meet their equals (a binary tree), so the total is at most (n / 2k) * log2(n / k) ranks.  The
summary carries the sum of the moves actually made: ``rank_error`` is a proven bound, and 0 means exact.

Groups are counted first.  A group with up to ``k`` values is one exact buffer, built in the JVM.  A larger one is
dealt into leaves of about ``k`` values, which are collapsed in a tree of fan-in ``FAN``.  No task holds more than
``LARGEST`` values of a group, whatever its share of the rows: a larger group's rows are spread by leaf.  Groups with at
least ``hot_share`` of the rows (at most 1 / ``hot_share`` of them) learn their size by a broadcast, all others by a
shuffled join.

``merge`` adds summaries of days, partitions or other parts to those of the whole, and the bounds add up too.

Defined results: null keys form no group; null, NaN and infinite values are left out; ties and repeated rows
count each; a group without values gives no summary; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut

K = 2048
FAN = 32
LARGEST = 64 * K
BUFFERS = T.ArrayType(T.StructType([T.StructField("weight", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))]))


class Summary:
    """Buffers by level (weight 2**level), a rest of fewer than k unsorted values, and the rank error so far."""

    def __init__(self, k: int) -> None:
        self.k, self.error, self.flip = k, 0, 0
        self.rest: list[np.ndarray] = []
        self.full: dict[int, np.ndarray] = {}

    def add(self, values: np.ndarray) -> None:
        self.rest.append(values)
        if sum(map(len, self.rest)) >= self.k:
            values = np.concatenate(self.rest)
            whole = len(values) // self.k * self.k
            self.rest = [values[whole:]]
            for at in range(0, whole, self.k):
                self.put(0, np.sort(values[at : at + self.k]))

    def put(self, level: int, buffer: np.ndarray) -> None:
        while level in self.full:
            both = np.concatenate([self.full.pop(level), buffer])
            both.sort(kind="stable")
            buffer = both[self.flip :: 2]
            self.flip ^= 1
            self.error += 1 << level
            level += 1
        self.full[level] = buffer

    def take(self, weight: int, values: np.ndarray) -> None:
        """A buffer of another summary."""
        if weight == 1 and len(values) != self.k:
            self.add(values)
        else:
            self.put(int(weight).bit_length() - 1, values)

    def buffers(self) -> list[tuple[int, list[float]]]:
        rest = np.sort(np.concatenate(self.rest)) if self.rest else np.zeros(0)
        return [(1, rest.tolist())] * bool(len(rest)) + [(1 << level, b.tolist()) for level, b in sorted(self.full.items())]


def _finite(value: Column) -> Column:
    v = value.cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def summaries(df: DataFrame, keys: list[str], value: str, k: int = K, hot_share: float = 0.001) -> DataFrame:
    """One row a key: n, rank_error and buffers."""
    rows = df.select(*keys, _finite(F.col(value)).alias("__v")).where(" and ".join([f"`{x}` is not null" for x in keys] + ["__v is not null"]))
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    is_hot = F.col("__n") >= F.lit(max(k, hot_share * total))
    hot = F.broadcast(counts.where(is_hot))
    cold_rows = rows.join(hot.select(*keys), keys, "left_anti").join(counts.where(~is_hot), keys)
    # Rows that stay in one task are dealt as they come there; rows that are spread are dealt by their place in a checkpoint, so
    # that a task that runs again deals alike.
    deal = F.when(F.col("__n") > k, F.pmod(F.xxhash64("__v", F.monotonically_increasing_id()), F.ceil(F.col("__n") / F.lit(k)))).otherwise(F.lit(0)).cast("long")
    spread = cut(rows.join(hot, keys).unionByName(cold_rows.where(F.col("__n") > LARGEST))).withColumn("__leaf", deal)
    kept = cold_rows.where(F.col("__n") <= LARGEST).withColumn("__leaf", deal)
    leaf = [F.count("*").alias("n"), F.array_sort(F.collect_list("__v")).alias("__values"), F.first("__n").alias("__n")]
    leaves = kept.groupBy(*keys, "__leaf").agg(*leaf).unionByName(spread.groupBy(*keys, "__leaf").agg(*leaf))
    leaves = leaves.select(*keys, "__leaf", "n", F.lit(0).cast("long").alias("rank_error"), F.array(F.struct(F.lit(1).cast("long").alias("weight"), F.col("__values").alias("values"))).cast(BUFFERS).alias("buffers"), "__n")
    leaves = cut(leaves)
    small = leaves.where(F.col("__n") <= k).select(*keys, "n", "rank_error", "buffers")
    return small.unionByName(_collapse(leaves.where(F.col("__n") > k).drop("__n"), keys, k))


def _collapse(parts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Merge the parts of each key, ``FAN`` at a time, in a tree; a task never holds more than FAN summaries of a key."""
    schema = parts.schema
    most = parts.agg(F.max("__leaf")).first()[0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Summary(k)
        for buffers in pdf.sort_values("__leaf")["buffers"]:
            for b in buffers:
                s.take(b["weight"], np.asarray(b["values"], dtype=float))
        head = pdf.iloc[:1][[*keys, "__leaf"]].reset_index(drop=True)
        return head.assign(n=int(pdf["n"].sum()), rank_error=int(pdf["rank_error"].sum()) + s.error, buffers=[[{"weight": w, "values": v} for w, v in s.buffers()]])

    while most is not None:
        parts = parts.withColumn("__leaf", F.floor(F.col("__leaf") / FAN)).groupBy(*keys, "__leaf").applyInPandas(run, schema)
        if most < FAN:
            break
        most //= FAN
    return parts.select(*keys, "n", "rank_error", "buffers")


def merge(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Summaries of the whole from summaries of its parts (days, partitions, deliveries)."""
    parts = parts.where(" and ".join(f"`{x}` is not null" for x in keys)).select(*keys, "n", "rank_error", "buffers")
    counts = parts.groupBy(*keys).agg(F.sum("n").alias("__n"), F.count("*").alias("__parts"))
    large = cut(counts.where(F.col("__n") > k))
    is_small = cut(counts.where(F.col("__n") <= k).select(*keys))
    exact = parts.join(is_small, keys, "left_semi").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("rank_error").alias("rank_error"), F.array_sort(F.flatten(F.flatten(F.collect_list(F.transform("buffers", lambda b: b["values"]))))).alias("__values"))
    exact = exact.select(*keys, "n", "rank_error", F.array(F.struct(F.lit(1).cast("long").alias("weight"), F.col("__values").alias("values"))).cast(BUFFERS).alias("buffers"))
    # parts of a large key are first dealt into pieces of about FAN, so that a hot key's parts spread over tasks
    dealt = parts.join(large, keys).withColumn("__leaf", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts"))).drop("__n", "__parts")
    return exact.unionByName(_collapse(cut(dealt.select(*keys, "__leaf", "n", "rank_error", "buffers")), keys, k))


def percentiles(found: DataFrame, wanted: list[float]) -> DataFrame:
    """p<percent> columns of summaries: the smallest value with at least that share of the weight at or below it; its true rank is
    within ``rank_error`` + the largest weight of the rank asked for, given as ``rank_error``."""
    keys = [c for c in found.columns if c not in ("n", "rank_error", "buffers")]
    name = lambda q: f"p{q * 100:g}".replace(".", "_")
    one = (F.size("buffers") == 1) & (F.element_at("buffers", 1)["weight"] == 1)
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q) - F.lit(1e-9))).cast("int")
    exact = found.where(one).select(*keys, "n", "rank_error", *(F.element_at(F.element_at("buffers", 1)["values"], rank(q)).alias(name(q)) for q in wanted))
    rest = found.where(~one)
    schema = T.StructType([*(f for f in rest.schema if f.name != "buffers"), *(T.StructField(name(q), T.DoubleType()) for q in wanted)])

    def run(batches):
        for pdf in batches:
            out = {name(q): [] for q in wanted}
            errors = []
            for n, error, buffers in zip(pdf["n"], pdf["rank_error"], pdf["buffers"]):
                v = np.concatenate([np.asarray(b["values"], dtype=float) for b in buffers])
                w = np.concatenate([np.full(len(b["values"]), b["weight"]) for b in buffers])
                order = np.argsort(v, kind="stable")
                v, upto = v[order], np.cumsum(w[order])
                for q in wanted:
                    at = min(int(np.searchsorted(upto, max(1, np.ceil(n * q - 1e-9)))), len(v) - 1)
                    out[name(q)].append(v[at])
                errors.append(int(error) + int(w.max()) * (w.max() > 1))
            yield pdf.drop(columns="buffers").assign(rank_error=errors, **out)

    return exact.unionByName(rest.mapInPandas(run, schema))
