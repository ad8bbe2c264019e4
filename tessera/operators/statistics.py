"""Statistics as DataFrame algebra: one row in, one row out, no collected columns.

Rank statistics work on distinct values with their counts, so that billions of rows shrink in the map-side combine,
and ranks come from distributed running totals.  A statistic that is not defined is null, never NaN.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.prefix import average_ranks, running
from tessera.operators.skew import key_profile
from tessera.session import attach, cut


def _scores(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """n_pos, n_neg, auc: the chance that a positive outscores a negative, ties counting half; null with one class only."""
    counts = _scores(df, score, label).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    upto = running(counts, [F.col(score)], {"below": F.col("n")})
    won = F.sum(F.col("p") * (F.col("below") - F.col("n") / 2.0))
    out = upto.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"), won.alias("__w"))
    return out.select("n_pos", "n_neg", (F.col("__w") / F.nullif((F.col("n_pos") * F.col("n_neg")).cast("double"), F.lit(0.0))).alias("auc"))


def grouped_auc(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """auc of each group that has both classes."""
    counts = _scores(df, score, label).groupBy(group, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    # one running total over all groups in order; what stands before a group is taken off inside the group's aggregate
    upto = running(counts, [F.col(group), F.col(score)], {"below": F.col("n")})
    won = F.sum(F.col("p") * (F.col("below") - F.col("n") / 2.0)) - F.min(F.col("below") - F.col("n")) * F.sum("p")
    each = upto.groupBy(group).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), won.alias("__w"))
    return each.where("n_pos > 0 and n_neg > 0").select(group, "n_pos", "n_neg", (F.col("__w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def mean_grouped_auc(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    return grouped_auc(df, group, score, label).agg(F.count("*").alias("n_groups"), F.avg("auc").alias("mean_auc"))


def mann_whitney(df: DataFrame, score: str, label: str) -> DataFrame:
    """u (of the positives), z (tie-corrected) and the one-sided p that positives tend to be larger."""
    counts = _scores(df, score, label).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("t"))
    ranked = running(counts, [F.col(score)], {"upto": F.col("t")}).withColumn("r", F.col("upto") - (F.col("t") - 1) / 2.0)
    t = F.col("t").cast("double")
    one = ranked.agg(F.sum("p").cast("double").alias("n1"), F.sum(F.col("t") - F.col("p")).cast("double").alias("n2"), F.sum(F.col("p") * F.col("r")).alias("rs"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n1") + F.col("n2")
    one = one.withColumn("u", F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2).withColumn("var", F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    one = one.withColumn("z", (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.nullif(F.sqrt("var"), F.lit(0.0)))
    return one.select(F.col("n1").cast("bigint").alias("n_pos"), F.col("n2").cast("bigint").alias("n_neg"), "u", "z", upper_tail(F.col("z")).alias("p"))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal law.  Spark has no erfc, so Python finishes the one row of the aggregate."""
    tail = F.pandas_udf(lambda v: v.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / math.sqrt(2))), "double")
    return tail(z)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks; null for fewer than 3 pairs or a constant side."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cells = known.groupBy("x", "y").agg(F.count("*").alias("n"))  # equal pairs need joining only once
    rx, ry = average_ranks(known, "x", "rx").drop("ties"), average_ranks(known, "y", "ry").drop("ties")
    return weighted_correlation(cells.join(rx, "x").join(ry, "y"), "rx", "ry", "n", "spearman")


def weighted_correlation(df: DataFrame, x: str, y: str, w: str, name: str) -> DataFrame:
    means = df.agg(F.sum(w).alias("__n"), (F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("__mx"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("__my"))
    d = attach(df, means)
    dx, dy = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    one = d.agg(F.max("__n").alias("n"), F.sum(F.col(w) * dx * dy).alias("xy"), F.sum(F.col(w) * dx * dx).alias("xx"), F.sum(F.col(w) * dy * dy).alias("yy"))
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= 3, F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias(name))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1).alias("w")).where("not isnan(x) and not isnan(y)")
    return weighted_correlation(known, "x", "y", "w", "pearson")


def sweep(df: DataFrame, score: str, label: str, sensitivity: float = 0.0, specificity: float = 0.0) -> DataFrame:
    """Every cut (the distinct scores and 0): a row is called when its score is above 0 and at or above the cut.

    cut, tp, fp, fn, tn, sensitivity, specificity, youden and passes (both floors met)."""
    counts = _scores(df, score, label).groupBy(F.col(score).cast("double").alias("cut")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    cuts = counts.unionByName(counts.sparkSession.range(1).select(F.lit(0.0).alias("cut"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n"))).groupBy("cut").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    live = F.col("cut") > 0
    at = running(cuts, [F.col("cut").desc()], {"tp": F.when(live, F.col("p")).otherwise(0), "fp": F.when(live, F.col("n")).otherwise(0)})
    totals = counts.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    out = attach(at, totals).select("cut", "tp", "fp", (F.col("np") - F.col("tp")).alias("fn"), (F.col("nn") - F.col("fp")).alias("tn"))
    out = out.withColumn("sensitivity", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).withColumn("specificity", F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0)))
    return out.withColumn("youden", F.col("sensitivity") + F.col("specificity") - 1).withColumn("passes", (F.col("sensitivity") >= sensitivity) & (F.col("specificity") >= specificity))


def best_cut(swept: DataFrame) -> DataFrame:
    """The cut of the largest Youden index (the smallest of equals)."""
    return swept.where("youden is not null").orderBy(F.desc("youden"), "cut").limit(1)


def cut_then_test(train: DataFrame, test: DataFrame, score: str, label: str) -> DataFrame:
    """The best cut on one set, and what it and the score do on the other."""
    cut_ = best_cut(sweep(train, score, label)).select("cut")
    called = attach(_scores(test, score, label), cut_).withColumn("call", (F.col(score) > 0) & (F.col(score) >= F.col("cut")))
    table_ = called.agg(F.max("cut").alias("cut"), F.count_if(F.col("call") & (F.col(label) == 1)).alias("tp"), F.count_if(F.col("call") & (F.col(label) != 1)).alias("fp"), F.count_if(~F.col("call") & (F.col(label) == 1)).alias("fn"), F.count_if(~F.col("call") & (F.col(label) != 1)).alias("tn"))
    return attach(table_, roc_auc(test, score, label).select("auc"))


def contingency(df: DataFrame, call: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, tn."""
    return df.agg(F.count_if(call & truth).alias("tp"), F.count_if(call & ~truth).alias("fp"), F.count_if(~call & truth).alias("fn"), F.count_if(~call & ~truth).alias("tn"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall and f1 of each class (0 where undefined)."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    long = cells.select("n", "t", "p", F.explode(F.array_distinct(F.array("t", "p"))).alias("class")).where("class is not null")
    hit = (F.col("t") == F.col("class")) & (F.col("p") == F.col("class"))
    out = long.groupBy("class").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("p") == F.col("class"), F.col("n")).otherwise(0)).alias("n_predicted"), F.sum(F.when(F.col("t") == F.col("class"), F.col("n")).otherwise(0)).alias("support"))
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = out.withColumn("precision", zero(F.col("tp"), F.col("n_predicted"))).withColumn("recall", zero(F.col("tp"), F.col("support")))
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.count("*").alias("n_classes"))


def against_reference(found: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """tp, n_found, n_reference, precision and recall of two key sets."""
    a = found.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("f", F.lit(1))
    b = reference.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("r", F.lit(1))
    one = a.join(b, "k", "full").agg(F.count_if(F.col("f").isNotNull() & F.col("r").isNotNull()).alias("tp"), F.count("f").alias("n_found"), F.count("r").alias("n_reference"))
    return one.withColumn("precision", F.col("tp") / F.nullif(F.col("n_found"), F.lit(0))).withColumn("recall", F.col("tp") / F.nullif(F.col("n_reference"), F.lit(0)))


def misses(found: DataFrame, reference: DataFrame, key: str, most: int = 200) -> DataFrame:
    """The first reference keys, sorted, that were not found."""
    return reference.select(key).where(F.col(key).isNotNull()).distinct().join(found.select(key), key, "left_anti").orderBy(key).limit(most)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    moments = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    return attach(df, moments).withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}")) for c in columns}).drop(*(f"__{n}_{c}" for c in columns for n in "ms"))


def drawn(df: DataFrame, row_id: str, draws: int, size: int, of: int, seed: int) -> DataFrame:
    """Every row in every draw, with ``chosen``: exactly ``size`` of the ``of`` rows of a draw, those with the smallest hashes.

    The hash that ends a draw is found by distributed selection; no draw is sorted or gathered."""
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "draw", row_id), 11).cast("double"))
    edge = key_profile(rows.select("draw", "__h"), ["draw"], "__h", [size / of])
    last = next(c for c in edge.columns if c.startswith("q_"))
    return rows.join(F.broadcast(edge.select("draw", F.col(last).alias("__edge"))), "draw").withColumn("chosen", F.col("__h") <= F.col("__edge")).drop("__h", "__edge")


def permutation_p(df: DataFrame, value: str, label: str, draws: int, row_id: str, seed: int = 7) -> DataFrame:
    """Difference of class means, its permutation p (1 + #draws as large) / (1 + draws), and the draws' 95th percentile.

    A draw keeps the number of positives and relabels the rows by a hash.  Null with one class only."""
    rows = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(F.col(row_id).alias("id"), F.col(value).cast("double").alias("v"), (F.col(label) == 1).cast("int").alias("y"))
    one = cut(rows.agg(F.sum("y").alias("n1"), F.count("*").alias("n"), (F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))).alias("observed")))
    n1, n, observed = one.first()
    if not n1 or n1 == n:
        return one.select(F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("null_p95"))
    nulls = drawn(rows, "id", draws, n1, n, seed).groupBy("draw").agg((F.avg(F.when(F.col("chosen"), F.col("v"))) - F.avg(F.when(~F.col("chosen"), F.col("v")))).alias("d"))
    return nulls.agg(F.lit(observed).alias("observed"), ((1 + F.count_if(F.col("d") >= observed)) / F.lit(1.0 + draws)).alias("p"), F.percentile("d", F.lit(0.95)).alias("null_p95"))


@dataclass(frozen=True)
class Floor:
    """What a metric must reach; ``highest`` marks a ceiling instead."""

    value: float
    highest: bool = False


def envelope(spark: SparkSession, metrics: dict[str, tuple[float | None, Floor | None, str]]) -> DataFrame:
    """One row a metric: computed, value, floor, passes, reason.  A missing value is 'not computed' with its reason, never a guess."""
    rows: list[tuple[Any, ...]] = []
    for name, (value, floor, reason) in metrics.items():
        known = value is not None and not math.isnan(value)
        ok = None if not known or floor is None else value <= floor.value if floor.highest else value >= floor.value
        rows.append((name, known, float(value) if known else None, floor.value if floor else None, ok, None if known else reason or "no value"))
    return spark.createDataFrame(rows, "metric string, computed boolean, value double, floor double, passes boolean, reason string")


def better_round(df: DataFrame, metric: str, round_: str, value: str, lower_is_better: list[str]) -> DataFrame:
    """The best round of each metric, whichever way it points (the earliest of equals)."""
    signed = F.when(F.col(metric).isin(lower_is_better), F.col(value)).otherwise(-F.col(value))
    best = F.min(F.struct(signed.alias("s"), F.col(round_).alias("r"), F.col(value).alias("v")))
    return df.where(F.col(value).isNotNull()).groupBy(metric).agg(best.alias("b")).select(metric, F.col("b.r").alias("best_round"), F.col("b.v").alias("best_value"))


def win_rate(df: DataFrame, mode: str, chosen: str, rejected: str) -> DataFrame:
    known = df.where(F.col(chosen).isNotNull() & F.col(rejected).isNotNull())
    return known.groupBy(mode).agg(F.count("*").alias("n"), F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("win_rate"))
