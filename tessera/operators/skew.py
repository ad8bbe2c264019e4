"""Per-key results that a few hot keys cannot hold up.

Counts, sums and extremes are mergeable, so Spark's partial aggregation spreads a hot key over all map tasks.
Exact per-key quantiles are found by *distributed selection*: values are mapped to order-preserving 64-bit
ordinals, a histogram of the leading bits is counted per key, the bucket holding each wanted rank is found from
the (bounded) histogram, and only that bucket is counted again with the next bits (a bucket of at most ``FEW`` rows by
its values), until the bucket holds one distinct value.  What crosses the network is always (key, bucket, count); the values of a key are never
gathered.  Hot keys (at most 1 / ``hot_share`` of them, whatever the size of the data) find their buckets
through a broadcast of bounded size, all others through a shuffled join.

Defined results: a null key is left out (count it apart if needed); null and NaN values count as rows but not as
values; infinities are ordinary extreme values, in sums too (both signs add to NaN); every other value counts whole in a
sum, however small or large; -0.0 equals 0.0; a key without values has null sums and quantiles; ties
and repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

_MANTISSA = 1 << 52
DIGITS = (16, 16, 16, 16)
FEW = 2048  # rows of a bucket that are counted value by value
EXACT_BELOW = 1e15  # sizes below this are summed as decimals of 6 places, 10^16 of which cannot overflow


def ordinal(value: Column) -> Column:
    """Order-preserving 64-bit integer of a double (the IEEE bits, negatives mirrored), as a plain expression.  NaN gives null."""
    v = value.cast("double")
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    e = F.when(a < F.pow(F.lit(2.0), guess), guess - 1).when(a >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    normal = (e + 1023).cast("long") * F.lit(_MANTISSA) + ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(_MANTISSA))).cast("long")
    small = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    size = F.when(a == F.lit(float("inf")), F.lit(2047 * _MANTISSA)).when(a < F.lit(2.0**-1022), small).otherwise(normal)
    return F.when(F.isnan(v) | v.isNull(), None).when(v < 0, -size).otherwise(size)


def from_ordinal(o: Column) -> Column:
    size = F.abs(o)
    e = F.shiftright(size, 52)
    frac = (size - e * F.lit(_MANTISSA)).cast("double")
    normal = (F.lit(1.0) + frac / F.lit(float(_MANTISSA))) * F.pow(F.lit(2.0), (e - 1023).cast("double"))
    a = F.when(e == 2047, F.lit(float("inf"))).when(e == 0, frac * F.lit(2.0**-537) * F.lit(2.0**-537)).otherwise(normal)
    return F.when(o < 0, -a).otherwise(a)


def _sums(v: Column) -> list[Column]:
    """Mergeable parts of a sum: the decimal part of ordinary values, added exactly in whatever order, and what it leaves over."""
    ordinary = F.abs(v) < F.lit(EXACT_BELOW)
    exact = F.when(ordinary, v.cast("decimal(22,6)"))
    return [F.sum(exact).alias("__s"), F.sum(F.when(ordinary, v - exact.cast("double")).when(~F.isnan(v), v)).alias("__r")]


def key_profile(df: DataFrame, keys: list[str], value: str, quantiles: list[float], hot_share: float = 0.001, by_index: bool = False) -> DataFrame:
    """One row a key: n_rows, n_values, share (of all rows of ``df``, null keys included), sum_value, min_value, max_value
    and q_<percent> for each quantile q: the smallest value with at least q of the key's values at or below it, or with
    ``by_index`` the value at index min(n - 1, floor(n * q)) of the sorted values."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).withColumn("__o", ordinal(F.col("__v")))
    named = " and ".join(f"`{k}` is not null" for k in keys)
    known = rows.where(named)
    prefix = lambda done: F.shiftright("__o", 64 - done)
    extent = [F.count("*").alias("__n"), F.min("__o").alias("__lo"), F.max("__o").alias("__hi")]

    done = DIGITS[0]
    every = cut(rows.groupBy(*keys, prefix(done).alias("__b")).agg(*extent, *_sums(F.col("__v"))))
    total = every.agg(F.sum("__n")).first()[0] or 0
    hist = every.where(named)
    profile = hist.groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("__b").isNotNull(), F.col("__n"))), F.lit(0)).alias("n_values"), (F.sum("__s").cast("double") + F.sum("__r")).alias("__sum"), F.sum("__r").alias("__r"),
        F.min("__lo").alias("__min"), F.max("__hi").alias("__max"),
    )
    profile = profile.withColumn("sum_value", F.coalesce("__sum", "__r")).drop("__sum", "__r")
    profile = profile.withColumn("share", F.col("n_rows") / F.lit(float(max(total, 1))))
    found = None
    if quantiles:
        # a bracket: a key's bucket and the rank wanted inside it
        n = F.col("n_values")
        rank = lambda q: F.least(n, F.floor(n * F.lit(q)) + 1) if by_index else F.greatest(F.lit(1), F.ceil(n * F.lit(q) - F.lit(1e-9)))
        wanted = F.explode(F.array(*(F.struct(F.lit(q).alias("__q"), rank(q).cast("long").alias("__rank")) for q in quantiles)))
        hot = cut(profile.where(F.col("share") >= hot_share).select(*keys))
        open_ = _locate(hist.where("__b is not null"), profile.where("n_values > 0").select(*keys, wanted.alias("__w")).select(*keys, "__w.*"), keys)
        on = [*keys, "__p"]
        while True:
            settled = open_.where("__lo = __hi").select(*keys, "__q", F.col("__lo").alias("__o"))
            found = settled if found is None else found.unionByName(settled)
            open_ = open_.where("__lo < __hi")
            if done >= 64 or open_.isEmpty():
                break
            target = open_.select(*keys, F.col("__b").alias("__p"), (F.col("__n") <= FEW).alias("__few")).distinct()
            held = known.where("__o is not null").withColumn("__p", prefix(done))
            hot_target = F.broadcast(target.join(F.broadcast(hot), keys, "left_semi"))
            cold_target = target.join(F.broadcast(hot), keys, "left_anti")
            narrowed = held.join(hot_target, on).unionByName(held.join(F.broadcast(hot), keys, "left_anti").join(cold_target, on))
            done += DIGITS[done // 16]
            # a bucket of few rows is counted by its values at once, which settles it in this round; a larger one by the next bits
            digit = F.when(F.col("__few"), F.col("__o")).otherwise(prefix(done))
            finer = narrowed.groupBy(*on, "__few", digit.alias("__b")).agg(*extent)
            open_ = _locate(finer, open_.select(*keys, "__q", "__rank", F.col("__b").alias("__p")), on)
    out = profile
    if found is not None:
        names = {q: f"q_{q * 100:g}".replace(".", "_") for q in quantiles}
        wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("__q") == q, F.col("__o"))).alias(f"__o{i}") for i, q in enumerate(quantiles)))
        out = profile.join(wide, keys, "left").withColumns({names[q]: from_ordinal(F.col(f"__o{i}")) for i, q in enumerate(quantiles)})
        out = out.drop(*(f"__o{i}" for i in range(len(quantiles))))
    return out.withColumns({"min_value": from_ordinal(F.col("__min")), "max_value": from_ordinal(F.col("__max"))}).drop("__min", "__max")


def _locate(hist: DataFrame, ranks: DataFrame, on: list[str]) -> DataFrame:
    """For each wanted rank the bucket that holds it, with the rank inside the bucket.  A group of ``hist`` has at most 2**16 buckets."""
    w = Window.partitionBy(*on).orderBy("__b")
    below = hist.withColumn("__upto", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = ranks.join(below, on).where("__rank <= __upto and __rank > __upto - __n")
    out = hit.select(*[k for k in on if k != "__p"], "__q", (F.col("__rank") - (F.col("__upto") - F.col("__n"))).alias("__rank"), "__b", "__n", "__lo", "__hi")
    return cut(out)


def hot_keys(profile: DataFrame, share: float) -> DataFrame:
    return profile.where(F.col("share") >= F.lit(share))
