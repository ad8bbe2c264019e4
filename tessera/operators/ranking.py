"""Ranking, deduplication and windowed operators.  Ties always fall to an explicit order, never to arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import running
from tessera.operators.skew import key_profile
from tessera.session import attach, cut


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (keep-first; reverse the order for keep-last and latest-per-name).

    Takes any order; where key, order and payload can form a struct, ``min_by_key`` reduces a hot key before it moves."""
    ranked = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(ranked)).where("__n = 1").drop("__n")


def min_by_key(df: DataFrame, key: list[str], order: list[str], carry: list[str], largest: bool = False) -> DataFrame:
    """For each key the row with the smallest (or largest) ``order`` struct, by partial aggregation: no window, no skew."""
    pick = F.max if largest else F.min
    best = pick(F.struct(*order, *carry)).alias("__best")
    return df.groupBy(*key).agg(best).select(*key, *(F.col(f"__best.{c}").alias(c) for c in (*order, *carry)))


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    ranked = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(ranked)).where(F.col(name) <= n)


def share_of_largest(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """x / max(x) over the table for each column -> name; the maxima are one row, attached as scalars."""
    top = df.agg(*(F.max(c).alias(f"__m_{c}") for c in columns))
    out = attach(df, top)
    return out.withColumns({name: F.col(c) / F.nullif(F.col(f"__m_{c}"), F.lit(0)) for c, name in columns.items()}).drop(*(f"__m_{c}" for c in columns))


def group_size_share(df: DataFrame, key: str, name: str) -> DataFrame:
    """Size of the row's group against the largest group."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__n"))
    top = sizes.agg(F.max("__n").alias("__top"))
    return df.join(attach(sizes, top), key).withColumn(name, F.col("__n") / F.col("__top")).drop("__n", "__top")


def benjamini_hochberg(df: DataFrame, p: str, group: list[str] | None = None, name: str = "q") -> DataFrame:
    """False-discovery q-values: the running minimum of p * n / rank from the largest p down, at most 1, within each group.

    Equal p-values share their q, so everything runs on distinct (group, p) with counts, range-partitioned: ranks by
    ``prefix.running``, and the minimum over larger p-values from one minimum a (range, group).  Null p-values have a null q."""
    by = group or []
    ties = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__ties"))
    order = [F.col(c) for c in (*by, p)]
    upto = running(ties, order, {"__upto": F.col("__ties")})
    sizes = upto.groupBy(*by).agg(F.min(F.col("__upto") - F.col("__ties")).alias("__base"), F.sum("__ties").alias("__n"))
    sized = upto.join(sizes, by) if by else attach(upto, sizes)
    raw = cut(sized.withColumn("__raw", F.col(p) * F.col("__n") / (F.col("__upto") - F.col("__base"))).select(*by, p, "__raw").repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    least = raw.groupBy(*by, "__part").agg(F.min("__raw").alias("__m"))
    later = Window.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    after = least.select(*by, "__part", F.min("__m").over(later).alias("__after"))
    inside = Window.partitionBy(*by, "__part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = raw.join(after, [*by, "__part"]).select(*by, p, F.least(F.lit(1.0), F.min("__raw").over(inside), F.col("__after")).alias(name))
    return df.join(q, [*by, p], "left")


def runs(df: DataFrame, key: list[str], position: str, flag: Column, least: int = 1) -> DataFrame:
    """Stretches of consecutive positions where ``flag`` holds: begin, end and length.  One row a position, as for ``sliding_mean``."""
    on = df.where(flag).select(*key, position)
    w = Window.partitionBy(*key).orderBy(position)
    island = on.withColumn("__g", F.col(position) - F.row_number().over(w))
    out = island.groupBy(*key, "__g").agg(F.min(position).alias("run_begin"), F.max(position).alias("run_end"), F.count("*").alias("run_length"))
    return out.where(F.col("run_length") >= least).drop("__g")


def adjacent(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with the next one of its key (columns suffixed _next); the last has none and is left out."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumns({f"{c}_next": F.lead(c).over(w) for c in columns}).where(F.col(f"{columns[0]}_next").isNotNull())


def sliding_mean(df: DataFrame, key: list[str], position: str, value: str, reach: int, name: str = "mean") -> DataFrame:
    """Mean over the positions at most ``reach`` away, by position and not by row.

    Aggregate to one row a position first: then a key's window is as long as its sequence, however many rows it has."""
    w = Window.partitionBy(*key).orderBy(position).rangeBetween(-reach, reach)
    return df.withColumn(name, F.avg(value).over(w))


def neighbour_share(df: DataFrame, key: list[str], position: str, flag: Column, reach: int, name: str = "share") -> DataFrame:
    """Share of the other rows within ``reach`` positions for which ``flag`` holds; null without neighbours."""
    w = Window.partitionBy(*key).orderBy(position).rangeBetween(-reach, reach)
    one = flag.cast("int")
    return df.withColumn(name, (F.sum(one).over(w) - one) / F.nullif(F.count("*").over(w) - 1, F.lit(0)))


def furthest(df: DataFrame, key: list[str], at: list[str], row_id: str) -> DataFrame:
    """The row of each key that lies furthest from the key's centroid (smallest id of equals), with the distance."""
    centre = df.groupBy(*key).agg(*(F.avg(c).alias(f"__{c}") for c in at))
    squares = sum(((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in at), F.lit(0.0))
    away = df.join(centre, key).withColumn("distance", F.sqrt(squares)).withColumn("__near", -F.col("distance"))
    return min_by_key(away.where("distance is not null"), key, ["__near", row_id], ["distance"]).drop("__near")


def index_quantiles(df: DataFrame, value: str, wanted: list[float], key: list[str], least: int = 5) -> DataFrame:
    """The value at index min(n - 1, floor(n * q)) of the sorted group, for groups of at least ``least`` values, by distributed selection."""
    found = key_profile(df, key, value, wanted, by_index=True)
    old = [c for c in found.columns if c.startswith("q_")]
    return found.where(F.col("n_values") >= least).select(*key, F.col("n_values").alias("n"), *(F.col(c).alias(f"q{q * 100:g}") for c, q in zip(old, wanted)))


def thinned(df: DataFrame, order: list[Column], points: int) -> DataFrame:
    """Every (n / points)-th row of the whole order, the first included."""
    from tessera.operators.prefix import ordinal

    step = max(1, df.count() // points)
    return ordinal(df, order, "__i").where((F.col("__i") - 1) % F.lit(step) == 0).drop("__i")


def hash_order(seed: int, *columns: str) -> Column:
    """A reproducible shuffle: order by this."""
    return F.xxhash64(F.lit(seed), *columns)


def per_class(df: DataFrame, label: str, k: int, seed: int, row_id: str) -> DataFrame:
    """k rows of each class in hash order."""
    return top_per_key(df, [label], [hash_order(seed, row_id), F.col(row_id)], k).drop("rank")


def group_split(df: DataFrame, group: str, shares: dict[str, float], seed: int, name: str = "split") -> DataFrame:
    """Splits that never part a group: the group's hash falls into one of the shares (they sum to 1)."""
    u = F.pmod(F.xxhash64(F.lit(seed), group), F.lit(1_000_000)) / 1e6
    names = list(shares)
    out, upto = F.lit(names[-1]), 1.0
    for split in reversed(names[:-1]):
        upto -= shares[names[names.index(split) + 1]]
        out = F.when(u < upto, F.lit(split)).otherwise(out)
    return df.withColumn(name, out)


def composition_split(df: DataFrame, parts: Column, held_out: float, name: str = "split") -> DataFrame:
    """Rows by what they are composed of: all rows of one composition (its distinct parts, in whatever order) on one side of the line, and
    compositions of a single part always in train, so that every held-out part is known alone."""
    key = F.array_sort(F.array_distinct(parts))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", key)), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    return df.withColumn(name, F.when((F.size(key) > 1) & (place < held_out), F.lit("held_out")).otherwise(F.lit("train")))
