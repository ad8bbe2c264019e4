"""Models on pyspark.ml: group-wise cross-validation, balanced logistic regression, ridge, boosted trees."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.statistics import drawn
from tessera.session import attach, cut


def logistic(strength: float = 0.01) -> Callable:
    return lambda: LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=strength, maxIter=50)


def boosted(trees: int = 10, depth: int = 3, seed: int = 7) -> Callable:
    return lambda: GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=trees, maxDepth=depth, seed=seed)


def prepared(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Feature vector, label and weights that give both classes the same total."""
    x = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df).withColumn("__y", F.col(label).cast("double"))
    sizes = x.groupBy("__y").agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    return x.join(F.broadcast(attach(sizes, total)), "__y").withColumn("__w", F.col("__t") / (F.col("__k") * F.col("__n"))).drop("__n", "__t", "__k")


def cross_validated(df: DataFrame, features: list[str], label: str, group: str, make: Callable, folds: int = 5, seed: int = 7) -> DataFrame:
    """Every row with the prediction of a model that never saw its group."""
    data = cut(prepared(df, features, label).withColumn("__fold", F.pmod(F.xxhash64(F.lit(seed), group), F.lit(folds))))
    parts = []
    for k in range(folds):
        model = make().fit(data.where(F.col("__fold") != k))
        out = model.transform(data.where(F.col("__fold") == k))
        parts.append(out.withColumn("prediction", vector_to_array("probability")[1]).select(*df.columns, "prediction"))
    return reduce(DataFrame.unionByName, parts)


def ridge_coefficients(df: DataFrame, features: list[str], target: str, strength: float) -> DataFrame:
    x = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df.where(F.col(target).isNotNull()))
    m = LinearRegression(featuresCol="__x", labelCol=target, regParam=strength, elasticNetParam=0.0, solver="normal").fit(x)
    rows = [*zip(features, map(float, m.coefficients)), ("(intercept)", float(m.intercept))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def nested_cut(df: DataFrame, features: list[str], label: str, group: str, make: Callable, folds: int = 3) -> DataFrame:
    """Threshold chosen inside each training part, tested on the fold left out: counts summed over folds."""
    from tessera.operators import statistics as S

    data = cut(prepared(df, features, label).withColumn("__fold", F.pmod(F.xxhash64(F.lit(1), group), F.lit(folds))))
    parts = []
    for k in range(folds):
        inner = data.where(F.col("__fold") != k)
        model = make().fit(inner)
        scored = lambda d: model.transform(d).withColumn("score", vector_to_array("probability")[1]).select(F.col("__y").cast("int").alias("label"), "score")  # noqa: B023, E731
        parts.append(S.cut_then_test(scored(inner), scored(data.where(F.col("__fold") == k)), "score", "label").drop("auc", "cut"))
    return reduce(DataFrame.unionByName, parts).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))


def ablation(df: DataFrame, features: list[str], label: str, group: str, make: Callable, folds: int = 3) -> DataFrame:
    """AUC with all features and with each one left out."""
    from tessera.operators import statistics as S

    parts = []
    for gone in [None, *features]:
        kept = [f for f in features if f != gone]
        parts.append(S.roc_auc(cross_validated(df, kept, label, group, make, folds), "prediction", label).select(F.lit(gone or "(none)").alias("left_out"), "auc"))
    return reduce(DataFrame.unionByName, parts)


def matched_control(df: DataFrame, group: str, size: int, draws: int, value: str, row_id: str, seed: int = 7) -> DataFrame:
    """Means of ``draws`` hash-ordered subsamples of ``size`` rows outside the group (``group`` = 0), and the group's own percentile."""
    outside = cut(df.where(F.col(group) == 0).select(row_id, value))
    n = outside.count()
    own = df.where(F.col(group) == 1).agg(F.avg(value).alias("own"))
    if n < size or size < 1:
        return own.select("own", F.lit(None).cast("double").alias("control_mean"), F.lit(None).cast("double").alias("percentile"))
    means = drawn(outside, row_id, draws, size, n, seed).where("chosen").groupBy("draw").agg(F.avg(value).alias("m"))
    return attach(means, own).agg(F.max("own").alias("own"), F.avg("m").alias("control_mean"), F.avg((F.col("m") < F.col("own")).cast("double")).alias("percentile"))
