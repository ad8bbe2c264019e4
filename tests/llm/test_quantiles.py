import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quantiles as Q

WANTED = [0.1, 0.5, 0.9, 0.99]


def rank_range(values, x):
    return np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")


def check(rows, got, k):
    for r in got:
        mine = np.sort([v for key, v in rows if key == r.g and v is not None and math.isfinite(v)])
        assert r.n == len(mine)
        for q in WANTED:
            x = r[f"p{q * 100:g}"]
            low, high = rank_range(mine, x)
            want = max(1, math.ceil(q * len(mine) - 1e-9))
            assert x in mine and low - r.rank_error < want <= high + r.rank_error, (r.g, q, low, high, want, r.rank_error)
        if len(mine) <= k:
            assert r.rank_error == 0


def data(rng, n):
    rows = []
    for key, m in (("hot", n), ("warm", n // 10), ("small", 7), ("ties", n // 5), ("none", 3), (None, 9)):
        for _ in range(m):
            v = {"ties": 4.0, "none": rng.choice([None, math.nan, math.inf])}.get(key, rng.choice([rng.gauss(0, 9), rng.random() ** 9 * 1e9, None, math.nan, -1.0]))
            rows.append((key, v))
    return rows


def test_bound_holds_and_small_groups_are_exact(spark, monkeypatch):
    monkeypatch.setattr(Q, "LARGEST", 700)  # ties (1,200 values) are spread, warm ones (600) are not
    rows = data(random.Random(1), 6000)
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit("clash")).repartition(8)
    found = Q.percentiles(Q.summaries(df, ["g"], "v", k=64, hot_share=0.2), WANTED).collect()
    assert {r.g for r in found} == {"hot", "warm", "small", "ties"}
    check(rows, found, 64)
    hot = next(r for r in found if r.g == "hot")
    assert 0 < hot.rank_error < 0.1 * hot.n


def test_parts_add_up_to_the_whole(spark):
    rows = data(random.Random(2), 3000)
    df = spark.createDataFrame([(k, i % 12, v) for i, (k, v) in enumerate(rows)], "g string, day int, v double")
    days = Q.summaries(df, ["g", "day"], "v", k=64)
    check(rows, Q.percentiles(Q.merge(days, ["g"], k=64), WANTED).collect(), 64)


def test_collapse_moves_no_rank_further_than_it_says():
    rng = np.random.default_rng(3)
    values = rng.permutation(20_000).astype(float)
    s = Q.Summary(100)
    for part in np.array_split(values, 37):
        s.add(part)
    kept = [(v, w) for w, b in s.buffers() for v in b]
    assert sum(w for _, w in kept) == 20_000
    for x in range(0, 20_000, 499):
        assert abs(sum(w for v, w in kept if v <= x) - (x + 1)) <= s.error


def test_empty(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert Q.percentiles(Q.merge(Q.summaries(empty, ["g"], "v"), ["g"]), WANTED).count() == 0
