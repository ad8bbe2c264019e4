import math
import random

from pyspark.sql import functions as F

from tessera.operators import skew


def test_ordinals_keep_order_and_come_back(spark):
    values = [-math.inf, -1e300, -2.0, -1.5, -1.0, -5e-324, 0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 0.1, 0.5, 1.0, 1.0000000000000002, 2.0, 3.0, 1023.999, 1024.0, 1e300, 1.7976931348623157e308, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("o", skew.ordinal(F.col("v"))).withColumn("back", skew.from_ordinal(F.col("o")))
    rows = df.collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.o)] == values
    assert all(r.back == r.v for r in rows) and len({r.o for r in rows}) == len(values)
    odd = spark.createDataFrame([(None,), (math.nan,), (-0.0,)], "v double").select(skew.ordinal(F.col("v")).alias("o")).collect()
    assert [r.o for r in odd] == [None, None, 0]


def test_profile_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for key, n in (("hot", 3000), ("mid", 200), ("one", 1), ("ties", 50), ("none", 4), (None, 30)):
        for _ in range(n):
            v = {"ties": 7.25, "none": rng.choice([None, math.nan])}.get(key, rng.choice([rng.gauss(0, 1e3), round(rng.random(), 2), 1e308, -1e-300, -math.inf if rng.random() < 0.02 else 3.0, None, math.nan]))
            rows.append((key, v, "x"))
    df = spark.createDataFrame(rows, "k string, v double, n_rows string").repartition(7)
    quantiles = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.k: r for r in skew.key_profile(df, ["k"], "v", quantiles, hot_share=0.3).collect()}
    assert set(got) == {"hot", "mid", "one", "ties", "none"}
    for key, r in got.items():
        mine = [v for k, v, _ in rows if k == key]
        known = sorted(v for v in mine if v is not None and not math.isnan(v))
        assert r.n_rows == len(mine) and r.n_values == len(known) and abs(r.share - len(mine) / len(rows)) < 1e-12
        for q, name in zip(quantiles, ("q_0", "q_10", "q_50", "q_99", "q_100")):
            want = known[max(1, math.ceil(len(known) * q - 1e-9)) - 1] if known else None
            assert r[name] == want, (key, q)
        assert (r.min_value, r.max_value) == ((known[0], known[-1]) if known else (None, None))
        if known and not math.isinf(known[0]) and abs(known[-1]) < 1e300:
            assert math.isclose(r.sum_value, math.fsum(known))


def test_empty_and_hot(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert skew.key_profile(empty, ["k"], "v", [0.5]).count() == 0
    df = spark.createDataFrame([("a", 1.0)] * 98 + [("b", 2.0)] * 2, "k string, v double")
    assert [r.k for r in skew.hot_keys(skew.key_profile(df, ["k"], "v", [0.5]), 0.05).collect()] == ["a"]


def test_sums_leave_no_value_out(spark):
    cases = {"tiny": [1e-7, 2e-7], "huge": [1e31, 5.0], "inf": [math.inf, 1.0], "low": [-math.inf, 1.0], "both": [math.inf, -math.inf], "mixed": [1e14, 0.25, -1e14, 1e-9], "nan": [math.nan, None], "half": [2.5, math.nan], "many": [1e16] * 100}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v double")
    got = {r.k: r.sum_value for r in skew.key_profile(df, ["k"], "v", []).collect()}
    want = {"tiny": 3e-7, "huge": 1e31, "inf": math.inf, "low": -math.inf, "mixed": 0.250000001, "half": 2.5, "many": 1e18}
    assert got["nan"] is None and math.isnan(got["both"])
    assert all(got[k] == v or math.isclose(got[k], v, rel_tol=1e-12) for k, v in want.items()), got


def test_large_buckets_are_refined(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 8)
    rng = random.Random(3)
    rows = [(k, 1 + rng.random() * 1e-3) for k, n in (("a", 4000), ("b", 5), ("c", 60)) for _ in range(n)]
    got = {r.k: (r.q_10, r.q_50) for r in skew.key_profile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.1, 0.5]).collect()}
    for k in "abc":
        v = sorted(x for key, x in rows if key == k)
        assert got[k] == tuple(v[math.ceil(len(v) * q - 1e-9) - 1] for q in (0.1, 0.5))
