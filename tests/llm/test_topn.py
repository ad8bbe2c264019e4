import math
import random

from tessera.llm.topn import top_n


def brute(rows, n):
    out = set()
    for g in {r[0] for r in rows if r[0] is not None}:
        key = lambda r: (r[1] is None or math.isnan(r[1]), -(r[1] or 0) if r[1] is not None and not math.isnan(r[1]) else 0, r[2] is None, r[2] or 0, r[3])
        out |= {(g, i + 1, r[3]) for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=key)[:n])}
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 5 + ["b", "c", None]), rng.choice([1.0, 2.0, 0.5, None, math.nan, round(rng.random(), 1)]), rng.choice([1, 2, 3, None]), i) for i in range(3000)]
    rows += [(f"g{i}", 1.0, 1, 9000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, s double, t int, id bigint")
    for parts in (1, 9):
        got = top_n(df.repartition(parts), ["g"], [("s", "desc"), ("t", "asc")], 3, hot_share=0.05).collect()
        assert {(r.g, r["rank"], r.id) for r in got} == brute(rows, 3)


def test_repeats_small_groups_and_empty(spark):
    same = spark.createDataFrame([("a", 1.0, "x")] * 500 + [("b", 2.0, "y")], "g string, s double, salt string")
    got = top_n(same, ["g"], [("s", "desc")], 3).collect()
    assert sorted((r.g, r["rank"]) for r in got) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    clash = top_n(same.withColumnRenamed("salt", "rank"), ["g"], [("s", "desc")], 1).collect()
    assert {(r.g, r["rank"], r.in_rank) for r in clash} == {("a", 1, "x"), ("b", 1, "y")}
    assert top_n(same.limit(0), ["g"], [("s", "desc")], 3).count() == 0
