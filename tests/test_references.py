import datetime as dt
import random

from tessera.operators import references as R

DAY = dt.datetime(2024, 1, 1)
at = lambda h: None if h is None else DAY + dt.timedelta(hours=h)
PARENT, CHILD = "pdb_id string, loaded_at timestamp, deleted_at timestamp, table_name string", "id bigint, pdb_id string, loaded_at timestamp, at string"


def run(spark, parents, children):
    p = spark.createDataFrame([(k, at(a), at(b), "clash") for k, a, b in parents], PARENT)
    c = spark.createDataFrame([(i, k, at(h), "clash") for i, (k, h) in enumerate(children)], CHILD)
    return R.orphans([R.Parent("entry", p, "pdb_id")], [R.Reference("bridge", c, "pdb_id", "entry")])


def brute(parents, children):
    norm = lambda k: (k or "").strip(" ").upper() or None
    out = set()
    for i, (k, h) in enumerate(children):
        if norm(k) and not any(norm(p) == norm(k) and a is not None and h is not None and a <= h and (b is None or h < b) for p, a, b in parents):
            out.add(i)
    return out


def test_edges(spark):
    parents = [("1abc", 10, 20), (" 1ABC ", 15, None), ("2x", 5, 5), ("3x", None, None), (None, 1, None), ("", 1, None), ("4x", 30, 3)]
    children = [("1ABC", 9), ("1abc", 10), ("1abc ", 19), ("1ABC", 25), ("2X", 5), ("3x", 9), (None, 1), ("  ", 1), ("none", 7), ("1abc", None), ("4x", 31), ("4x", 10)]
    found = run(spark, parents, children)
    assert {r.row_id for r in found.collect()} == brute(parents, children) == {0, 4, 5, 8, 9, 10, 11}
    counts = R.orphan_counts(found).collect()
    assert sum(r.n_orphans for r in counts) == 7 and any(r.period is None for r in counts)


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    keys = ["a", "A ", "b", "c", "hot"]
    parents = [(rng.choice(keys), rng.choice([None, rng.randrange(400)]), rng.choice([None, rng.randrange(400)])) for _ in range(60)]
    children = [(rng.choice([*keys, *["hot"] * 6, None, "zz"]), rng.choice([None, *range(400)])) for _ in range(900)]
    children += children[:50]
    assert {r.row_id for r in run(spark, parents, children).collect()} == brute(parents, children)


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    assert {r.row_id for r in run(spark, [], [("a", 1), (None, 2)]).collect()} == {0}
    assert run(spark, [("a", 1, None)], []).count() == 0
