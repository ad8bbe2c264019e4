import random

from pyspark.sql import functions as F

from tessera.functions import scalars, text
from tessera.operators import clusters, graph, joins, prefix, ranking, sets


def one(spark, expr, **values):
    kinds = {int: "bigint", float: "double", str: "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_formula_counts(spark):
    for formula, want in {"C51 H79 N O13": 65, "C3 H8 O3": 6, "Zn": 1, "O4 S": 5, "C34 H32 Fe N4 O4": 43, "": None, "H2 O": 1, "D2 O": 1}.items():
        assert one(spark, scalars.heavy_atoms(F.col("f")), f=formula) == want, formula
    assert one(spark, scalars.single_element(F.col("f")), f="Zn") == "ZN" and one(spark, scalars.single_element(F.col("f")), f="C2 H6") is None


def test_balance(spark):
    for a, b, want in ((100.0, 100.0, 1.0), (50.0, 100.0, 0.5), (100.0, 50.0, 0.5), (0.0, 100.0, 0.0), (-5.0, 100.0, 0.0)):
        assert one(spark, scalars.balance(F.col("a"), F.col("b")), a=a, b=b) == want


def test_motifs_and_text(spark):
    core = "C" + "AA" + "C" + "T" * 12 + "H" + "LLL" + "H"
    seq = "MK" + core + "GG" + core
    found = one(spark, scalars.motif_positions(F.col("s"), "C.{2,4}C.{10,14}H.{3,5}H"), s=seq)
    assert [(m["start"], seq[m["start"] - 1 :][: len(core)]) for m in found] == [(3, core), (3 + len(core) + 2, core)]
    assert one(spark, scalars.aligned(F.col("s")), s="ABC") == "ABC" + "-" * 20
    assert scalars.position_weights([0.0, 1.0, 2.0], 0.5) == [0.5, 0.75, 1.0]
    assert one(spark, text.plain(F.col("s")), s=" <b>a</b>  c\n") == "a c"
    assert one(spark, text.sentences(F.col("s"), 2, 9), s="One. Two! x") == ["One.", "Two!"]
    assert one(spark, text.unsupported_numerals(F.col("a"), F.col("q"), ["1"]), a="1 of 2.5 or 7", q="at 7") == ["2.5"]
    assert one(spark, text.json_block(F.col("s")), s='ok ```json\n{"a": 1}\n``` {"b": 2}') == '{"a": 1}'
    assert one(spark, text.codes(F.col("s")), s="see 1abc, 1ABC and 2xyz; abcd") == ["1ABC", "2XYZ"]
    assert one(spark, text.json_block(F.col("s")), s="none") is None
    assert one(spark, scalars.peptide_positions(F.col("s"), "K", F.lit(10)), s="AKKA") == [11, 12]


def test_intervals(spark):
    w = spark.createDataFrame([("p", 10, 20), ("p", 30, 40), ("q", 1, 5), ("p", 1000, 2000)], "k string, w_low bigint, w_high bigint")
    c = spark.createDataFrame([("p", 20, 25, 0.5), ("p", 21, 29, 0.9), ("p", 32, 33, 0.1), ("p", 28, 50, 0.3), ("q", 6, 9, 1.0), ("p", 900, 3000, 0.7)], "k string, c_low bigint, c_high bigint, s double")
    met = joins.overlaps(w, c, "k", ("w_low", "c_low"), ("w_high", "c_high"))
    assert sorted((r.w_low, r.c_low, r.shared) for r in met.collect()) == [(10, 20, 1), (30, 28, 11), (30, 32, 2), (1000, 900, 1001)]
    best = joins.best_overlap(w, c, "k", ("w_low", "c_low"), ("w_high", "c_high"), "s", ["k", "w_low", "w_high"], least=2)
    assert {(r.w_low, r.best, r.n_overlaps) for r in best.collect()} == {(10, 0.0, 0), (30, 0.3, 2), (1, 0.0, 0), (1000, 0.7, 1)}
    assert [r.w_low for r in joins.no_overlap(w, c, "k", ("w_low", "c_low"), ("w_high", "c_high"), ["k", "w_low", "w_high"]).collect()] == [1]


def test_grid_distance(spark):
    atoms = spark.createDataFrame([(1, 0.0), (2, 3.9), (3, 20.0), (4, -2.0)], "a bigint, ax double").withColumns({"ay": F.lit(0.0), "az": F.lit(0.0)})
    other = spark.createDataFrame([(9, 2.0)], "b bigint, bx double").withColumns({"by": F.lit(0.0), "bz": F.lit(0.0)})
    at = (["ax", "ay", "az"], ["bx", "by", "bz"])
    assert sorted(r.a for r in joins.within(atoms, other, at, 4.0).collect()) == [1, 2, 4]  # 4.0 counts
    assert sorted(r.a for r in joins.within(atoms, other, at, 3.99).collect()) == [1, 2]
    assert {r.a: r.nearest for r in joins.nearest(atoms, other, at, ["a"], 4.0).collect()} == {1: 2.0, 2: 3.9 - 2.0, 3: None, 4: 4.0}


def test_prefix_sums(spark):
    rng = random.Random(0)
    rows = [(i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, v bigint").repartition(9)
    got = {r.id: (r.rank, r.total) for r in prefix.running(df, [F.desc("v"), F.col("id")], {"rank": F.lit(1), "total": F.col("v")}).collect()}
    total = 0
    for n, (i, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        assert got[i] == (n, total)
    assert prefix.ordinal(df.limit(0), [F.col("id")]).count() == 0


def test_fdr(spark):
    p = [0.01, 0.02, 0.02, 0.5, 1.0, None]
    df = spark.createDataFrame([(i, "g", x) for i, x in enumerate(p)], "id bigint, g string, p double")
    want = [0.05, 0.02 * 5 / 3, 0.02 * 5 / 3, 0.625, 1.0, None]
    for out in (ranking.benjamini_hochberg(df, "p"), ranking.benjamini_hochberg(df, "p", ["g"])):
        got = {r.id: r.q for r in out.collect()}
        assert all((got[i] is None) if w is None else abs(got[i] - min(w, want[1] if i == 0 else w)) < 1e-12 for i, w in enumerate(want))


def test_runs_and_windows(spark):
    df = spark.createDataFrame([("a", i, i in (2, 3, 4, 8, 9)) for i in range(12)], "k string, i bigint, on boolean")
    runs = ranking.runs(df, ["k"], "i", F.col("on"), 2)
    assert sorted((r.run_begin, r.run_end) for r in runs.collect()) == [(2, 4), (8, 9)]
    assert [(r.run_end, r.run_begin_next) for r in ranking.adjacent(runs, ["k"], "run_begin", ["run_begin"]).collect()] == [(4, 8)]
    share = {r.i: r.share for r in ranking.neighbour_share(df, ["k"], "i", F.col("on"), 1).collect()}
    assert share[0] == 0 and share[3] == 1 and share[5] == 0.5
    splits = ranking.group_split(spark.range(4000).withColumn("g", F.col("id") % 500), "g", {"a": 0.7, "b": 0.2, "c": 0.1}, 1).groupBy("g").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert {r.n for r in splits} == {1} and {r.s for r in splits} == {"a", "b", "c"}


def test_graph(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "d", "e"), (5, "e", "a"), (6, "a", "a"), (7, "b", "a"), (8, "x", "y")], "edge_id bigint, src string, dst string")
    focus = spark.createDataFrame([("a",), (None,)], "node string")
    hop = lambda d: {r.node: r.hop for r in graph.neighbourhood(edges, focus, d).collect()}
    assert hop(1) == {"a": 0, "b": 1, "e": 1} and hop(0) == hop(1) and hop(9) == {"a": 0, "b": 1, "e": 1, "c": 2, "d": 2}
    assert [r.node for r in graph.capped(graph.neighbourhood(edges, focus, 2), 3).collect()] == ["a", "b", "e"]
    assert {r.edge_id for r in graph.inner_edges(edges, graph.neighbourhood(edges, focus, 1)).collect()} == {1, 5, 6, 7}
    alone = spark.createDataFrame([("lonely",)], "node string")
    assert graph.neighbourhood(edges, alone, 3).count() == 1
    assert graph.busiest(edges).first().asDict() == {"node": "a", "degree": 5}


def test_pairs_and_sets(spark):
    df = spark.createDataFrame([(1, "x", "y", "L1", "e1", 1.0, 0.5), (2, "y", "x", "L2", "e1", 3.0, 0.9), (3, "x", "x", "L3", "e2", 9.0, 1.0), (4, None, "x", "L4", "e2", 9.0, 1.0)], "id bigint, a string, b string, m string, s string, v double, bal double")
    r = clusters.pair_series(df, "a", "b", "m", "s", "v", "bal", "id").collect()
    assert [(x.name_a, x.name_b, x.n_members, x.n_sources, x.median_size, x.widest_id) for x in r] == [("x", "y", 2, 1, 1.0, 2)]
    claimed = sets.claim(df.withColumn("k", F.lit("k")), "k", "m", ["L9", "L3", "L1"]).first()
    assert claimed.m == "L3"
    a = spark.createDataFrame([(1, ""), (2, "n"), (3, None)], "k bigint, c string")
    b = spark.createDataFrame([(1, "z"), (4, "w"), (2, "q")], "k bigint, c string")
    assert {(x.k, x.c) for x in joins.merge(a, b, "k", ["c"]).collect()} == {(1, "z"), (2, "n"), (3, None), (4, "w")}
    relaxed = clusters.relaxed(df, {"big": F.col("v") > 2, "even": F.col("id") % 2 == 0}, ["even", "big"], [F.col("id")], 9).collect()
    assert [(x.id, x.relaxed) for x in relaxed] == [(2, 0), (4, 0), (3, 1), (1, 2)]
