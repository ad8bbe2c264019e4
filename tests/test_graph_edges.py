"""Edges between customers and suppliers come from every order line, whatever its quantity."""

from tessera.catalog import graphs as G


def test_every_order_line_makes_an_edge(spark, tmp_path):
    spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 7, 50.0), (1, 8, 3.0), (2, 7, 1.0), (2, 7, 49.0), (2, 9, 48.0), (3, 9, None)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    sf = str(tmp_path)
    assert {(r.src, r.dst) for r in G._edges(spark, sf).collect()} == {("c10", "s7"), ("c10", "s8"), ("c11", "s7"), ("c11", "s9"), ("c12", "s9")}
    assert {r.node: r.degree for r in G.node_degrees(spark, sf).collect()} == {"c10": 2, "s7": 2, "c11": 2, "s8": 1, "s9": 2, "c12": 1}
    assert {r.node: r.hop for r in G.neighbourhood(spark, sf).collect()} == {"s7": 0, "c10": 1, "c11": 1, "s8": 2, "s9": 2, "c12": 3}
