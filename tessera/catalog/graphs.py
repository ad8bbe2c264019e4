"""Edge building and bounded neighbourhoods over proteins and ligands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.atlas import BRIDGE_SQL, bridges, known
from tessera.operators import graph
from tessera.operators.prefix import ordinal
from tessera.operators.references import code
from tessera.session import table


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers that meet in any order line, one edge a pair, numbered in order."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey")).alias("src"))
    pairs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")).join(o, "o_orderkey").select("src", "dst").distinct()
    return ordinal(pairs, [F.col("src"), F.col("dst")], "edge_id")


def _focus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s7",)], "node string")


def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, sf), _focus(spark), 3).select("node", "hop")


def neighbourhood_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The first 60 nodes as they are reached."""
    return graph.capped(graph.neighbourhood(_edges(spark, sf), _focus(spark), 2), 60).select("node", "hop")


def inner_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf)
    return graph.inner_edges(edges, graph.neighbourhood(edges, _focus(spark), 2)).select("edge_id", "src", "dst")


def annotated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph.neighbourhood(_edges(spark, sf), _focus(spark), 1)
    names = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"), "s_name")
    return graph.annotate(nodes, names, "key", ["s_name"], "supplier", "customer").select("node", "node_kind", "s_name")


def bridge_edges(spark: SparkSession, sf: str) -> DataFrame:
    """One edge a pair of partners and ligand, that of the first bridge."""
    b = bridges(spark, sf).where("status = 'ok' and ccd_id is not null").select("id", "entity_a", "entity_b", "ccd_id", "pdb_id")
    return graph.pair_edges(b, "entity_a", "entity_b", "ccd_id", ["id"], "bridged_by", ["id"])


def self_edges(spark: SparkSession, sf: str) -> DataFrame:
    z = known(table(spark, sf, "zinc_finger")).withColumn("acc", code("uniprot_acc")).where("status = 'ok'")
    return graph.self_edges(z, "acc", "zf_end", "carries")


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of all producers, by kind."""
    parts = [bridge_edges(spark, sf), self_edges(spark, sf), _edges(spark, sf).select("src", "dst", F.lit("ships").alias("kind"), F.lit("{}").alias("evidence"))]
    return reduce(DataFrame.unionByName, parts).groupBy("kind").agg(F.count("*").alias("n"))


def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf))


def busiest_node(spark: SparkSession, sf: str) -> DataFrame:
    return graph.busiest(_edges(spark, sf))


def opening_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.opening(_edges(spark, sf), 40).select("edge_id", "src", "dst")


QUERIES = {f.__name__: f for f in (neighbourhood, neighbourhood_capped, inner_edges, annotated_nodes, bridge_edges, self_edges, all_edges, node_degrees, busiest_node, opening_edges)}

_E = "e AS (SELECT *, row_number() OVER (ORDER BY src, dst) AS edge_id FROM (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey))"
_L = "l AS (SELECT edge_id, src AS node, dst AS other, 0 AS side FROM e UNION ALL SELECT edge_id, dst, src, 1 FROM e)"
_H1 = "h0 AS (SELECT 's7' AS node), h1 AS (SELECT other AS node, min((edge_id, side)) AS f FROM l JOIN h0 USING (node) WHERE other NOT IN (SELECT node FROM h0) GROUP BY 1)"
_H2 = "h2 AS (SELECT other AS node, min((edge_id, side)) AS f FROM l JOIN h1 USING (node) WHERE other NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1) GROUP BY 1)"
_H3 = "h3 AS (SELECT other AS node, min((edge_id, side)) AS f FROM l JOIN h2 USING (node) WHERE other NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1 UNION SELECT node FROM h2) GROUP BY 1)"
_N2 = "n AS (SELECT node, 0 AS hop, (0, 0) AS f FROM h0 UNION ALL SELECT node, 1, f FROM h1 UNION ALL SELECT node, 2, f FROM h2)"
_BR = "WITH {} , q AS (SELECT least(entity_a, entity_b) AS src, greatest(entity_a, entity_b) AS dst, ccd_id, min(id) AS id FROM br WHERE status = 'ok' AND ccd_id IS NOT NULL AND entity_a <> entity_b GROUP BY 1, 2, 3)".format(BRIDGE_SQL)
_SELF = "SELECT nullif(upper(trim(uniprot_acc, ' ')), '') AS acc, count(*) AS n, max(zf_end) AS best FROM zinc_finger WHERE status = 'ok' AND nullif(upper(trim(uniprot_acc, ' ')), '') IS NOT NULL GROUP BY 1"
SQL = {
    "neighbourhood": f"WITH {_E}, {_L}, {_H1}, {_H2}, {_H3} SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3",
    "neighbourhood_capped": f"WITH {_E}, {_L}, {_H1}, {_H2}, {_N2} SELECT node, hop FROM n ORDER BY hop, f, node LIMIT 60",
    "inner_edges": f"WITH {_E}, {_L}, {_H1}, {_H2}, {_N2} SELECT edge_id, src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)",
    "annotated_nodes": f"WITH {_E}, {_L}, {_H1}, a AS (SELECT node FROM h0 UNION ALL SELECT node FROM h1) SELECT node, CASE WHEN s_name IS NULL THEN 'customer' ELSE 'supplier' END AS node_kind, s_name FROM a LEFT JOIN supplier ON 's' || s_suppkey = node",
    "bridge_edges": _BR + """ SELECT src, dst, 'bridged_by' AS kind, '{"ccd_id":"' || ccd_id || '","id":' || id || '}' AS evidence FROM q""",
    "self_edges": f"""WITH s AS ({_SELF}) SELECT acc AS src, acc AS dst, 'carries' AS kind, '{{"n":' || n || CASE WHEN best IS NULL THEN '' ELSE ',"best":' || best END || '}}' AS evidence FROM s""",
    "all_edges": _BR + f", {_E}, s AS ({_SELF}) SELECT 'bridged_by' AS kind, count(*) AS n FROM q UNION ALL SELECT 'carries', count(*) FROM s UNION ALL SELECT 'ships', count(*) FROM e",
    "node_degrees": f"WITH {_E} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1",
    "busiest_node": f"WITH {_E} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "opening_edges": f"WITH {_E} SELECT edge_id, src, dst FROM e ORDER BY edge_id LIMIT 80",
}
