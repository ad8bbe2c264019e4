"""Bounded neighbourhoods and edge building over an edge table (edge_id, src, dst, kind, evidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

DEEPEST = 3


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end; side 0 is the edge as stored."""
    a = edges.select("edge_id", F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(0).alias("side"))
    b = edges.select("edge_id", F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(1).alias("side"))
    return a.unionByName(b)


def neighbourhood(edges: DataFrame, focus: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """Nodes within ``depth`` hops (1 to 3) of the focus nodes (column node): node, hop, first_edge, first_side.

    A hop is one join of the frontier with the edges; stops early when no node is new or, with a cap, when enough are seen."""
    depth = max(1, min(DEEPEST, depth))
    links = both_ways(edges)
    seen = cut(focus.select("node").where("node is not null").distinct().select("node", F.lit(0).alias("hop"), F.lit(None).cast("bigint").alias("first_edge"), F.lit(None).cast("int").alias("first_side")))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = links.join(frontier.select("node"), "node").groupBy(F.col("other").alias("node")).agg(F.min(F.struct("edge_id", "side")).alias("first"))
        new = reached.join(seen.select("node"), "node", "left_anti").where("node is not null").select("node", F.lit(hop).alias("hop"), F.col("first.edge_id").alias("first_edge"), F.col("first.side").alias("first_side"))
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
        if cap is not None and seen.count() > cap:
            break
    return seen


def capped(nodes: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` nodes in the order they were reached (hop, edge, side, name): a top-k, not a sample."""
    return nodes.orderBy("hop", F.col("first_edge").asc_nulls_first(), F.col("first_side").asc_nulls_first(), "node").limit(cap)


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, each once."""
    kept = nodes.select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")


def annotate(nodes: DataFrame, attributes: DataFrame, key: str, columns: list[str], kind: str, default: str) -> DataFrame:
    """``kind`` and attributes for the nodes that the attribute table knows, ``default`` for all others."""
    known = attributes.select(F.col(key).alias("node"), *columns, F.lit(kind).alias("node_kind"))
    return nodes.join(known, "node", "left").withColumn("node_kind", F.coalesce("node_kind", F.lit(default)))


def unordered(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def pair_edges(df: DataFrame, a: str, b: str, via: str, order: list[str], kind: str, carry: list[str]) -> DataFrame:
    """One edge for each unordered pair and ``via``, that of the first row in order; evidence is JSON of the carried columns."""
    low, high = unordered(a, b)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).withColumns({"src": low, "dst": high})
    first = rows.groupBy("src", "dst", via).agg(F.min(F.struct(*order, *[c for c in carry if c not in order])).alias("e"))
    return first.select("src", "dst", F.lit(kind).alias("kind"), F.to_json(F.struct(via, *(F.col(f"e.{c}").alias(c) for c in carry))).alias("evidence"))


def self_edges(df: DataFrame, node: str, value: str, kind: str) -> DataFrame:
    """An edge from each node to itself with the number of its rows and their best value."""
    best = df.where(F.col(node).isNotNull()).groupBy(node).agg(F.count("*").alias("n"), F.max(value).alias("best"))
    return best.select(F.col(node).alias("src"), F.col(node).alias("dst"), F.lit(kind).alias("kind"), F.to_json(F.struct("n", "best")).alias("evidence"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends at each node; a self-loop has two."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").groupBy("node").agg(F.count("*").alias("degree"))


def busiest(edges: DataFrame) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(1)


def opening(edges: DataFrame, cap: int) -> DataFrame:
    """What is shown without a focus: the first 2 * cap edges."""
    return edges.orderBy("edge_id").limit(2 * cap)
