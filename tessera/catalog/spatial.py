"""Distance joins and geometry over points (the first three dimensions of the embeddings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import joins
from tessera.session import table

CUTOFF = 0.05


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)))


def _named(df: DataFrame, suffix: str) -> DataFrame:
    return df.select("label", F.col("vec_id").alias(f"id_{suffix}"), *(F.col(f"x{i}").alias(f"{suffix}{i}") for i in range(3)))


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of points of one label within the cutoff, each pair once."""
    p = _points(spark, sf)
    met = joins.within(_named(p, "a"), _named(p, "b"), ([f"a{i}" for i in range(3)], [f"b{i}" for i in range(3)]), CUTOFF, ["label"])
    return met.where("id_a < id_b").select("id_a", "id_b", F.round("distance", 6).alias("distance"))


def contact_counts(spark: SparkSession, sf: str) -> DataFrame:
    return contacts(spark, sf).select(F.explode(F.array("id_a", "id_b")).alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("n_contacts"))


def nearest_other(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest point of another label, within the cutoff."""
    p = _points(spark, sf)
    a = _named(p, "a").withColumnRenamed("label", "label_a")
    b = _named(p, "b").withColumnRenamed("label", "label_b")
    met = joins.within(a, b, ([f"a{i}" for i in range(3)], [f"b{i}" for i in range(3)]), CUTOFF).where("label_a <> label_b")
    near = met.groupBy("id_a").agg(F.round(F.min("distance"), 6).alias("nearest"))
    return p.select(F.col("vec_id").alias("id_a")).join(near, "id_a", "left")


def pocket_members(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct points within the cutoff of any point of label 0."""
    p = _points(spark, sf)
    a = _named(p.where("label <> 0"), "a").withColumnRenamed("label", "label_a")
    b = _named(p.where("label = 0"), "b").withColumnRenamed("label", "label_b")
    return joins.within(a, b, ([f"a{i}" for i in range(3)], [f"b{i}" for i in range(3)]), CUTOFF).select("id_a", "label_a").distinct()


def centroid_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each point to its label's centroid."""
    p = _points(spark, sf)
    centre = p.groupBy("label").agg(*(F.avg(f"x{i}").alias(f"c{i}") for i in range(3)))
    return p.join(centre, "label").select("vec_id", F.round(scalars.distance([F.col(f"x{i}") for i in range(3)], [F.col(f"c{i}") for i in range(3)]), 6).alias("distance"))


QUERIES = {f.__name__: f for f in (contacts, contact_counts, nearest_other, pocket_members, centroid_distance)}

_P = "p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_C = f"c AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, round({_D}, 6) AS distance FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_D} <= {CUTOFF})"
SQL = {
    "contacts": f"WITH {_P}, {_C} SELECT * FROM c",
    "contact_counts": f"WITH {_P}, {_C} SELECT vec_id, count(*) AS n_contacts FROM (SELECT id_a AS vec_id FROM c UNION ALL SELECT id_b FROM c) GROUP BY 1",
    "nearest_other": f"WITH {_P} SELECT a.vec_id AS id_a, round(min(CASE WHEN {_D} <= {CUTOFF} THEN {_D} END), 6) AS nearest FROM p a LEFT JOIN p b ON a.label <> b.label GROUP BY 1",
    "pocket_members": f"WITH {_P} SELECT DISTINCT a.vec_id AS id_a, a.label AS label_a FROM p a JOIN p b ON b.label = 0 AND a.label <> 0 WHERE {_D} <= {CUTOFF}",
    "centroid_distance": f"WITH {_P}, b AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1) SELECT a.vec_id, round({_D}, 6) AS distance FROM p a JOIN b USING (label)",
}
