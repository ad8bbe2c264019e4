"""Sources, sinks and update operators, run over files written from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog.atlas import entries
from tessera.operators.references import code
from tessera.session import scratch, table
from tessera.sources import files, manifest, sinks


def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as JSON lines and read by schema."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(o, path)
    return files.read_jsonl(spark, path, o.schema)


def tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A maintained, sorted TSV table; the separator is found by looking."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    path = scratch(spark, "tsv")
    sinks.write_tsv(p, path, ["p_partkey"])
    return files.read_table(spark, path, schema=p.schema)


def upserted_parts(spark: SparkSession, sf: str) -> DataFrame:
    """INSERT OR REPLACE: the larger parts with a new price over all parts."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    path = scratch(spark, "upsert")
    sinks.rebuild(p, path, ["p_partkey"])
    return sinks.upsert(p.where("p_size > 30").withColumn("p_retailprice", F.col("p_retailprice") + 1000), path, ["p_partkey"])


def conformed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Rows brought to a declared schema: missing columns null, casts soft."""
    schema = T.StructType.fromDDL("pdb_id string, resolution double, deposit_date date, note string, tier bigint")
    return sinks.conform(entries(spark, sf), schema).withColumn("deposit_date", F.col("deposit_date").cast("string"))


def located_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Columns found by part of their header."""
    return files.located_columns(table(spark, sf, "part"), {"key": "PARTKEY", "price": "retail"})


def fixed_width_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-width lines sliced by position; a slice that is no number is null."""
    lines = table(spark, sf, "orders").select("o_orderkey", F.concat(F.rpad(F.col("o_custkey").cast("string"), 8, " "), F.rpad("o_orderstatus", 3, " "), F.lit("x12")).alias("line"))
    return files.fixed_width(lines, "line", [files.Slice("customer", 0, 8, "bigint"), files.Slice("state", 8, 11), files.Slice("bad", 11, 14, "int")])


def clean_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bridge").where("pdb_id is not null").select("id", files.clean_code(F.col("pdb_id"), "^([0-9][A-Z0-9]{3}|PDB_[A-Z0-9]{8})$").alias("pdb_id"))


def nested_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Polymers of an entry as a count and the first."""
    p = table(spark, sf, "polymer_entity").withColumn("pdb_id", code("pdb_id")).where("pdb_id is not null")
    return p.groupBy("pdb_id").agg(F.count("*").alias("n_polymers"), F.min("id").alias("first_id"))


def chain_heads(spark: SparkSession, sf: str) -> DataFrame:
    """A nested list (the chains of a polymer) flattened to its size and its first element."""
    p = table(spark, sf, "polymer_entity").where("asym_id is not null")
    nested = p.select("id", F.transform(F.split("asym_id", ","), lambda c: F.struct(F.trim(c).alias("name"))).alias("chains"))
    return files.flattened(nested, {"n_chains": "chains"}, {"first": "chains"}).select("id", "n_chains", F.col("first.name").alias("first_chain"))


def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Status tallies of a manifest: the latest entry of a key counts."""
    return manifest.counts(_manifest(spark, sf))


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "bridge").where("structure_file is not null or status <> 'ok'").select(F.coalesce("structure_file", F.col("id").cast("string")).alias("key"), "status", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    path = scratch(spark, "manifest")
    b.write.json(path)
    return manifest.read(spark, path)


def pending_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are not done, failed ones to be tried again."""
    m = _manifest(spark, sf)
    keys = table(spark, sf, "bridge").select(F.coalesce("structure_file", F.col("id").cast("string")).alias("key")).distinct()
    return manifest.pending(keys, "key", m, retry_failed=True)


def failed_keys(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.failures(_manifest(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (jsonl_round_trip, tsv_round_trip, upserted_parts, conformed_entries, located_prices, fixed_width_rows, clean_codes, nested_entries, chain_heads, manifest_counts, pending_keys, failed_keys)}

from tessera.catalog.atlas import ENTRY_SQL  # noqa: E402

_M = "m AS (SELECT coalesce(structure_file, CAST(id AS VARCHAR)) AS key, status, loaded_at FROM bridge WHERE structure_file IS NOT NULL OR status <> 'ok'), t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY strftime(loaded_at, '%Y-%m-%d %H:%M:%S.%f') DESC NULLS LAST, status DESC) = 1)"
SQL = {
    "jsonl_round_trip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "tsv_round_trip": "SELECT p_partkey, p_brand, p_size FROM part",
    "upserted_parts": "SELECT p_partkey, p_size, CASE WHEN p_size > 30 THEN p_retailprice + 1000 ELSE p_retailprice END AS p_retailprice FROM part",
    "conformed_entries": f"WITH {ENTRY_SQL} SELECT pdb_id, resolution, CAST(try_cast(deposit_date AS DATE) AS VARCHAR) AS deposit_date, CAST(NULL AS VARCHAR) AS note, CAST(tier AS BIGINT) AS tier FROM ent",
    "located_prices": "SELECT p_partkey AS key, p_retailprice AS price FROM part",
    "fixed_width_rows": "SELECT o_orderkey, o_custkey AS customer, trim(o_orderstatus, ' ') AS state, CAST(NULL AS INTEGER) AS bad FROM orders",
    "clean_codes": "SELECT id, CASE WHEN regexp_full_match(upper(trim(pdb_id, ' ')), '[0-9][A-Z0-9]{3}|PDB_[A-Z0-9]{8}') THEN upper(trim(pdb_id, ' ')) ELSE '' END AS pdb_id FROM bridge WHERE pdb_id IS NOT NULL",
    "nested_entries": "SELECT upper(trim(pdb_id, ' ')) AS pdb_id, count(*) AS n_polymers, min(id) AS first_id FROM polymer_entity WHERE nullif(trim(pdb_id, ' '), '') IS NOT NULL GROUP BY 1",
    "chain_heads": "SELECT id, len(string_split(asym_id, ',')) AS n_chains, trim(string_split(asym_id, ',')[1], ' ') AS first_chain FROM polymer_entity WHERE asym_id IS NOT NULL",
    "manifest_counts": f"WITH {_M} SELECT CASE WHEN status LIKE 'failed%' THEN 'failed' ELSE status END AS status, count(*) AS n FROM t GROUP BY 1",
    "pending_keys": f"WITH {_M} SELECT DISTINCT coalesce(structure_file, CAST(id AS VARCHAR)) AS key FROM bridge WHERE coalesce(structure_file, CAST(id AS VARCHAR)) NOT IN (SELECT key FROM t WHERE status = 'ok')",
    "failed_keys": f"WITH {_M} SELECT split_part(status, ':', 2) AS reason, count(*) AS n FROM t WHERE status LIKE 'failed%' GROUP BY 1",
}
