"""The query core over the atlas and order tables: record types, the planner, counts, identities and cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import clusters, sets
from tessera.operators.ranking import first_per_key
from tessera.operators.references import code
from tessera.plans.planner import Planner
from tessera.plans.query import parse
from tessera.plans.schema import FieldSpec, Parent, RecordType, Registry, vocabulary
from tessera.session import remembered, table

N, E, B, X = "number", "enum", "bool", "text"
BRIDGE = RecordType(
    "bridge",
    "bridge",
    (
        FieldSpec("dsasa_total", N, "A2"), FieldSpec("dsasa_a", N, "A2"), FieldSpec("dsasa_b", N, "A2"), FieldSpec("bridging_balance", N), FieldSpec("buried_fraction", N), FieldSpec("contacts_a", N), FieldSpec("contacts_b", N), FieldSpec("heavy_atoms", N),
        FieldSpec("ccd_class", E), FieldSpec("symmetry_mediated", B), FieldSpec("novel_bridge", B), FieldSpec("evidence_class", E), FieldSpec("pdb_id", X), FieldSpec("ccd_id", X),
        FieldSpec("resolution", N, "A", parent="entry"), FieldSpec("method", E, parent="entry"), FieldSpec("organism", X, parent="entry"), FieldSpec("tier", N, parent="entry"), FieldSpec("mw", N, "Da", parent="ligand"), FieldSpec("is_furniture", B, parent="ligand"),
    ),
    ("id",), "dsasa_total", True, ("pdb_id", "ccd_id", "ccd_class", "dsasa_total", "bridging_balance", "resolution", "mw"),
    (Parent("entry", "pdb_id", "pdb_id", ("resolution", "method", "organism", "tier")), Parent("ligand", "ccd_id", "ccd_id", ("mw", "is_furniture"))),
)
FINGER = RecordType("zinc_finger", "zinc_finger", (FieldSpec("imid_degradation_score", N), FieldSpec("mean_plddt", N), FieldSpec("zf_start", N), FieldSpec("has_degron_candidate", B), FieldSpec("screen_degraded", B), FieldSpec("gene", X), FieldSpec("uniprot_acc", X)), ("id",), "imid_degradation_score", True, ("uniprot_acc", "gene", "zf_start", "imid_degradation_score"))
LYSINE = RecordType("lysine", "lysine", (FieldSpec("nz_rel_sasa", N), FieldSpec("cb_cb_distance", N, "A"), FieldSpec("nz_centroid_distance", N, "A"), FieldSpec("res_num", N), FieldSpec("observed_digly", B), FieldSpec("uniprot_acc", X), FieldSpec("verdict", X)), ("id",), "nz_centroid_distance", False, ("uniprot_acc", "res_num", "nz_centroid_distance", "nz_rel_sasa"))
SHIPMENT = RecordType(
    "shipment",
    "lineitem",
    (FieldSpec("l_extendedprice", N), FieldSpec("l_quantity", N), FieldSpec("l_discount", N), FieldSpec("l_returnflag", E, enum=("A", "N", "R")), FieldSpec("o_totalprice", N, parent="orders"), FieldSpec("o_orderpriority", X, parent="orders"), FieldSpec("p_size", N, parent="part"), FieldSpec("p_brand", X, parent="part")),
    ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_extendedprice", True, ("l_extendedprice", "l_quantity", "o_totalprice", "p_brand"),
    (Parent("orders", "l_orderkey", "o_orderkey", ("o_totalprice", "o_orderpriority")), Parent("part", "l_partkey", "p_partkey", ("p_size", "p_brand"))),
)
REGISTRY = Registry([BRIDGE, FINGER, LYSINE, SHIPMENT])
_LAST = ["status", "title", "method", "resolution", "release_date", "organism", "tier"]


def known(df: DataFrame) -> DataFrame:
    """NaN is no value: it becomes null in every floating column."""
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """One row an entry: of repeated deliveries the last.  Made once while the files stay as they are."""
    return remembered(spark, "entries", f"{sf}/entry.parquet", lambda: _entries(spark, sf))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    e = known(table(spark, sf, "entry")).withColumn("pdb_id", code("pdb_id")).where("pdb_id is not null")
    return first_per_key(e, ["pdb_id"], [F.col("loaded_at").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in _LAST)])


def ligands(spark: SparkSession, sf: str) -> DataFrame:
    return remembered(spark, "ligands", f"{sf}/ligand.parquet", lambda: _ligands(spark, sf))


def _ligands(spark: SparkSession, sf: str) -> DataFrame:
    g = known(table(spark, sf, "ligand")).withColumn("ccd_id", code("ccd_id")).where("ccd_id is not null")
    return first_per_key(g, ["ccd_id"], [F.col("loaded_at").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ("status", "name", "formula", "mw", "ccd_class"))])


def bridges(spark: SparkSession, sf: str) -> DataFrame:
    return known(table(spark, sf, "bridge")).withColumns({"pdb_id": code("pdb_id"), "ccd_id": code("ccd_id")})


def planner(spark: SparkSession, sf: str) -> Planner:
    def read(name: str) -> DataFrame:
        if name in ("entry", "ligand", "bridge"):
            return {"entry": entries, "ligand": ligands, "bridge": bridges}[name](spark, sf)
        df = known(table(spark, sf, name))
        if name == "lineitem":  # no line failed unless its discount is out of range
            df = df.withColumn("status", F.when(F.col("l_discount").between(0, 0.09), F.lit("ok")).otherwise(F.lit("failed:discount")))
        return df.withColumn("uniprot_acc", code("uniprot_acc")) if "uniprot_acc" in df.columns else df

    return Planner(read)


TOPK = {"record_type": "bridge", "filters": [{"field": "dsasa_total", "op": "gte", "value": 150}, {"field": "ccd_class", "op": "eq", "value": "cofactor"}], "limit": 60}
BY_PARENT = {"record_type": "bridge", "filters": [{"field": "resolution", "op": "lte", "value": "2.5"}, {"field": "bridging_balance", "op": "gt", "value": 0.3}], "sort": {"field": "mw", "direction": "asc"}, "limit": 100}
SHIPPED = {"record_type": "shipment", "filters": [{"field": "l_quantity", "op": "gte", "value": 30}, {"field": "l_returnflag", "op": "eq", "value": "R"}], "limit": 40}


def query_topk(spark: SparkSession, sf: str) -> DataFrame:
    return planner(spark, sf).execute(parse(TOPK, REGISTRY))


def query_topk_joined(spark: SparkSession, sf: str) -> DataFrame:
    return planner(spark, sf).execute(parse(TOPK, REGISTRY), base_first=False)


def query_parent_sort(spark: SparkSession, sf: str) -> DataFrame:
    return planner(spark, sf).execute(parse(BY_PARENT, REGISTRY))


def query_shipments(spark: SparkSession, sf: str) -> DataFrame:
    return planner(spark, sf).execute(parse(SHIPPED, REGISTRY))


def query_shipments_joined(spark: SparkSession, sf: str) -> DataFrame:
    return planner(spark, sf).execute(parse(SHIPPED, REGISTRY), base_first=False)


def query_default_page(spark: SparkSession, sf: str) -> DataFrame:
    """No filters: the default sort and direction of the record type."""
    return planner(spark, sf).execute(parse({"record_type": "lysine"}, REGISTRY))


def query_columns(spark: SparkSession, sf: str) -> DataFrame:
    return planner(spark, sf).execute(parse({"record_type": "zinc_finger", "filters": [{"field": "screen_degraded", "op": "ne", "value": True}], "limit": 25}, REGISTRY), ["gene", "mean_plddt"])


def query_count(spark: SparkSession, sf: str) -> DataFrame:
    return planner(spark, sf).count(parse(TOPK, REGISTRY))


def query_count_parent(spark: SparkSession, sf: str) -> DataFrame:
    return planner(spark, sf).count(parse(BY_PARENT, REGISTRY))


def query_identity(spark: SparkSession, sf: str) -> DataFrame:
    return planner(spark, sf).identity(parse(BY_PARENT, REGISTRY))


def query_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One record with its parents nested (flattened here so that rows can be compared)."""
    found = planner(spark, sf).lookup(BRIDGE, {"id": 11})
    return found.select("id", "pdb_id", "ccd_id", "dsasa_total", F.col("entry.title").alias("entry_title"), F.col("entry.resolution").alias("entry_resolution"), F.col("ligand.name").alias("ligand_name"), F.col("ligand.mw").alias("ligand_mw"))


def vocabularies(spark: SparkSession, sf: str) -> dict[tuple[str, str], list[str]]:
    return {("bridge", "ccd_class"): vocabulary(bridges(spark, sf), "ccd_class"), ("bridge", "method"): vocabulary(entries(spark, sf), "method"), ("bridge", "evidence_class"): vocabulary(bridges(spark, sf), "evidence_class")}


def query_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values that are neither null nor blank, of every enum read from data."""
    b, e = bridges(spark, sf), entries(spark, sf)
    parts = [df.select(F.lit(f).alias("field"), F.col(f).alias("value")) for f, df in (("ccd_class", b), ("evidence_class", b), ("method", e), ("organism", e))]
    return reduce(DataFrame.unionByName, parts).where("value is not null and trim(value) <> ''").distinct()


def stat_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional counts in one pass over the bridges."""
    ok = F.col("status") == "ok"
    return bridges(spark, sf).agg(
        F.count("*").alias("n_rows"), F.count_if(ok).alias("n_ok"), F.count_if(ok & (F.col("novel_bridge") == 1)).alias("n_novel"), F.count_if(ok & (F.col("symmetry_mediated") == 1)).alias("n_symmetry"),
        F.countDistinct(F.when(ok, F.col("pdb_id"))).alias("n_entries"), F.countDistinct(F.when(ok, F.col("ccd_id"))).alias("n_ligands"),
    )


def furniture_count(spark: SparkSession, sf: str) -> DataFrame:
    """Inner join to count bridges of ligands that are furniture."""
    return bridges(spark, sf).where("status = 'ok'").join(ligands(spark, sf).where("is_furniture = 1").select("ccd_id"), "ccd_id").agg(F.count("*").alias("n"))


def status_tally(spark: SparkSession, sf: str) -> DataFrame:
    return bridges(spark, sf).groupBy(clusters.collapsed_status("status").alias("status_class")).agg(F.count("*").alias("n"))


def failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return bridges(spark, sf).where("status like 'failed:%'").groupBy(clusters.failure_reason("status").alias("reason")).agg(F.count("*").alias("n"))


def orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Bridges whose entry is not among the entries at all (no time considered)."""
    return bridges(spark, sf).where("pdb_id is not null").join(entries(spark, sf).select("pdb_id"), "pdb_id", "left_anti").select("id", "pdb_id")


def title_keywords(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions.text import any_word

    return entries(spark, sf).where(any_word(F.col("title"), ["zinc", "ubiquitin", "ligase"])).select("pdb_id", "title")


def relaxed_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best 20 entries when criteria may be given up in turn."""
    tests = {"xray": F.lower("method") == "x-ray", "sharp": F.col("resolution") <= 2.0, "human": F.col("organism") == "Homo sapiens", "small": F.col("polymer_entity_count") <= 3}
    rows = clusters.relaxed(entries(spark, sf), tests, ["small", "human", "sharp"], [F.coalesce("resolution", F.lit(99.0)), F.col("pdb_id")], 20)
    return rows.select("pdb_id", "resolution", "relaxed")


def updated_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Update from join: a bridge takes the class of its ligand where there is one."""
    new = ligands(spark, sf).select("ccd_id", "ccd_class")
    return sets.updated(bridges(spark, sf).select("id", "ccd_id", "ccd_class"), new, ["ccd_id"], ["ccd_class"]).groupBy("ccd_class").agg(F.count("*").alias("n"))


def flagged_members(spark: SparkSession, sf: str) -> DataFrame:
    """A 0/1 flag by membership."""
    glue = ligands(spark, sf).where("biolip_artefact = 1").select("ccd_id")
    return sets.flag(bridges(spark, sf).select("id", "ccd_id"), glue, ["ccd_id"], "is_artefact").groupBy("is_artefact").agg(F.count("*").alias("n"), F.countDistinct("ccd_id").alias("n_codes"))


QUERIES = {f.__name__: f for f in (query_topk, query_topk_joined, query_parent_sort, query_shipments, query_shipments_joined, query_default_page, query_columns, query_count, query_count_parent, query_identity, query_lookup, query_vocabularies, stat_cards, furniture_count, status_tally, failure_reasons, orphan_rows, title_keywords, relaxed_search, updated_classes, flagged_members)}

_NAN = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_CODE = lambda c: f"nullif(upper(trim({c}, ' ')), '')"
ENTRY_SQL = f"""ent AS (SELECT * FROM (SELECT * REPLACE ({_CODE('pdb_id')} AS pdb_id, {_NAN('resolution')} AS resolution) FROM entry) WHERE pdb_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pdb_id ORDER BY loaded_at DESC NULLS LAST, {', '.join(c + ' NULLS LAST' for c in _LAST)}) = 1)"""
LIGAND_SQL = f"""lig AS (SELECT * FROM (SELECT * REPLACE ({_CODE('ccd_id')} AS ccd_id, {_NAN('mw')} AS mw) FROM ligand) WHERE ccd_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ccd_id ORDER BY loaded_at DESC NULLS LAST, status NULLS LAST, name NULLS LAST, formula NULLS LAST, mw NULLS LAST, ccd_class NULLS LAST) = 1)"""
BRIDGE_SQL = f"br AS (SELECT * REPLACE ({_CODE('pdb_id')} AS pdb_id, {_CODE('ccd_id')} AS ccd_id, " + ", ".join(f"{_NAN(c)} AS {c}" for c in ("dsasa_a", "dsasa_b", "dsasa_total", "bridging_balance", "buried_fraction")) + ") FROM bridge)"
ALL_SQL = f"WITH {ENTRY_SQL}, {LIGAND_SQL}, {BRIDGE_SQL}"
_WIDE = "br LEFT JOIN (SELECT pdb_id AS ep, resolution, method, organism, tier FROM ent) ON ep = pdb_id LEFT JOIN (SELECT ccd_id AS lc, mw, is_furniture FROM lig) ON lc = ccd_id"
_COLS = "id, pdb_id, ccd_id, ccd_class, dsasa_total, bridging_balance, resolution, mw"
_TOP = f"{ALL_SQL} SELECT {_COLS} FROM {_WIDE} WHERE br.status = 'ok' AND dsasa_total >= 150 AND ccd_class = 'cofactor' ORDER BY dsasa_total DESC NULLS LAST, id LIMIT 60"
_PARENT = "br.status = 'ok' AND resolution <= 2.5 AND bridging_balance > 0.3"
_SHIP = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, o_totalprice, p_brand FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey WHERE l_discount BETWEEN 0 AND 0.09 AND l_quantity >= 30 AND l_returnflag = 'R' ORDER BY l_extendedprice DESC NULLS LAST, 1, 2, 3, 4 LIMIT 40"
SQL = {
    "query_topk": _TOP,
    "query_topk_joined": _TOP,
    "query_parent_sort": f"{ALL_SQL} SELECT {_COLS} FROM {_WIDE} WHERE {_PARENT} ORDER BY mw NULLS FIRST, id LIMIT 100",
    "query_shipments": _SHIP,
    "query_shipments_joined": _SHIP,
    "query_default_page": f"SELECT id, {_CODE('uniprot_acc')} AS uniprot_acc, res_num, {_NAN('nz_centroid_distance')} AS nz_centroid_distance, {_NAN('nz_rel_sasa')} AS nz_rel_sasa FROM lysine WHERE status = 'ok' ORDER BY 4 NULLS FIRST, id LIMIT 200",
    "query_columns": f"SELECT id, gene, {_NAN('mean_plddt')} AS mean_plddt FROM zinc_finger WHERE status = 'ok' AND screen_degraded <> 1 ORDER BY {_NAN('imid_degradation_score')} DESC NULLS LAST, id LIMIT 25",
    "query_count": f"WITH {BRIDGE_SQL} SELECT count(*) AS n FROM br WHERE status = 'ok' AND dsasa_total >= 150 AND ccd_class = 'cofactor'",
    "query_count_parent": f"{ALL_SQL} SELECT count(*) AS n FROM {_WIDE} WHERE {_PARENT}",
    "query_identity": f"{ALL_SQL} SELECT id FROM {_WIDE} WHERE {_PARENT}",
    "query_lookup": f"{ALL_SQL} SELECT br.id, br.pdb_id, br.ccd_id, dsasa_total, ent.title AS entry_title, ent.resolution AS entry_resolution, lig.name AS ligand_name, lig.mw AS ligand_mw FROM br LEFT JOIN ent ON ent.pdb_id = br.pdb_id LEFT JOIN lig ON lig.ccd_id = br.ccd_id WHERE br.id = 11",
    "query_vocabularies": f"WITH {ENTRY_SQL} SELECT * FROM (SELECT DISTINCT 'ccd_class' AS field, ccd_class AS value FROM bridge UNION SELECT 'evidence_class', evidence_class FROM bridge UNION SELECT 'method', method FROM ent UNION SELECT 'organism', organism FROM ent) WHERE value IS NOT NULL AND trim(value) <> ''",
    "stat_cards": f"WITH {BRIDGE_SQL} SELECT count(*) AS n_rows, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'ok' AND novel_bridge = 1) AS n_novel, count(*) FILTER (status = 'ok' AND symmetry_mediated = 1) AS n_symmetry, count(DISTINCT CASE WHEN status = 'ok' THEN pdb_id END) AS n_entries, count(DISTINCT CASE WHEN status = 'ok' THEN ccd_id END) AS n_ligands FROM br",
    "furniture_count": f"WITH {LIGAND_SQL}, {BRIDGE_SQL} SELECT count(*) AS n FROM br JOIN lig USING (ccd_id) WHERE br.status = 'ok' AND is_furniture = 1",
    "status_tally": "SELECT CASE WHEN status LIKE 'failed%' THEN 'failed' ELSE status END AS status_class, count(*) AS n FROM bridge GROUP BY 1",
    "failure_reasons": "SELECT split_part(status, ':', 2) AS reason, count(*) AS n FROM bridge WHERE status LIKE 'failed:%' GROUP BY 1",
    "orphan_rows": f"WITH {ENTRY_SQL}, {BRIDGE_SQL} SELECT id, pdb_id FROM br WHERE pdb_id IS NOT NULL AND pdb_id NOT IN (SELECT pdb_id FROM ent)",
    "title_keywords": f"WITH {ENTRY_SQL} SELECT pdb_id, title FROM ent WHERE lower(title) LIKE '%zinc%' OR lower(title) LIKE '%ubiquitin%' OR lower(title) LIKE '%ligase%'",
    "relaxed_search": f"WITH {ENTRY_SQL} SELECT pdb_id, resolution, CASE WHEN NOT coalesce(resolution <= 2.0, false) THEN 3 WHEN NOT coalesce(organism = 'Homo sapiens', false) THEN 2 WHEN NOT coalesce(polymer_entity_count <= 3, false) THEN 1 ELSE 0 END AS relaxed FROM ent WHERE lower(method) = 'x-ray' ORDER BY relaxed, coalesce(resolution, 99), pdb_id LIMIT 20",
    "updated_classes": f"WITH {LIGAND_SQL}, {BRIDGE_SQL} SELECT coalesce(lig.ccd_class, br.ccd_class) AS ccd_class, count(*) AS n FROM br LEFT JOIN lig USING (ccd_id) GROUP BY 1",
    "flagged_members": f"WITH {LIGAND_SQL}, {BRIDGE_SQL} SELECT CASE WHEN ccd_id IN (SELECT ccd_id FROM lig WHERE biolip_artefact = 1) THEN 1 ELSE 0 END AS is_artefact, count(*) AS n, count(DISTINCT ccd_id) AS n_codes FROM br GROUP BY 1",
}
