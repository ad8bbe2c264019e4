"""Joins, set operations and aggregations over the atlas tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.atlas import BRIDGE_SQL, ENTRY_SQL, LIGAND_SQL, bridges, entries, known, ligands
from tessera.functions import scalars
from tessera.operators import clusters, joins, ranking, sets, skew
from tessera.operators.references import code
from tessera.session import table


def polymers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "polymer_entity").withColumns({"pdb_id": code("pdb_id"), "uniprot_acc": code("uniprot_acc")})


def bridged_proteins(spark: SparkSession, sf: str) -> DataFrame:
    """Both chains of a bridge resolved to proteins through the entry's chain lists."""
    b = bridges(spark, sf).where("status = 'ok' and pdb_id is not null").select("id", "pdb_id", "chain_a", "chain_b")
    return joins.chain_lookup(b, polymers(spark, sf).where("pdb_id is not null"), "pdb_id", ("chain_a", "chain_b"), "auth_asym_id", "uniprot_acc").select("id", "uniprot_acc_a", "uniprot_acc_b")


def one_sided_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """Bridges that join a ligase with a protein that is none."""
    ligases = polymers(spark, sf).where("is_e3 = 1")
    return joins.one_sided(bridged_proteins(spark, sf), ligases, "uniprot_acc_a", "uniprot_acc_b", "uniprot_acc").select("id", "uniprot_acc_a", "uniprot_acc_b", "member_side")


def side_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Mean change between the two sides, in doublings, by class and number of contacts, and each mean as a weight against its class's peak."""
    b = bridges(spark, sf).where("ccd_class is not null and contacts_a is not null").select("ccd_class", "contacts_a", scalars.log_change(F.col("dsasa_a"), F.col("dsasa_b")).alias("change")).where("change is not null")
    means = b.groupBy("ccd_class", "contacts_a").agg(F.count("*").alias("n"), F.avg("change").alias("mean_change"))
    peaks = means.groupBy("ccd_class").agg(F.max("mean_change").alias("peak"))
    return means.join(peaks, "ccd_class").select("ccd_class", "contacts_a", "n", "mean_change", scalars.peak_weight(F.col("mean_change"), F.col("peak"), 0.2).alias("weight"))


def merged_ligands(spark: SparkSession, sf: str) -> DataFrame:
    """Full merge of the ligand table with what bridges say of ligands; the ligand table goes first."""
    seen = bridges(spark, sf).where("ccd_id is not null").groupBy("ccd_id").agg(F.min("ccd_class").alias("ccd_class"), F.min("ligand_label").alias("name"))
    return joins.merge(ligands(spark, sf), seen, "ccd_id", ["name", "ccd_class"])


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate stretches twelve residues further on, equal ones counted once with their best score."""
    z = known(table(spark, sf, "zinc_finger")).where("has_degron_candidate = 1 and zf_start <= zf_end")
    z = z.select(code("uniprot_acc").alias("uniprot_acc"), (F.col("zf_start") + 12).alias("c_low"), (F.col("zf_end") + 12).alias("c_high"), "imid_degradation_score")
    return z.where("uniprot_acc is not null").groupBy("uniprot_acc", "c_low", "c_high").agg(F.max("imid_degradation_score").alias("exposure"))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    z = table(spark, sf, "zinc_finger").where("zf_start is not null and zf_end is not null and zf_start <= zf_end")
    return z.select(code("uniprot_acc").alias("uniprot_acc"), "zf_start", "zf_end").where("uniprot_acc is not null").distinct()


def finger_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Each finger window with the best score of the candidates that share at least three residues with it."""
    keys = ["uniprot_acc", "zf_start", "zf_end"]
    return joins.best_overlap(_windows(spark, sf), _points(spark, sf), "uniprot_acc", ("zf_start", "c_low"), ("zf_end", "c_high"), "exposure", keys, least=3)


def finger_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Any-overlap flag and the best label, null where nothing overlaps."""
    keys = ["uniprot_acc", "zf_start", "zf_end"]
    out = joins.best_overlap(_windows(spark, sf), _points(spark, sf), "uniprot_acc", ("zf_start", "c_low"), ("zf_end", "c_high"), "exposure", keys, absent=None)
    return out.select(*keys, (F.col("n_overlaps") > 0).cast("int").alias("has_candidate"), "best")


def lonely_fingers(spark: SparkSession, sf: str) -> DataFrame:
    return joins.no_overlap(_windows(spark, sf), _points(spark, sf), "uniprot_acc", ("zf_start", "c_low"), ("zf_end", "c_high"), ["uniprot_acc", "zf_start", "zf_end"])


def agreeing_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Entry codes that at least two of three tables have."""
    return joins.agreement({"bridge": bridges(spark, sf), "polymer": polymers(spark, sf), "entry": entries(spark, sf)}, "pdb_id")


def gene_or_accession(spark: SparkSession, sf: str) -> DataFrame:
    """Genes looked up among fingers that worked, kept as they are where none did."""
    z = table(spark, sf, "zinc_finger")
    names = z.where("status = 'ok'").select("gene", code("uniprot_acc").alias("acc")).where("acc is not null")
    return joins.lookup_or_keep(z.where("gene is not null").select("id", "gene"), "gene", names, "gene", "acc")


def shared_entries(spark: SparkSession, sf: str) -> DataFrame:
    """INTERSECT of entry codes."""
    return sets.intersect(bridges(spark, sf).where("pdb_id is not null").select("pdb_id"), polymers(spark, sf).select("pdb_id"))


def entries_without_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return sets.difference(entries(spark, sf), bridges(spark, sf), ["pdb_id"])


def all_codes(spark: SparkSession, sf: str) -> DataFrame:
    return sets.union(bridges(spark, sf).select("pdb_id"), polymers(spark, sf).select("pdb_id"), entries(spark, sf).select("pdb_id")).where("pdb_id is not null").distinct()


def key_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return sets.disjoint(table(spark, sf, "zinc_finger").where("status = 'ok'").select("core"), table(spark, sf, "zinc_finger").where("status <> 'ok'").select("core"), "core")


def claimed_class(spark: SparkSession, sf: str) -> DataFrame:
    """A ligand of several classes goes to the first in order of priority."""
    return sets.claim(bridges(spark, sf).where("ccd_id is not null"), "ccd_id", "ccd_class", ["metal", "cofactor", "inhibitor", "linker"])


def unambiguous_class(spark: SparkSession, sf: str) -> DataFrame:
    return sets.unambiguous(bridges(spark, sf).where("ccd_id is not null and ccd_class is not null"), "ccd_id", "ccd_class")


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """COUNT, MAX and distinct entries by class."""
    return bridges(spark, sf).where("status = 'ok'").groupBy("ccd_class").agg(F.count("*").alias("n"), F.max("dsasa_total").alias("largest"), F.countDistinct("pdb_id").alias("n_entries"))


def class_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, population deviation, extremes and interpolated median of all areas that are a number."""
    b = bridges(spark, sf).where("dsasa_total is not null and not isnan(dsasa_total)").select("ccd_class", F.coalesce("ccd_class", F.lit("\0")).alias("of"), "dsasa_total")
    moments = b.groupBy("of").agg(F.first("ccd_class").alias("ccd_class"), F.avg("dsasa_total").alias("mean"), F.stddev_pop("dsasa_total").alias("deviation"), F.min("dsasa_total").alias("smallest"), F.max("dsasa_total").alias("largest"))
    # the two middle values, one and the same where their number is odd
    low, high = (skew.key_profile(b, ["of"], "dsasa_total", [0.5], by_index=upper).select("of", F.col("q_50").alias(name)) for upper, name in ((False, "low"), (True, "high")))
    median = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") / 2 + F.col("high") / 2)
    return moments.join(low, "of").join(high, "of").select("ccd_class", "mean", "deviation", "smallest", "largest", median.alias("median"))


def entry_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (entry, ligand) pairs of each class."""
    return bridges(spark, sf).where("pdb_id is not null and ccd_id is not null").groupBy("ccd_class").agg(F.countDistinct(F.struct("pdb_id", "ccd_id")).alias("n_pairs"))


def representatives(spark: SparkSession, sf: str) -> DataFrame:
    """The widest bridge of each (entry, ligand)."""
    b = bridges(spark, sf).where("pdb_id is not null and ccd_id is not null and bridging_balance is not null and dsasa_total is not null")
    return clusters.representative(b, ["pdb_id", "ccd_id"], ["bridging_balance", "dsasa_total", "id"], ["structure_file"])


def _series(spark: SparkSession, sf: str) -> DataFrame:
    b = bridges(spark, sf).where("status = 'ok' and ccd_id is not null and dsasa_total is not null and bridging_balance is not null")
    return clusters.pair_series(b, "entity_a", "entity_b", "ccd_id", "pdb_id", "dsasa_total", "bridging_balance", "id")


def pair_series(spark: SparkSession, sf: str) -> DataFrame:
    """Bridges clustered by their unordered pair of partners."""
    return _series(spark, sf)


def leading_series(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.leading(_series(spark, sf), 10, 3).select("name_a", "name_b", "n_members", "n_sources")


def replicate_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of replicate columns, those that are no number left out."""
    values = F.filter(F.array(*(F.col(c).cast("double") for c in ("dsasa_a", "dsasa_b", "buried_fraction"))), lambda x: x.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.nullif(F.size(values), F.lit(0)))
    return bridges(spark, sf).select("id", mean.alias("mean"))


def screen_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of a protein united over its rows: statuses seen, best score, lowest confidence, whether any row was degraded."""
    z = known(table(spark, sf, "zinc_finger")).withColumn("acc", code("uniprot_acc")).where("acc is not null")
    return z.groupBy("acc").agg(F.array_join(F.array_sort(F.collect_set("status")), ";").alias("statuses"), F.max("imid_degradation_score").alias("best"), F.min("mean_plddt").alias("lowest"), F.max("screen_degraded").alias("degraded"))


def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).groupBy("tier").agg(F.count("*").alias("n"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    """At most eight ligands of an entry, the first by name."""
    b = bridges(spark, sf).where("pdb_id is not null and ccd_id is not null").select("pdb_id", "ccd_id").distinct()
    return ranking.top_per_key(b, ["pdb_id"], [F.col("ccd_id")], 8).groupBy("pdb_id").agg(F.array_join(F.array_sort(F.collect_list("ccd_id")), ",").alias("ligands"))


def interface_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Unordered pairs of a structure's lysine sites of different names (a structure's sites are few)."""
    y = table(spark, sf, "lysine").where("res_num is not null").select(code("uniprot_acc").alias("acc"), "structure_id", "site_id", "res_num").where("acc is not null").distinct()
    least = y.groupBy("acc", "structure_id", "site_id").agg(F.min("res_num").alias("res_num"))
    return joins.pairs(least, ["acc", "structure_id"], "res_num", "site_id")


QUERIES = {
    f.__name__: f
    for f in (bridged_proteins, one_sided_bridges, side_changes, merged_ligands, finger_exposure, finger_labels, lonely_fingers, agreeing_codes, gene_or_accession, shared_entries, entries_without_bridge, all_codes, key_overlap, claimed_class, unambiguous_class, class_counts, class_moments, entry_pairs, representatives, pair_series, leading_series, replicate_means, screen_labels, tier_counts, components, interface_pairs)
}

_ACC = "nullif(upper(trim(uniprot_acc, ' ')), '')"
_POLY = f"pol AS (SELECT * REPLACE (nullif(upper(trim(pdb_id, ' ')), '') AS pdb_id, {_ACC} AS uniprot_acc) FROM polymer_entity)"
_WIN = f"""win AS (SELECT DISTINCT {_ACC} AS uniprot_acc, zf_start, zf_end FROM zinc_finger WHERE zf_start <= zf_end AND {_ACC} IS NOT NULL),
  pts AS (SELECT {_ACC} AS uniprot_acc, zf_start + 12 AS lo, zf_end + 12 AS hi, max(CASE WHEN NOT isnan(imid_degradation_score) THEN imid_degradation_score END) AS exposure FROM zinc_finger WHERE has_degron_candidate = 1 AND zf_start <= zf_end AND {_ACC} IS NOT NULL GROUP BY ALL)"""
_MET = "FROM win w LEFT JOIN pts p ON p.uniprot_acc = w.uniprot_acc AND least(hi, zf_end) - greatest(lo, zf_start) + 1 >= {} GROUP BY w.uniprot_acc, zf_start, zf_end"
_SERIES = f"""WITH {BRIDGE_SQL}, s AS (SELECT *, least(entity_a, entity_b) AS name_a, greatest(entity_a, entity_b) AS name_b FROM br WHERE status = 'ok' AND ccd_id IS NOT NULL AND dsasa_total IS NOT NULL AND bridging_balance IS NOT NULL AND entity_a <> entity_b),
  r AS (SELECT *, row_number() OVER (PARTITION BY name_a, name_b ORDER BY dsasa_total) AS i, count(*) OVER (PARTITION BY name_a, name_b) AS n, row_number() OVER (PARTITION BY name_a, name_b ORDER BY bridging_balance DESC, dsasa_total DESC, id DESC) AS w FROM s),
  g AS (SELECT name_a, name_b, count(*) AS n_rows, count(DISTINCT ccd_id) AS n_members, count(DISTINCT pdb_id) AS n_sources, min(CASE WHEN i >= ceil(0.5 * n - 1e-9) THEN dsasa_total END) AS median_size, max(CASE WHEN w = 1 THEN id END) AS widest_id, max(CASE WHEN w = 1 THEN bridging_balance END) AS widest_balance FROM r GROUP BY ALL)"""
_BRIDGED = f"WITH {BRIDGE_SQL}, {_POLY}, ch AS (SELECT pdb_id, trim(l, ' ') AS label, min(uniprot_acc) AS acc FROM (SELECT pdb_id, unnest(string_split(auth_asym_id, ',')) AS l, uniprot_acc FROM pol WHERE uniprot_acc IS NOT NULL AND pdb_id IS NOT NULL) GROUP BY ALL) SELECT id, a.acc AS uniprot_acc_a, b.acc AS uniprot_acc_b FROM br JOIN ch a ON a.pdb_id = br.pdb_id AND a.label = trim(split_part(chain_a, '/', 1), ' ') JOIN ch b ON b.pdb_id = br.pdb_id AND b.label = trim(split_part(chain_b, '/', 1), ' ') WHERE br.status = 'ok' AND a.acc <> b.acc"
SQL = {
    "one_sided_bridges": f"WITH bp AS ({_BRIDGED}), e AS (SELECT DISTINCT {_ACC} AS acc FROM polymer_entity WHERE is_e3 = 1 AND {_ACC} IS NOT NULL), x AS (SELECT *, uniprot_acc_a IN (SELECT acc FROM e) AS in_a, uniprot_acc_b IN (SELECT acc FROM e) AS in_b FROM bp) SELECT id, uniprot_acc_a, uniprot_acc_b, CASE WHEN in_a THEN 'a' ELSE 'b' END AS member_side FROM x WHERE in_a <> in_b",
    "side_changes": f"WITH {BRIDGE_SQL}, m AS (SELECT ccd_class, contacts_a, count(*) AS n, avg(abs(log2(dsasa_a / dsasa_b))) AS mean_change FROM br WHERE ccd_class IS NOT NULL AND contacts_a IS NOT NULL AND dsasa_a > 0 AND dsasa_b > 0 AND isfinite(dsasa_a) AND isfinite(dsasa_b) GROUP BY ALL) SELECT *, CASE WHEN max(mean_change) OVER (PARTITION BY ccd_class) > 0 THEN 0.2::DOUBLE + 0.8::DOUBLE * mean_change / max(mean_change) OVER (PARTITION BY ccd_class) ELSE 0.2::DOUBLE END AS weight FROM m",
    "bridged_proteins": _BRIDGED,
    "merged_ligands": f"WITH {LIGAND_SQL}, {BRIDGE_SQL}, s AS (SELECT ccd_id, min(ccd_class) AS c, min(ligand_label) AS l FROM br WHERE ccd_id IS NOT NULL GROUP BY 1) SELECT coalesce(lig.ccd_id, s.ccd_id) AS ccd_id, coalesce(nullif(trim(name, ' '), ''), l) AS name, coalesce(nullif(trim(ccd_class, ' '), ''), c) AS ccd_class FROM lig FULL JOIN s ON s.ccd_id = lig.ccd_id",
    "finger_exposure": f"WITH {_WIN} SELECT w.uniprot_acc, zf_start, zf_end, coalesce(max(exposure), 0) AS best, count(p.lo) AS n_overlaps {_MET.format(3)}",
    "finger_labels": f"WITH {_WIN} SELECT w.uniprot_acc, zf_start, zf_end, CASE WHEN count(p.lo) > 0 THEN 1 ELSE 0 END AS has_candidate, max(exposure) AS best {_MET.format(1)}",
    "lonely_fingers": f"WITH {_WIN} SELECT w.uniprot_acc, zf_start, zf_end {_MET.format(1)} HAVING count(p.lo) = 0",
    "agreeing_codes": f"WITH {ENTRY_SQL}, {BRIDGE_SQL}, {_POLY} SELECT pdb_id AS key, count(DISTINCT s) AS n_sources FROM (SELECT pdb_id, 1 AS s FROM br UNION ALL SELECT pdb_id, 2 FROM pol UNION ALL SELECT pdb_id, 3 FROM ent) WHERE pdb_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) >= 2",
    "gene_or_accession": f"WITH m AS (SELECT gene, min({_ACC}) AS acc FROM zinc_finger WHERE status = 'ok' AND gene IS NOT NULL AND {_ACC} IS NOT NULL GROUP BY 1) SELECT id, coalesce(acc, z.gene) AS gene FROM zinc_finger z LEFT JOIN m ON m.gene = z.gene WHERE z.gene IS NOT NULL",
    "shared_entries": f"WITH {BRIDGE_SQL}, {_POLY} SELECT pdb_id FROM br WHERE pdb_id IS NOT NULL INTERSECT SELECT pdb_id FROM pol",
    "entries_without_bridge": f"WITH {ENTRY_SQL}, {BRIDGE_SQL} SELECT DISTINCT pdb_id FROM ent WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.pdb_id = ent.pdb_id)",
    "all_codes": f"WITH {ENTRY_SQL}, {BRIDGE_SQL}, {_POLY} SELECT pdb_id FROM (SELECT pdb_id FROM br UNION SELECT pdb_id FROM pol UNION SELECT pdb_id FROM ent) WHERE pdb_id IS NOT NULL",
    "key_overlap": "WITH a AS (SELECT DISTINCT core FROM zinc_finger WHERE status = 'ok' AND core IS NOT NULL), b AS (SELECT DISTINCT core FROM zinc_finger WHERE status <> 'ok' AND core IS NOT NULL) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (core)) AS n_both",
    "claimed_class": f"WITH {BRIDGE_SQL}, p AS (SELECT ccd_id, min(list_position(['metal', 'cofactor', 'inhibitor', 'linker'], ccd_class)) AS i FROM br WHERE ccd_id IS NOT NULL AND ccd_class IN ('metal', 'cofactor', 'inhibitor', 'linker') GROUP BY 1) SELECT ccd_id, ['metal', 'cofactor', 'inhibitor', 'linker'][i] AS ccd_class FROM p",
    "unambiguous_class": f"WITH {BRIDGE_SQL} SELECT ccd_id, min(ccd_class) AS ccd_class FROM br WHERE ccd_id IS NOT NULL AND ccd_class IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ccd_class) = 1",
    "class_counts": f"WITH {BRIDGE_SQL} SELECT ccd_class, count(*) AS n, max(dsasa_total) AS largest, count(DISTINCT pdb_id) AS n_entries FROM br WHERE status = 'ok' GROUP BY 1",
    "class_moments": f"WITH {BRIDGE_SQL} SELECT ccd_class, avg(dsasa_total) AS mean, stddev_pop(dsasa_total) AS deviation, min(dsasa_total) AS smallest, max(dsasa_total) AS largest, median(dsasa_total) AS median FROM br WHERE dsasa_total IS NOT NULL AND NOT isnan(dsasa_total) GROUP BY 1",
    "entry_pairs": f"WITH {BRIDGE_SQL} SELECT ccd_class, count(DISTINCT (pdb_id, ccd_id)) AS n_pairs FROM br WHERE pdb_id IS NOT NULL AND ccd_id IS NOT NULL GROUP BY 1",
    "representatives": f"WITH {BRIDGE_SQL} SELECT pdb_id, ccd_id, bridging_balance, dsasa_total, id, structure_file FROM br WHERE pdb_id IS NOT NULL AND ccd_id IS NOT NULL AND bridging_balance IS NOT NULL AND dsasa_total IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pdb_id, ccd_id ORDER BY bridging_balance DESC, dsasa_total DESC, id DESC) = 1",
    "pair_series": f"{_SERIES} SELECT * FROM g",
    "leading_series": f"{_SERIES} SELECT name_a, name_b, n_members, n_sources FROM g WHERE n_members >= 3 ORDER BY n_members DESC, n_sources DESC, name_a, name_b LIMIT 10",
    "replicate_means": f"WITH {BRIDGE_SQL} SELECT id, list_avg(list_filter([dsasa_a, dsasa_b, buried_fraction], lambda x: x IS NOT NULL)) AS mean FROM br",
    "screen_labels": f"SELECT {_ACC} AS acc, string_agg(DISTINCT status, ';' ORDER BY status) AS statuses, max(CASE WHEN NOT isnan(imid_degradation_score) THEN imid_degradation_score END) AS best, min(CASE WHEN NOT isnan(mean_plddt) THEN mean_plddt END) AS lowest, max(screen_degraded) AS degraded FROM zinc_finger WHERE {_ACC} IS NOT NULL GROUP BY 1",
    "tier_counts": f"WITH {ENTRY_SQL} SELECT tier, count(*) AS n FROM ent GROUP BY 1",
    "components": f"WITH {BRIDGE_SQL}, d AS (SELECT DISTINCT pdb_id, ccd_id FROM br WHERE pdb_id IS NOT NULL AND ccd_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY ccd_id) AS i FROM d) SELECT pdb_id, string_agg(ccd_id, ',' ORDER BY ccd_id) AS ligands FROM r WHERE i <= 8 GROUP BY 1",
    "interface_pairs": f"WITH y AS (SELECT {_ACC} AS acc, structure_id, site_id, min(res_num) AS res_num FROM lysine WHERE res_num IS NOT NULL AND {_ACC} IS NOT NULL GROUP BY ALL) SELECT a.acc, a.structure_id, a.site_id AS site_id_a, a.res_num AS res_num_a, b.site_id AS site_id_b, b.res_num AS res_num_b FROM y a JOIN y b ON a.acc = b.acc AND a.structure_id = b.structure_id AND a.res_num < b.res_num AND a.site_id <> b.site_id",
}
