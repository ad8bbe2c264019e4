"""Rank statistics, sweeps, confusion tables and models over the atlas tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.atlas import bridges, known
from tessera.operators import models
from tessera.operators import statistics as S
from tessera.operators.references import code
from tessera.session import table


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    z = known(table(spark, sf, "zinc_finger")).withColumn("acc", code("uniprot_acc"))
    return z.where("screen_degraded is not null and imid_degradation_score between 0 and 1").select("id", "acc", F.col("imid_degradation_score").alias("score"), F.col("screen_degraded").alias("label"), "mean_plddt", "zf_start", "has_degron_candidate")


def auc(spark: SparkSession, sf: str) -> DataFrame:
    return S.roc_auc(_scored(spark, sf), "score", "label")


def auc_by_protein(spark: SparkSession, sf: str) -> DataFrame:
    return S.grouped_auc(_scored(spark, sf).where("acc is not null"), "acc", "score", "label")


def auc_mean(spark: SparkSession, sf: str) -> DataFrame:
    return S.mean_grouped_auc(_scored(spark, sf).where("acc is not null"), "acc", "score", "label")


def mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    return S.mann_whitney(_scored(spark, sf), "score", "label").drop("p")


def mann_whitney_p(spark: SparkSession, sf: str) -> DataFrame:
    return S.mann_whitney(_scored(spark, sf), "score", "label")


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return S.spearman(_scored(spark, sf), "score", "mean_plddt")


def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return S.pearson(_scored(spark, sf), "score", "mean_plddt")


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return S.sweep(_scored(spark, sf), "score", "label", 0.5, 0.5)


def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return S.best_cut(S.sweep(_scored(spark, sf), "score", "label")).select("cut", "tp", "fp")


def cut_then_test(spark: SparkSession, sf: str) -> DataFrame:
    """The best cut on proteins of even length, tested on the others."""
    z = _scored(spark, sf).where("acc is not null").withColumn("half", F.pmod(F.ascii(F.substring("acc", -1, 1)), F.lit(2)))
    return S.cut_then_test(z.where("half = 0"), z.where("half = 1"), "score", "label")


def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return S.contingency(_scored(spark, sf), F.col("score") >= 0.5, F.col("label") == 1)


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    """The ligand table's class taken as truth, the bridge's as prediction."""
    from tessera.catalog.atlas import ligands

    b = bridges(spark, sf).where("ccd_class is not null").select("ccd_id", F.col("ccd_class").alias("predicted"))
    t = ligands(spark, sf).where("ccd_class is not null").select("ccd_id", F.col("ccd_class").alias("truth"))
    return S.class_report(b.join(t, "ccd_id"), "truth", "predicted")


def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return S.macro_f1(class_report(spark, sf))


def _found_codes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from tessera.catalog.atlas import ligands

    found = bridges(spark, sf).where("status = 'ok' and bridging_balance > 0.5").select("ccd_id")
    return found, ligands(spark, sf).where("ccd_class in ('metal', 'cofactor')").select("ccd_id")


def recall_of_reference(spark: SparkSession, sf: str) -> DataFrame:
    return S.against_reference(*_found_codes(spark, sf), "ccd_id")


def reference_misses(spark: SparkSession, sf: str) -> DataFrame:
    return S.misses(*_found_codes(spark, sf), "ccd_id")


def standardised(spark: SparkSession, sf: str) -> DataFrame:
    z = S.standardise(_scored(spark, sf).select("id", "score", F.col("zf_start").cast("double").alias("place")).where("place is not null"), ["score", "place"])
    return z.select("id", F.round("score", 6).alias("score"), F.round("place", 6).alias("place"))


def permutation_test(spark: SparkSession, sf: str) -> DataFrame:
    return S.permutation_p(_scored(spark, sf), "score", "label", 50, "id")


def metric_report(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics with floors; one that has no data says so."""
    value = S.roc_auc(_scored(spark, sf), "score", "label").first()["auc"]
    return S.envelope(spark, {"auc": (value, S.Floor(0.4), ""), "auc_ceiling": (value, S.Floor(0.99, highest=True), ""), "reach": (None, S.Floor(0.5), "no verdict is fitted"), "size": (None, None, "")})


def best_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The best run of each measure, the smaller being better for one of them."""
    s = table(spark, sf, "task_sample").groupBy("run_id").agg(F.count_if(F.lower(F.trim("split")) == "test").alias("n_test"), F.count_if(F.col("composition").isNull()).alias("n_missing"))
    long = s.select("run_id", F.explode(F.create_map(F.lit("n_test"), F.col("n_test"), F.lit("n_missing"), F.col("n_missing"))).alias("metric", "value"))
    return S.better_round(long, "metric", "run_id", "value", ["n_missing"])


def win_rates(spark: SparkSession, sf: str) -> DataFrame:
    b = bridges(spark, sf)
    return S.win_rate(b, "ccd_class", "dsasa_a", "dsasa_b")


def logistic_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold scores of a balanced logistic regression, folds by protein."""
    z = _scored(spark, sf).where("acc is not null").fillna({"mean_plddt": 0.0, "zf_start": 0, "has_degron_candidate": 0})
    out = models.cross_validated(z, ["score", "mean_plddt", "has_degron_candidate"], "label", "acc", models.logistic(), folds=3)
    return S.roc_auc(out, "prediction", "label")


def ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    z = _scored(spark, sf).where("mean_plddt is not null").fillna({"has_degron_candidate": 0})
    return models.ridge_coefficients(z, ["mean_plddt", "has_degron_candidate"], "score", 1.0)


def boosted_folds(spark: SparkSession, sf: str) -> DataFrame:
    z = _scored(spark, sf).where("acc is not null").fillna({"mean_plddt": 0.0, "has_degron_candidate": 0})
    return S.roc_auc(models.cross_validated(z, ["score", "mean_plddt", "has_degron_candidate"], "label", "acc", models.boosted(), folds=2), "prediction", "label")


QUERIES = {
    f.__name__: f
    for f in (auc, auc_by_protein, auc_mean, mann_whitney, mann_whitney_p, spearman, pearson, threshold_sweep, best_threshold, cut_then_test, contingency, class_report, macro_f1, recall_of_reference, reference_misses, standardised, permutation_test, metric_report, best_rounds, win_rates, logistic_folds, ridge_fit, boosted_folds)
}

from tessera.catalog.atlas import BRIDGE_SQL, LIGAND_SQL  # noqa: E402

_Z = "z AS (SELECT id, nullif(upper(trim(uniprot_acc, ' ')), '') AS acc, imid_degradation_score AS score, screen_degraded AS label, CASE WHEN NOT isnan(mean_plddt) THEN mean_plddt END AS mean_plddt, zf_start FROM zinc_finger WHERE screen_degraded IS NOT NULL AND imid_degradation_score BETWEEN 0 AND 1)"
_AUC = "(SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*) FROM {0} p, {0} n WHERE p.label = 1 AND n.label <> 1)"
_RANKED = "r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM z)"
_SWEEP = "cuts AS (SELECT DISTINCT score AS cut FROM {0} UNION SELECT 0.0), sw AS (SELECT cut, count(*) FILTER (score > 0 AND score >= cut AND label = 1) AS tp, count(*) FILTER (score > 0 AND score >= cut AND label <> 1) AS fp, count(*) FILTER (NOT (score > 0 AND score >= cut) AND label = 1) AS fn, count(*) FILTER (NOT (score > 0 AND score >= cut) AND label <> 1) AS tn FROM cuts, {0} GROUP BY 1)"
_REPORT = f"WITH {LIGAND_SQL}, {BRIDGE_SQL}, j AS (SELECT br.ccd_class AS p, lig.ccd_class AS t FROM br JOIN lig USING (ccd_id) WHERE br.ccd_class IS NOT NULL AND lig.ccd_class IS NOT NULL), c AS (SELECT DISTINCT p AS class FROM j UNION SELECT DISTINCT t FROM j), k AS (SELECT class, count(*) FILTER (p = class AND t = class) AS tp, count(*) FILTER (p = class) AS n_predicted, count(*) FILTER (t = class) AS support FROM c, j GROUP BY 1), q AS (SELECT *, coalesce(tp / nullif(n_predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM k), rep AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q)"
_SETS = f"WITH {LIGAND_SQL}, {BRIDGE_SQL}, a AS (SELECT DISTINCT ccd_id FROM br WHERE status = 'ok' AND bridging_balance > 0.5 AND ccd_id IS NOT NULL), b AS (SELECT DISTINCT ccd_id FROM lig WHERE ccd_class IN ('metal', 'cofactor'))"
SQL = {
    "auc": f"WITH {_Z} SELECT (SELECT count(*) FROM z WHERE label = 1) AS n_pos, (SELECT count(*) FROM z WHERE label <> 1) AS n_neg, {_AUC.format('z')} AS auc",
    "auc_by_protein": f"WITH {_Z} SELECT p.acc, count(DISTINCT p.id) AS n_pos, count(DISTINCT n.id) AS n_neg, sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM z p JOIN z n ON n.acc = p.acc WHERE p.label = 1 AND n.label <> 1 GROUP BY 1",
    "auc_mean": f"WITH {_Z}, g AS (SELECT p.acc, sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM z p JOIN z n ON n.acc = p.acc WHERE p.label = 1 AND n.label <> 1 GROUP BY 1) SELECT count(*) AS n_groups, avg(auc) AS mean_auc FROM g",
    "mann_whitney": f"WITH {_Z}, {_RANKED}, t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM z GROUP BY score)), o AS (SELECT CAST(count(*) FILTER (label = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (label <> 1) AS DOUBLE) AS n2, sum(CASE WHEN label = 1 THEN rk END) AS rs FROM r) SELECT CAST(n1 AS BIGINT) AS n_pos, CAST(n2 AS BIGINT) AS n_neg, rs - n1 * (n1 + 1) / 2 AS u, (rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM o, t",
    "spearman": f"WITH {_Z}, k AS (SELECT * FROM z WHERE mean_plddt IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY mean_plddt) + (count(*) OVER (PARTITION BY mean_plddt) - 1) / 2.0 AS b FROM k) SELECT count(*) AS n, corr(a, b) AS spearman FROM r",
    "pearson": f"WITH {_Z} SELECT count(*) AS n, corr(score, mean_plddt) AS pearson FROM z WHERE mean_plddt IS NOT NULL",
    "threshold_sweep": f"WITH {_Z}, {_SWEEP.format('z')} SELECT *, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity, tp / (tp + fn) + tn / (tn + fp) - 1 AS youden, tp / (tp + fn) >= 0.5 AND tn / (tn + fp) >= 0.5 AS passes FROM sw",
    "best_threshold": f"WITH {_Z}, {_SWEEP.format('z')} SELECT cut, tp, fp FROM sw ORDER BY tp / (tp + fn) + tn / (tn + fp) - 1 DESC, cut LIMIT 1",
    "cut_then_test": f"WITH {_Z}, e AS (SELECT * FROM z WHERE ascii(right(acc, 1)) % 2 = 0), o AS (SELECT * FROM z WHERE ascii(right(acc, 1)) % 2 = 1), {_SWEEP.format('e')}, b AS (SELECT cut FROM sw ORDER BY tp / (tp + fn) + tn / (tn + fp) - 1 DESC, cut LIMIT 1) SELECT any_value(cut) AS cut, count(*) FILTER (score > 0 AND score >= cut AND label = 1) AS tp, count(*) FILTER (score > 0 AND score >= cut AND label <> 1) AS fp, count(*) FILTER (NOT (score > 0 AND score >= cut) AND label = 1) AS fn, count(*) FILTER (NOT (score > 0 AND score >= cut) AND label <> 1) AS tn, any_value({_AUC.format('o')}) AS auc FROM o, b",
    "contingency": f"WITH {_Z} SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn FROM z",
    "class_report": f"{_REPORT} SELECT * FROM rep",
    "macro_f1": f"{_REPORT} SELECT avg(f1) AS macro_f1, sum(tp) / sum(support) AS accuracy, count(*) AS n_classes FROM rep",
    "recall_of_reference": f"{_SETS}, o AS (SELECT (SELECT count(*) FROM a JOIN b USING (ccd_id)) AS tp, (SELECT count(*) FROM a) AS n_found, (SELECT count(*) FROM b) AS n_reference) SELECT *, tp / n_found AS precision, tp / n_reference AS recall FROM o",
    "reference_misses": f"{_SETS} SELECT ccd_id FROM b WHERE ccd_id NOT IN (SELECT ccd_id FROM a) ORDER BY 1 LIMIT 200",
    "standardised": f"WITH {_Z} SELECT id, round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 6) AS score, round((zf_start - avg(zf_start) OVER ()) / stddev_pop(zf_start) OVER (), 6) AS place FROM z WHERE zf_start IS NOT NULL",
    "best_rounds": "WITH s AS (SELECT run_id, count(*) FILTER (lower(trim(split, ' ')) = 'test') AS n_test, count(*) FILTER (composition IS NULL) AS n_missing FROM task_sample GROUP BY 1), l AS (SELECT run_id, 'n_test' AS metric, n_test AS value, -n_test AS k FROM s UNION ALL SELECT run_id, 'n_missing', n_missing, n_missing FROM s) SELECT metric, run_id AS best_round, value AS best_value FROM l QUALIFY row_number() OVER (PARTITION BY metric ORDER BY k, run_id) = 1",
    "win_rates": f"WITH {BRIDGE_SQL} SELECT ccd_class, count(*) AS n, avg(CASE WHEN dsasa_a > dsasa_b THEN 1.0 ELSE 0.0 END) AS win_rate FROM br WHERE dsasa_a IS NOT NULL AND dsasa_b IS NOT NULL GROUP BY 1",
}
