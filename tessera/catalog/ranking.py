"""Ranks, windows, deduplication, quantiles and top-k over the atlas tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.atlas import known
from tessera.operators import prefix, ranking
from tessera.operators.references import code
from tessera.session import table


def _fingers(spark: SparkSession, sf: str) -> DataFrame:
    z = known(table(spark, sf, "zinc_finger")).withColumn("acc", code("uniprot_acc"))
    return z.where("acc is not null and imid_degradation_score is not null").withColumnRenamed("imid_degradation_score", "score")


def global_rank(spark: SparkSession, sf: str) -> DataFrame:
    """1, 2, 3 ... over the whole table, by ranges and not in one partition."""
    return prefix.ordinal(_fingers(spark, sf).select("id", "score"), [F.desc("score"), F.col("id")])


def running_sum(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", F.col("value").cast("decimal(18,4)").alias("value"))
    return prefix.running(e, [F.col("ts"), F.col("event_id")], {"total": F.col("value")}).select("event_id", F.col("total").cast("double").alias("total"))


def average_rank(spark: SparkSession, sf: str) -> DataFrame:
    return prefix.average_ranks(_fingers(spark, sf), "score")


def top_per_protein(spark: SparkSession, sf: str) -> DataFrame:
    z = _fingers(spark, sf).select("acc", "id", "score")
    return ranking.top_per_key(z, ["acc"], [F.desc("score"), F.col("id")], 5)


def first_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Keep-first on the natural key."""
    z = _fingers(spark, sf).where("zf_start is not null").select("acc", "zf_start", "id", "status")
    return ranking.first_per_key(z, ["acc", "zf_start"], [F.col("id")])


def latest_delivery(spark: SparkSession, sf: str) -> DataFrame:
    z = _fingers(spark, sf).where("zf_start is not null")
    return ranking.min_by_key(z, ["acc", "zf_start"], ["loaded_at", "id"], ["status"], largest=True).select("acc", "zf_start", "id", "status")


def smallest_value(spark: SparkSession, sf: str) -> DataFrame:
    """Argmin per (user, type), the earlier event of equals."""
    return ranking.min_by_key(table(spark, sf, "events"), ["user_id", "event_type"], ["value", "event_id"], [])


def fdr_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Benjamini-Hochberg within each event type; the p-value is a rank-free function of the value."""
    e = table(spark, sf, "events").select("event_id", "event_type", (F.pmod(F.col("event_id") * 7919, F.lit(10007)) / 10007.0).alias("p"))
    out = ranking.benjamini_hochberg(e, "p", ["event_type"])
    return out.withColumn("depleted", (F.col("q") < 0.1).cast("int")).select("event_id", "q", "depleted")


def fdr_overall(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.pmod(F.col("event_id") * 7919, F.lit(997)) / 997.0).alias("p"))
    return ranking.benjamini_hochberg(e, "p").select("event_id", "q")


def scaled_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the largest value and of the largest group."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return ranking.group_size_share(ranking.share_of_largest(s, {"s_acctbal": "balance_share"}), "s_nationkey", "nation_share").select("s_suppkey", "balance_share", "nation_share")


def finger_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive residues of a protein with a measured lysine."""
    y = table(spark, sf, "lysine").select(code("uniprot_acc").alias("acc"), "res_num").where("acc is not null and res_num is not null").distinct()
    return ranking.runs(y, ["acc"], "res_num", F.col("res_num") > 0, 2)


def adjacent_runs(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.adjacent(finger_runs(spark, sf), ["acc"], "run_begin", ["run_begin", "run_end"])


def _residues(spark: SparkSession, sf: str) -> DataFrame:
    y = known(table(spark, sf, "lysine")).select(code("uniprot_acc").alias("acc"), "res_num", "nz_rel_sasa", "observed_digly").where("acc is not null and res_num is not null")
    return y.groupBy("acc", "res_num").agg(F.max("nz_rel_sasa").alias("exposure"), F.max("observed_digly").alias("observed"))


def sliding_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.sliding_mean(_residues(spark, sf), ["acc"], "res_num", "exposure", 5).select("acc", "res_num", "mean")


def neighbour_composition(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.neighbour_share(_residues(spark, sf), ["acc"], "res_num", F.coalesce(F.col("observed") == 1, F.lit(False)), 5).select("acc", "res_num", "share")


def furthest_site(spark: SparkSession, sf: str) -> DataFrame:
    """The embedding furthest from its label's centroid, in three dimensions."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)))
    return ranking.furthest(e, ["label"], ["x0", "x1", "x2"], "vec_id").select("label", "vec_id", F.round("distance", 6).alias("distance"))


def index_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.index_quantiles(table(spark, sf, "events"), "value", [0.1, 0.25, 0.5, 0.75, 0.9], ["event_type"])


def thinned_curve(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.thinned(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 24)


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: 20 rows of each class in hash order."""
    return ranking.per_class(table(spark, sf, "events").select("event_id", "event_type"), "event_type", 20, 11, "event_id")


def group_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Splits that keep a user's events together."""
    return ranking.group_split(table(spark, sf, "events"), "user_id", {"train": 0.8, "valid": 0.1, "test": 0.1}, 3).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


def composition_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Requests split by the conditions they are composed of; requests of a single condition are always in train."""
    s = table(spark, sf, "task_sample").where("fields is not null and size(fields) > 0")
    parts = F.filter("fields", lambda x: x.isNotNull())
    return ranking.composition_split(s, parts, 0.2, "side").select("sample_id", "side")


def best_window(spark: SparkSession, sf: str) -> DataFrame:
    """The best finger of each protein (MAX per protein with its row)."""
    z = _fingers(spark, sf).withColumn("turn", -F.col("id"))
    return ranking.min_by_key(z, ["acc"], ["score", "turn"], ["id"], largest=True).select("acc", "id", "score")


def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by tier, then size, then id: the first hundred."""
    o = table(spark, sf, "orders").withColumn("tier", F.when(F.col("o_totalprice") > 300000, 1).when(F.col("o_totalprice") > 100000, 2).otherwise(3))
    return o.orderBy("tier", F.desc("o_totalprice"), "o_orderkey").select("tier", "o_orderkey").limit(100)


QUERIES = {
    f.__name__: f
    for f in (global_rank, running_sum, average_rank, top_per_protein, first_delivery, latest_delivery, smallest_value, fdr_by_type, fdr_overall, scaled_scores, finger_runs, adjacent_runs, sliding_exposure, neighbour_composition, furthest_site, index_quantiles, thinned_curve, stratified_sample, group_splits, composition_splits, best_window, priority_queue)
}

_F = "f AS (SELECT *, nullif(upper(trim(uniprot_acc, ' ')), '') AS acc, imid_degradation_score AS score FROM zinc_finger WHERE nullif(upper(trim(uniprot_acc, ' ')), '') IS NOT NULL AND imid_degradation_score IS NOT NULL AND NOT isnan(imid_degradation_score))"
_R = """y AS (SELECT DISTINCT nullif(upper(trim(uniprot_acc, ' ')), '') AS acc, res_num FROM lysine WHERE nullif(upper(trim(uniprot_acc, ' ')), '') IS NOT NULL AND res_num IS NOT NULL),
  k AS (SELECT acc, res_num, res_num - row_number() OVER (PARTITION BY acc ORDER BY res_num) AS g FROM y WHERE res_num > 0),
  runs AS (SELECT acc, min(res_num) AS run_begin, max(res_num) AS run_end, count(*) AS run_length FROM k GROUP BY acc, g HAVING count(*) >= 2)"""
_S = "r AS (SELECT nullif(upper(trim(uniprot_acc, ' ')), '') AS acc, res_num, max(CASE WHEN NOT isnan(nz_rel_sasa) THEN nz_rel_sasa END) AS exposure, max(observed_digly) AS observed FROM lysine WHERE nullif(upper(trim(uniprot_acc, ' ')), '') IS NOT NULL AND res_num IS NOT NULL GROUP BY ALL)"
_BH = "least(1.0, min(p * n / i) OVER ({} ORDER BY p DESC, event_id DESC ROWS UNBOUNDED PRECEDING))"
SQL = {
    "global_rank": f"WITH {_F} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f",
    "running_sum": "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM events",
    "average_rank": f"WITH {_F}, c AS (SELECT score, count(*) AS ties FROM f GROUP BY 1) SELECT score, ties, sum(ties) OVER (ORDER BY score) - (ties - 1) / 2.0 AS rank FROM c",
    "top_per_protein": f"WITH {_F} SELECT acc, id, score, row_number() OVER (PARTITION BY acc ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 5",
    "first_delivery": f"WITH {_F} SELECT acc, zf_start, id, status FROM f WHERE zf_start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY acc, zf_start ORDER BY id) = 1",
    "latest_delivery": f"WITH {_F} SELECT acc, zf_start, id, status FROM f WHERE zf_start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY acc, zf_start ORDER BY loaded_at DESC, id DESC) = 1",
    "smallest_value": "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) = 1",
    "fdr_by_type": f"WITH e AS (SELECT event_id, event_type, (event_id * 7919) % 10007 / 10007.0::DOUBLE AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e) , q AS (SELECT event_id, event_type, p, {_BH.format('PARTITION BY event_type')} AS q0 FROM r), m AS (SELECT event_id, min(q0) OVER (PARTITION BY event_type, p) AS q FROM q) SELECT event_id, q, CASE WHEN q < 0.1 THEN 1 ELSE 0 END AS depleted FROM m",
    "fdr_overall": f"WITH e AS (SELECT event_id, (event_id * 7919) % 997 / 997.0::DOUBLE AS p FROM events), r AS (SELECT *, row_number() OVER (ORDER BY p, event_id) AS i, count(*) OVER () AS n FROM e), q AS (SELECT event_id, p, {_BH.format('')} AS q0 FROM r) SELECT event_id, min(q0) OVER (PARTITION BY p) AS q FROM q",
    "scaled_scores": "SELECT s_suppkey, s_acctbal / max(s_acctbal) OVER () AS balance_share, n / max(n) OVER () AS nation_share FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)",
    "finger_runs": f"WITH {_R} SELECT * FROM runs",
    "adjacent_runs": f"WITH {_R} SELECT * FROM (SELECT *, lead(run_begin) OVER (PARTITION BY acc ORDER BY run_begin) AS run_begin_next, lead(run_end) OVER (PARTITION BY acc ORDER BY run_begin) AS run_end_next FROM runs) WHERE run_begin_next IS NOT NULL",
    "sliding_exposure": f"WITH {_S} SELECT acc, res_num, avg(exposure) OVER (PARTITION BY acc ORDER BY res_num RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mean FROM r",
    "neighbour_composition": f"WITH {_S}, o AS (SELECT *, CASE WHEN observed = 1 THEN 1 ELSE 0 END AS one FROM r) SELECT acc, res_num, (sum(one) OVER w - one) / nullif(count(*) OVER w - 1, 0) AS share FROM o WINDOW w AS (PARTITION BY acc ORDER BY res_num RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)",
    "furthest_site": "WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), d AS (SELECT *, sqrt((a - avg(a) OVER w) ** 2 + (b - avg(b) OVER w) ** 2 + (c - avg(c) OVER w) ** 2) AS distance FROM e WINDOW w AS (PARTITION BY label)) SELECT label, vec_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) = 1",
    "index_quantiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, n, " + ", ".join(f"max(CASE WHEN i = least(n - 1, floor(n * {q}::DOUBLE)) THEN value END) AS q{q * 100:g}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM r WHERE n >= 5 GROUP BY 1, 2",
    "thinned_curve": "SELECT o_orderkey, o_totalprice FROM orders QUALIFY (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) % (SELECT greatest(1, count(*) // 24) FROM orders) = 0",
    "composition_splits": "WITH k AS (SELECT sample_id, list_sort(list_distinct(list_filter(fields, lambda x: x IS NOT NULL))) AS k FROM task_sample WHERE len(fields) > 0) SELECT sample_id, CASE WHEN len(k) > 1 AND ('0x' || substr(md5(array_to_string(k, '|')), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'held_out' ELSE 'train' END AS side FROM k",
    "best_window": f"WITH {_F} SELECT acc, id, score FROM f QUALIFY row_number() OVER (PARTITION BY acc ORDER BY score DESC, id) = 1",
    "priority_queue": "SELECT CASE WHEN o_totalprice > 300000 THEN 1 WHEN o_totalprice > 100000 THEN 2 ELSE 3 END AS tier, o_orderkey FROM orders ORDER BY tier, o_totalprice DESC, o_orderkey LIMIT 100",
}
