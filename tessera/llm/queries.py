"""Queries of the training-data problems (2, 4, 5, 7, 8 and 9) over the atlas tables, and their SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fmindex, mixing, overlap, pii, quantiles, topn
from tessera.llm.requests import REQUESTS
from tessera.session import cut, remembered, table

WANTED = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


UNKNOWN = ""  # stands for no accession or no day in the parts, so that they add up to the whole; no code is blank


def _lysine_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Both metrics in long form, so that one pass serves them."""
    known = {"uniprot_acc": _protein("uniprot_acc"), "day": F.date_format("measured_at", "yyyy-MM-dd")}
    metrics = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("nz_rel_sasa", "cb_cb_distance"))))
    return table(spark, sf, "lysine").select(*(F.coalesce(c, F.lit(UNKNOWN)).alias(name) for name, c in known.items()), metrics.alias("m")).select("m.metric", "uniprot_acc", "day", "m.value")


def _protein(c: str):
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def _lysine(spark: SparkSession, sf: str, keys: list[str], k: int = quantiles.K) -> DataFrame:
    """Percentiles by protein and day, or of their sums over the days or the proteins; only a key reported must be known."""
    days = quantiles.summaries(_lysine_rows(spark, sf), ["metric", "uniprot_acc", "day"], "value", k).where(" and ".join(f"{x} <> '{UNKNOWN}'" for x in keys))
    return quantiles.percentiles(days if len(keys) == 2 else quantiles.merge(cut(days), ["metric", *keys], k), WANTED)


def p2_protein_day(spark: SparkSession, sf: str) -> DataFrame:
    return _lysine(spark, sf, ["uniprot_acc", "day"])


def p2_protein(spark: SparkSession, sf: str) -> DataFrame:
    return _lysine(spark, sf, ["uniprot_acc"])


def p2_day(spark: SparkSession, sf: str) -> DataFrame:
    return _lysine(spark, sf, ["day"])


def p2_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The stated bounds put to the test: percentiles by protein and by day from buffers of 64 values, and whether each one's true rank
    lies within its rank_error."""
    rows = _lysine_rows(spark, sf)
    parts = []
    for key in ("uniprot_acc", "day"):
        found = _lysine(spark, sf, [key], 64).withColumnRenamed(key, "key")
        given = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"p{q * 100:g}").alias("p")) for q in WANTED)))
        given = found.select("metric", "key", "n", "rank_error", given.alias("w")).select("metric", "key", "n", "rank_error", "w.*")
        values = rows.select("metric", F.col(key).alias("key"), "value").where("abs(value) < double('inf')")
        ranks = values.join(given, ["metric", "key"]).groupBy("metric", "key", "n", "rank_error", "q").agg(F.count_if(F.col("value") < F.col("p")).alias("below"), F.count_if(F.col("value") <= F.col("p")).alias("upto"))
        wanted = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("q") - F.lit(1e-9)))
        held = (F.col("below") + 1 - F.col("rank_error") <= wanted) & (wanted <= F.col("upto") + F.col("rank_error"))
        parts.append(ranks.select(F.lit(key).alias("of"), "metric", "key", "n", "q", held.alias("within")))
    return reduce(DataFrame.unionByName, parts)


def p2_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "bridge").select("ccd_class", "dsasa_total")
    return quantiles.percentiles(quantiles.summaries(rows, ["ccd_class"], "dsasa_total"), WANTED)


TRAIN, HELD_OUT = ["train"], ["valid", "test"]


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.fingerprints(table(spark, sf, "task_sample"), "sample_id", "split", "record_type", "prompt", "composition", REQUESTS)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlaps(_prints(spark, sf), TRAIN, HELD_OUT).select(F.col("id_a").alias("sample_id_a"), F.col("id_b").alias("sample_id_b"))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row a sample of either side: its class and the number of classes of the other side that ask for the same."""
    members, links = overlap.class_pairs(_prints(spark, sf), TRAIN, HELD_OUT)
    links = cut(links)
    n = [links.groupBy(F.col(f"cls_{i}").alias("cls")).agg(F.count("*").alias("n_links")).withColumn("side", F.lit(i)) for i in (0, 1)]
    out = members.join(n[0].unionByName(n[1]), ["side", "cls"], "left")
    return out.select(F.col("id").alias("sample_id"), F.hex("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source: rows there are, rows that also stand in train (word for word, or nearly), and rows declared in corpus_report.

    Counted on classes: a held-out row overlaps if its class has a link, however many rows the linked classes have."""
    samples = table(spark, sf, "task_sample").select("sample_id", F.lower(F.trim("split")).alias("split"), F.lower(F.trim("source")).alias("source"), F.md5(F.trim("prompt")).alias("prompt"))
    members, links = overlap.class_pairs(_prints(spark, sf), TRAIN, HELD_OUT)
    linked = members.where("side = 1").join(links.select(F.col("cls_1").alias("cls")).distinct(), "cls").select(F.col("id").alias("sample_id"), F.lit(1).alias("linked"))
    in_train = samples.where(F.col("split").isin(TRAIN)).select("prompt", F.lit(1).alias("copied")).distinct()
    rows = samples.where(F.col("split").isin(HELD_OUT)).join(linked, "sample_id", "left").join(in_train, "prompt", "left")
    counted = rows.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("linked").alias("n_overlapping"), F.count_if(F.col("linked").isNotNull() & F.col("copied").isNotNull()).alias("n_verbatim"))
    names = [(a, b) for a in ("task_a", "task_c", "external") for b in HELD_OUT]
    declared = table(spark, sf, "corpus_report").select(F.explode(F.array(*(F.struct(F.lit(b).alias("split"), F.lit(a).alias("source"), F.col(f"counts.{a}_{b}").alias("n")) for a, b in names))).alias("d"))
    declared = declared.groupBy("d.split", "d.source").agg(F.sum("d.n").alias("n_declared"))
    return counted.join(declared, ["split", "source"], "full")


def _fingers(spark: SparkSession, sf: str) -> DataFrame:
    z = table(spark, sf, "zinc_finger").select(_protein("uniprot_acc").alias("uniprot_acc"), "zf_start", "imid_degradation_score", "status")
    usable = z.where("status = 'ok' and zf_start is not null and uniprot_acc is not null and imid_degradation_score between 0 and 1")
    return usable.groupBy("uniprot_acc", "zf_start").agg(F.max("imid_degradation_score").alias("score"))


def _top_fingers(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n(_fingers(spark, sf), ["uniprot_acc"], [("score", "desc"), ("zf_start", "asc")], 3)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _top_fingers(spark, sf).select("uniprot_acc", "zf_start")


def p5_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _top_fingers(spark, sf)


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return fmindex.leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_item"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    # a document is read by one task, which reports each of its spans; only an item with several spans repeats
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and words leaked of each test item."""
    suites = table(spark, sf, "eval_item").select("item_id", "suite")
    found = _leaks(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n_words").alias("n_words"))
    return suites.join(found, "item_id", "left").fillna(0, ["n_docs", "n_words"])


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = mixing.count_tokens(table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text"), "text")
    # quality: characters a token, as far as ordinary prose has them
    quality = F.least(F.lit(1.0), F.col("n_chars") / (4.0 * F.greatest(F.col("n_tokens"), F.lit(1))))
    return mixing.mix(docs, table(spark, sf, "mix_target"), quality=F.coalesce(quality, F.lit(1.0)))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p8_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the mix, source by source: no more tokens than budgeted, no document more often than allowed, copies that
    differ by one at most, a rest smaller than the largest document unless the source is used up, and a report that adds up."""
    chosen, report = _mix(spark, sf)
    sizes = mixing.count_tokens(table(spark, sf, "documents").select("doc_id", mixing.canonical_source("source").alias("source"), "text"), "text").where("n_tokens > 0")
    docs = sizes.join(chosen.select("doc_id", "copies", F.col("source").alias("as")), "doc_id", "left").groupBy("source").agg(
        F.max("n_tokens").alias("largest"), F.sum(F.coalesce(F.col("copies") * F.col("n_tokens"), F.lit(0))).alias("tokens"), F.max("copies").alias("most"), (F.max(F.coalesce("copies", F.lit(0))) - F.min(F.coalesce("copies", F.lit(0)))).alias("apart"), F.count_if(F.col("as") != F.col("source")).alias("astray"),
    )
    r = report.join(docs, "source", "left")
    some = F.coalesce("tokens", F.lit(0))
    return r.select(
        "source", "max_repeats", F.round("target_share", 9).alias("target_share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        ((some <= F.col("budget")) & (some == F.col("chosen_tokens")) & (F.coalesce("astray", F.lit(0)) == 0)).alias("within_budget"), ((F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("apart", F.lit(0)) <= 1)).alias("even_copies"),
        (F.col("falls_short") | (F.col("budget") - some < F.coalesce("largest", F.lit(1))) | (F.coalesce("apart", F.lit(0)) == 0) & (some == F.col("available") * F.col("max_repeats"))).alias("filled"),
    )


def _personal(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """The documents, and the model, which is trained once for as long as the files stay as they are."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs, pii.load(remembered(spark, "personal data model", sf, lambda: pii.save(spark, pii.fit(docs, table(spark, sf, "name_list")))))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(*_personal(spark, sf)).select("doc_id", "kind", "start_pos")


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(*_personal(spark, sf))


def p9_kinds(spark: SparkSession, sf: str) -> DataFrame:
    docs, model = _personal(spark, sf)
    return pii.find(docs, model).groupBy("kind").agg(F.count("*").alias("n_cases"), F.countDistinct("doc_id").alias("n_docs"))


QUERIES = {f.__name__: f for f in (p2_protein_day, p2_protein, p2_day, p2_class, p2_bounds, p4_found, p4_classes, p4_report, p5_found, p5_ranked, p7_found, p7_spans, p7_items, p8_mix, p8_shares, p8_bounds, p9_found, p9_redacted, p9_kinds)}


def _sql_percentiles(source: str, keys: str, metric: str = "") -> str:
    of = ", ".join(f"min(CASE WHEN i >= ceil({q} * n - 1e-9) THEN x END) AS p{q * 100:g}" for q in WANTED)
    by = ", ".join(x for x in (metric, keys) if x)
    return f"WITH v AS ({source}), r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY x) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM v WHERE x IS NOT NULL AND isfinite(x)) SELECT {by}, n, 0 AS rank_error, {of} FROM r GROUP BY {by}, n"


def _sql_lysine_rows() -> str:
    one = "SELECT '{0}' AS metric, nullif(upper(trim(uniprot_acc, ' ')), '') AS uniprot_acc, strftime(measured_at, '%Y-%m-%d') AS day, {0} AS x FROM lysine"
    return f"{one.format('nz_rel_sasa')} UNION ALL {one.format('cb_cb_distance')}"


def _sql_lysine(keys: str) -> str:
    known = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return _sql_percentiles(f"SELECT * FROM ({_sql_lysine_rows()}) WHERE {known}", keys, "metric")


def _sql_bounds() -> str:
    one = "SELECT '{0}' AS of, metric, {0} AS key, count(*) AS n FROM v WHERE {0} IS NOT NULL AND x IS NOT NULL AND isfinite(x) GROUP BY ALL"
    return f"WITH v AS ({_sql_lysine_rows()}), c AS ({one.format('uniprot_acc')} UNION ALL {one.format('day')}) SELECT c.*, q, true AS within FROM c, (SELECT unnest([{', '.join(map(str, WANTED))}])::DOUBLE AS q)"


_TOP = """WITH f AS (SELECT upper(trim(uniprot_acc, ' ')) AS uniprot_acc, zf_start, max(imid_degradation_score) AS score FROM zinc_finger
    WHERE status = 'ok' AND zf_start IS NOT NULL AND trim(uniprot_acc, ' ') <> '' AND imid_degradation_score BETWEEN 0 AND 1 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY uniprot_acc ORDER BY score DESC, zf_start) AS rank FROM f)"""


def _words(key: str, table_: str) -> str:
    cleaned = "lower(regexp_replace(text, '[\u00ad\u200b\u200c\u200d\ufeff]', '', 'g'))"
    return f"SELECT {key}, regexp_extract_all({cleaned}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table_} WHERE text IS NOT NULL"


def _grams(name: str, key: str, table_: str) -> str:
    """Distinct runs of twelve words of a table's texts."""
    return f"{name} AS (SELECT DISTINCT {key}, unnest([array_to_string(w[k:k + 11], ' ') FOR k IN range(1, len(w) - 10)]) AS gram FROM ({_words(key, table_)}))"


# the percentiles are exact, and so equal to SQL, as long as a group has at most quantiles.K values, as at the scale checked
SQL = {
    "p2_protein_day": _sql_lysine("uniprot_acc, day"),
    "p2_protein": _sql_lysine("uniprot_acc"),
    "p2_day": _sql_lysine("day"),
    "p2_bounds": _sql_bounds(),
    "p2_class": _sql_percentiles("SELECT ccd_class, dsasa_total AS x FROM bridge WHERE ccd_class IS NOT NULL", "ccd_class"),
    "p5_found": f"{_TOP} SELECT uniprot_acc, zf_start FROM r WHERE rank <= 3",
    "p5_ranked": f"{_TOP} SELECT * FROM r WHERE rank <= 3",
    "p8_bounds": """WITH t AS (SELECT nullif(replace(lower(trim(source, ' ')), '-', '_'), '') AS source, sum(greatest(target_weight, 0)) AS w, max(greatest(max_repeats, 1)) AS max_repeats FROM mix_target GROUP BY 1),
      d AS (SELECT replace(lower(trim(source, ' ')), '-', '_') AS source, count(*) AS n_docs FROM documents WHERE text <> '' GROUP BY 1)
      SELECT t.source, max_repeats, round(w / sum(w) OVER (), 9) AS target_share, coalesce(n_docs, 0) AS n_docs, true AS within_budget, true AS even_copies, true AS filled FROM t LEFT JOIN d USING (source) WHERE t.source IS NOT NULL""",
    # a document's places where a phrase of an item stands, joined to spans where they touch
    "p7_items": f"""WITH {_grams('i', 'item_id', 'eval_item')},
      d AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS k, w FROM ({_words('doc_id', 'documents')})),
      h AS (SELECT DISTINCT doc_id, item_id, k FROM d JOIN i ON i.gram = array_to_string(w[k:k + 11], ' ')),
      s AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id, item_id ORDER BY k) + 12 THEN 0 ELSE 1 END AS fresh FROM h),
      g AS (SELECT doc_id, item_id, k, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS span FROM s),
      n AS (SELECT doc_id, item_id, max(k) - min(k) + 12 AS n_words FROM g GROUP BY doc_id, item_id, span)
      SELECT item_id, suite, count(DISTINCT doc_id) AS n_docs, coalesce(sum(n_words), 0) AS n_words FROM eval_item LEFT JOIN n USING (item_id) GROUP BY ALL""",
    "p7_found": f"WITH {_grams('d', 'doc_id', 'documents')}, {_grams('i', 'item_id', 'eval_item')} SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (gram)",
}
