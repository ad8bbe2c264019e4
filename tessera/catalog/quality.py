"""Queries of the general data-quality problems (1, 3 and 6) over the atlas tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import references as R
from tessera.operators import skew
from tessera.session import scratch, table
from tessera.sources import delimited as D


def _resolution(text: str) -> float | None:
    if text == "":
        return None
    value = D.matching(r"[0-9]+(\.[0-9]+)?", float)(text)
    if not 0 < value <= 100:
        raise ValueError(text)
    return value


def _date(text: str) -> datetime.date:
    return D.matching(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", datetime.date.fromisoformat)(text)


_CHAIN = D.matching(r"[A-Za-z0-9]{1,4}")
ANNOTATION = [
    D.Field("pdb_id", T.StringType(), D.matching(r"[0-9][A-Za-z0-9]{3}|[Pp][Dd][Bb]_[A-Za-z0-9]{8}", str.upper)),
    D.Field("receptor_chain", T.StringType(), _CHAIN),
    D.Field("resolution", T.DoubleType(), _resolution),
    D.Field("binding_site_id", T.StringType(), D.matching(r"BS[0-9]{2,3}")),
    D.Field("ccd_id", T.StringType(), D.matching(r"[A-Za-z0-9]{1,5}", str.upper)),
    D.Field("ligand_chain", T.StringType(), _CHAIN),
    D.Field("site_residues", T.StringType(), str),
    D.Field("remark", T.StringType(), str),
    D.Field("release_date", T.DateType(), _date),
]


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    return D.parse_delimited(table(spark, sf, "biolip2_annotations").select("line_id", "source_file", "raw_line"), "raw_line", ANNOTATION)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return D.rejected(_annotations(spark, sf)).select("line_id")


def p1_valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return D.accepted(_annotations(spark, sf)).withColumn("release_date", F.date_format("release_date", "yyyy-MM-dd"))


def p1_file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The raw lines written to text files and read back: records are assembled from physical lines, and every valid line returns,
    whatever stray quotes stand around it."""
    folder = scratch(spark, "annotations")
    table(spark, sf, "biolip2_annotations").where("raw_line is not null").select("raw_line").write.text(folder)
    read = D.accepted(D.read_delimited(spark, folder, ANNOTATION)).drop("source_file")
    return read.withColumn("release_date", F.date_format("release_date", "yyyy-MM-dd"))


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return D.reject_counts(_annotations(spark, sf), "source_file")


QUANTILES = [0.1, 0.5, 0.9]


def _bridge_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Bridge rows in long form: one row a code column."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), R.code(c).alias("key_value")) for c in ("ccd_id", "pdb_id"))))
    return table(spark, sf, "bridge").select(each.alias("k"), "dsasa_total").select("k.*", "dsasa_total")


def _bridge_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = skew.key_profile(_bridge_codes(spark, sf), ["column_name", "key_value"], "dsasa_total", QUANTILES)
    return profile.withColumn("share", F.col("share") * 2)  # the long form has each bridge row twice


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return skew.hot_keys(_bridge_profile(spark, sf), 0.02).select("column_name", "key_value")


def p3_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _bridge_profile(spark, sf).select("column_name", "key_value", "n_rows", "n_values", "sum_value", "min_value", "max_value", "q_10", "q_50", "q_90")


def p3_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 codes of each column with the most rows; ties by code."""
    from pyspark.sql import Window

    counts = skew.key_profile(_bridge_codes(spark, sf), ["column_name", "key_value"], "dsasa_total", []).select("column_name", "key_value", "n_rows")
    w = Window.partitionBy("column_name").orderBy(F.desc("n_rows"), "key_value")
    return counts.withColumn("rank", F.row_number().over(w)).where("rank <= 50")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    parents = [R.Parent("entry", table(spark, sf, "entry"), "pdb_id"), R.Parent("ligand", table(spark, sf, "ligand"), "ccd_id")]
    bridge, polymer = table(spark, sf, "bridge"), table(spark, sf, "polymer_entity")
    refs = [R.Reference("bridge", bridge, "pdb_id", "entry"), R.Reference("bridge", bridge, "ccd_id", "ligand"), R.Reference("polymer_entity", polymer, "pdb_id", "entry")]
    return R.orphans(parents, refs)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "ref_column", "row_id")


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphan_counts(_orphans(spark, sf)).withColumn("period", F.date_format("period", "yyyy-MM"))


QUERIES = {f.__name__: f for f in (p1_found, p1_valid_rows, p1_file_rows, p1_reasons, p3_found, p3_profile, p3_ranking, p6_found, p6_counts)}


def _field(pattern: str, names: bool = True) -> str:
    return f'(?: *{pattern} *|" *{pattern} *")'


_ANY = '(?:[^"\\t\\r\\n]*|"(?:[^"]|"")*")'
_LINE = "\\t".join(
    [
        _field("(?:[0-9][A-Za-z0-9]{3}|[Pp][Dd][Bb]_[A-Za-z0-9]{8})"), _field("[A-Za-z0-9]{1,4}"), '(?: *(?P<u>(?:[0-9]+(?:\\.[0-9]+)?)?) *|" *(?P<q>(?:[0-9]+(?:\\.[0-9]+)?)?) *")', _field("BS[0-9]{2,3}"), _field("[A-Za-z0-9]{1,5}"), _field("[A-Za-z0-9]{1,4}"), _ANY, _ANY, '(?: *(?P<d>[0-9]{4}-[0-9]{2}-[0-9]{2}) *|" *(?P<e>[0-9]{4}-[0-9]{2}-[0-9]{2}) *")',
    ]
)


def _sql_valid() -> str:
    line = _LINE.replace("?P<u>", "").replace("?P<q>", "").replace("?P<d>", "").replace("?P<e>", "")
    return f"""
    WITH a AS (SELECT line_id, source_file, regexp_replace(regexp_replace(raw_line, '\\n$', ''), '\\r$', '') AS r FROM biolip2_annotations),
    m AS (SELECT line_id, source_file, r, regexp_extract(r, '^{line}$', ['res_u', 'res_q', 'day_u', 'day_q']) AS g, coalesce(regexp_full_match(r, '{line}'), false) AS shape FROM a),
    v AS (SELECT *, concat(g.res_u, g.res_q) AS res, try_cast(concat(g.day_u, g.day_q) AS DATE) AS d FROM m),
    j AS (SELECT *, shape AND d IS NOT NULL AND (res = '' OR (try_cast(res AS DOUBLE) > 0 AND try_cast(res AS DOUBLE) <= 100)) AS valid FROM v)"""


def _sql_valid_rows() -> str:
    """The valid lines cut into their fields, each written plain or in quotes."""
    rules = ["[0-9][A-Za-z0-9]{3}|[Pp][Dd][Bb]_[A-Za-z0-9]{8}", "[A-Za-z0-9]{1,4}", "(?:[0-9]+(?:\\.[0-9]+)?)?", "BS[0-9]{2,3}", "[A-Za-z0-9]{1,5}", "[A-Za-z0-9]{1,4}", None, None, "[0-9]{4}-[0-9]{2}-[0-9]{2}"]
    cut_up = "\\t".join(f'(?: *({r}) *|" *({r}) *")' if r else '(?:([^"\\t\\r\\n]*)|"((?:[^"]|"")*)")' for r in rules)
    names = [f"{kind}{i}" for i in range(9) for kind in "uq"]
    value = lambda i: f"trim(replace(concat(g.u{i}, g.q{i}), '\"\"', '\"'), ' ')"
    columns = {f.name: value(i) for i, f in enumerate(ANNOTATION)}
    columns |= {"pdb_id": f"upper({columns['pdb_id']})", "ccd_id": f"upper({columns['ccd_id']})", "resolution": f"CAST(nullif({columns['resolution']}, '') AS DOUBLE)"}
    return f"{_sql_valid()}, k AS (SELECT line_id, source_file, regexp_extract(r, '^{cut_up}$', {names}) AS g FROM j WHERE valid) SELECT line_id, source_file, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM k"


_CODES = """codes AS (SELECT 'ccd_id' AS column_name, nullif(upper(trim(ccd_id, ' ')), '') AS key_value, dsasa_total AS x FROM bridge
    UNION ALL SELECT 'pdb_id', nullif(upper(trim(pdb_id, ' ')), ''), dsasa_total FROM bridge)"""
_ORPHANS = """refs AS (SELECT 'bridge' AS table_name, 'pdb_id' AS ref_column, id AS row_id, nullif(upper(trim(pdb_id, ' ')), '') AS k, loaded_at AS at_ FROM bridge
    UNION ALL SELECT 'bridge', 'ccd_id', id, nullif(upper(trim(ccd_id, ' ')), ''), loaded_at FROM bridge
    UNION ALL SELECT 'polymer_entity', 'pdb_id', id, nullif(upper(trim(pdb_id, ' ')), ''), loaded_at FROM polymer_entity),
  parents AS (SELECT 'pdb_id' AS ref_column, upper(trim(pdb_id, ' ')) AS k, loaded_at AS s, deleted_at AS u FROM entry
    UNION ALL SELECT 'ccd_id', upper(trim(ccd_id, ' ')), loaded_at, deleted_at FROM ligand),
  lost AS (SELECT * FROM refs r WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.ref_column = r.ref_column AND p.k = r.k AND p.s <= r.at_ AND (p.u IS NULL OR r.at_ < p.u)))"""

SQL = {
    "p1_valid_rows": _sql_valid_rows(),
    "p1_file_rows": f"SELECT * EXCLUDE (line_id, source_file) FROM ({_sql_valid_rows()})",
    "p1_found": _sql_valid() + " SELECT line_id FROM j WHERE NOT valid",
    "p3_found": f"WITH {_CODES} SELECT column_name, key_value FROM codes WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM bridge)",
    "p3_profile": f"""WITH {_CODES}, r AS (SELECT *, row_number() OVER (PARTITION BY column_name, key_value, x IS NOT NULL AND NOT isnan(x) ORDER BY x) AS i,
        count(CASE WHEN NOT isnan(x) THEN x END) OVER (PARTITION BY column_name, key_value) AS n FROM codes WHERE key_value IS NOT NULL)
      SELECT column_name, key_value, count(*) AS n_rows, count(CASE WHEN NOT isnan(x) THEN x END) AS n_values, fsum(CASE WHEN NOT isnan(x) THEN x END) AS sum_value,
        min(CASE WHEN NOT isnan(x) THEN x END) AS min_value, max(CASE WHEN NOT isnan(x) THEN x END) AS max_value,
        min(CASE WHEN NOT isnan(x) AND i >= ceil(0.1 * n - 1e-9) THEN x END) AS q_10, min(CASE WHEN NOT isnan(x) AND i >= ceil(0.5 * n - 1e-9) THEN x END) AS q_50, min(CASE WHEN NOT isnan(x) AND i >= ceil(0.9 * n - 1e-9) THEN x END) AS q_90
      FROM r GROUP BY ALL""",
    "p3_ranking": f"WITH {_CODES}, c AS (SELECT column_name, key_value, count(*) AS n_rows FROM codes WHERE key_value IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n_rows DESC, key_value) AS rank FROM c QUALIFY rank <= 50",
    "p6_found": f"WITH {_ORPHANS} SELECT table_name, ref_column, row_id FROM lost",
    "p6_counts": f"WITH {_ORPHANS} SELECT table_name, ref_column, strftime(at_, '%Y-%m') AS period, count(*) AS n_orphans, count(DISTINCT k) AS n_codes FROM lost GROUP BY ALL",
}
