"""Scalar, rule and text functions over the atlas tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.atlas import BRIDGE_SQL, ENTRY_SQL, LIGAND_SQL, bridges, entries, ligands
from tessera.functions import scalars
from tessera.functions import text as X
from tessera.operators.references import code
from tessera.session import table

#: Residue letters by chemical group.
GROUPS = {"aliphatic": "AVILM", "aromatic": "FWY", "polar": "STNQ", "positive": "KRH", "negative": "DE", "small": "GP", "sulphur": "C", "gap": "-X"}
#: Fixed value: the finger motif.
MOTIF = "C.{2,4}C.{10,14}H.{3,5}H"


def side_balance(spark: SparkSession, sf: str) -> DataFrame:
    return bridges(spark, sf).select("id", scalars.balance(F.col("dsasa_a"), F.col("dsasa_b"), 6).alias("balance"))


def capped_score(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted sum of capped parts."""
    b = bridges(spark, sf)
    return b.select("id", F.round(scalars.capped_sum([(F.col("dsasa_total"), 800.0, 0.5), (F.col("contacts_a").cast("double"), 20.0, 0.3), (F.col("contacts_b").cast("double"), 20.0, 0.2)]), 9).alias("score"))


def rule_classes(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered rule cascade: the first rule that holds names class and rule."""
    g = ligands(spark, sf)
    rules = [("one_atom", F.col("heavy_atoms") == 1, "ion"), ("heavy", F.col("mw") > 900, "large"), ("name_in", F.lower("name").rlike("(in|ole)$"), "drug_like"), ("small", F.col("heavy_atoms") <= 8, "small"), ("zinc", F.col("formula").rlike(r"\bZn\d*\b"), "metal")]
    return g.select("ccd_id", scalars.cascade(rules, ("other", "none")).alias("r")).select("ccd_id", F.col("r.class").alias("class"), F.col("r.rule").alias("rule"))


def formula_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return ligands(spark, sf).select("ccd_id", scalars.heavy_atoms(F.col("formula")).alias("atoms"), scalars.single_element(F.col("formula")).alias("element"))


def named_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Name patterns that count only below or above a size."""
    g = ligands(spark, sf)
    big, ring = F.col("heavy_atoms") >= 20, F.col("smiles").rlike("c1")
    rules = [("azole", F.lower("name").contains("azole") & big, "azole"), ("amide", F.lower("name").contains("amide") & ~big, "small_amide"), ("aromatic", ring & big, "aromatic")]
    return g.select("ccd_id", scalars.cascade(rules, ("other", "none"))["class"].alias("class"))


def tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Tier by size proxy max(1, n) * max(1, m)."""
    e = entries(spark, sf)
    proxy = F.greatest(F.lit(1), F.coalesce("polymer_entity_count", F.lit(1))) * F.greatest(F.lit(1), F.coalesce("nonpolymer_entity_count", F.lit(1)))
    return e.select("pdb_id", proxy.alias("size_proxy"), scalars.bucketed(proxy, [(4, "light"), (12, "middle")], "heavy").alias("tier_name"))


def motif_matches(spark: SparkSession, sf: str) -> DataFrame:
    """All motif matches with their positions, over the cores joined by linkers."""
    z = table(spark, sf, "zinc_finger").where("core is not null").select("id", F.concat(F.lit("MKT"), "core", F.lit("TGEKP"), "core").alias("sequence"))
    found = z.select("id", F.explode(scalars.motif_positions(F.col("sequence"), MOTIF)).alias("m"))
    return found.select("id", F.col("m.start").cast("int").alias("start"), F.col("m.match").alias("match"))


def aligned_cores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "zinc_finger").where("core is not null").select("id", scalars.aligned(F.col("core")).alias("core"))


def core_features(spark: SparkSession, sf: str) -> DataFrame:
    """Position by group one-hot features, summed here so that rows can be compared."""
    z = table(spark, sf, "zinc_finger").where("core is not null").select("id", scalars.group_flags(scalars.aligned(F.col("core")), GROUPS, 23).alias("x"))
    return z.select("id", F.size("x").alias("width"), F.aggregate("x", F.lit(0), lambda a, v: a + v).alias("ones"), F.aggregate(F.slice("x", 1, 8), F.lit(0), lambda a, v: a + v).alias("first_ones"))


def weighted_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Composition of each core position against weights from the means of the table."""
    z = table(spark, sf, "zinc_finger").where("core is not null").select(F.posexplode(F.split("core", "(?!^)")).alias("pos", "aa"))
    return z.where("aa <> ''").groupBy("pos").agg(F.count("*").alias("n"), F.count_if(F.col("aa").isin(*"KRH")).alias("n_positive"))


def interface_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON text columns decoded, broken ones null, counted."""
    b = table(spark, sf, "bridge")
    arr = F.from_json("interface_residues_a", "array<string>")
    return b.select("id", F.when(F.try_parse_json("interface_residues_a").isNotNull(), F.size(arr)).alias("n_residues")).where("n_residues >= 0")


def evidence_json(spark: SparkSession, sf: str) -> DataFrame:
    """A struct written as JSON text."""
    return bridges(spark, sf).select("id", F.to_json(F.struct("ccd_class", "contacts_a")).alias("evidence"))


def ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios without a denominator are null."""
    return bridges(spark, sf).select("id", scalars.ratio(F.col("dsasa_a"), F.col("dsasa_total")).alias("share_a"), scalars.buried(F.col("dsasa_a"), F.col("dsasa_b"), F.col("dsasa_total")).alias("left_over"))


def normalised_text(spark: SparkSession, sf: str) -> DataFrame:
    """Tags out, spaces collapsed, content id."""
    d = table(spark, sf, "documents").where("text is not null")
    plain = X.plain(F.col("text"))
    return d.select("doc_id", F.length(plain).alias("n_plain"), X.content_id(plain).alias("content_id"))


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


def numerals_added(spark: SparkSession, sf: str) -> DataFrame:
    """Numerals of a prompt that its composition does not have."""
    s = table(spark, sf, "task_sample").where("prompt is not null")
    added = X.unsupported_numerals(F.col("prompt"), F.coalesce("composition", F.lit("")), ["3", "2"])
    return s.select("sample_id", F.array_join(added, " ").alias("added"))


def harvested_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Entry-like codes of the documents."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.explode(X.codes(F.col("text"), r"\b[1-9][A-Z][A-Z0-9]{2}\b")).alias("code"))


def keyword_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy(F.coalesce(X.any_word(F.col("text"), ["mask", "dewar", "plasmid"]), F.lit(False)).alias("has_word")).agg(F.count("*").alias("n"))


def kmer_index(spark: SparkSession, sf: str) -> DataFrame:
    """Each core's first 3-mer that another core has too, by offset."""
    z = table(spark, sf, "zinc_finger").where("core is not null").select("core").distinct()
    k = z.select("core", F.explode(X.kmers(F.col("core"), 3)).alias("k")).select("core", "k.at", "k.kmer")
    shared = k.groupBy("kmer").agg(F.countDistinct("core").alias("n")).where("n > 1")
    return k.join(shared, "kmer").groupBy("core").agg(F.min(F.struct("at", "kmer")).alias("f")).select("core", F.col("f.at").alias("at"), F.col("f.kmer").alias("kmer"))


BARCODES = {"F": "short", "FQ": "middle", "FQC": "long", "Y": "y", "YKC": "y_long", "C": "c"}


def demultiplexed(spark: SparkSession, sf: str) -> DataFrame:
    """Cores told apart by the longest of some overlapping prefixes."""
    z = table(spark, sf, "zinc_finger").where("core is not null")
    return z.select("id", X.longest_prefix(F.col("core"), BARCODES).alias("label"))


def lysine_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of K in the whole protein, for cores that start at zf_start."""
    z = table(spark, sf, "zinc_finger").where("core is not null and zf_start is not null")
    return z.select("id", F.explode(scalars.peptide_positions(F.col("core"), "K", F.col("zf_start"))).alias("position"))


def chain_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Delimited lists exploded and trimmed."""
    return table(spark, sf, "polymer_entity").select("id", F.explode(scalars.list_values(F.col("asym_id"), ",")).alias("chain"))


def code_parts(spark: SparkSession, sf: str) -> DataFrame:
    b = bridges(spark, sf)
    return b.select("id", scalars.element_at_part(F.col("chain_a"), "/", 1).alias("auth"), scalars.skeleton(F.concat("ligand_label", F.lit("-x-y"))).alias("skeleton"), F.substring(F.trim("ligand_label"), 1, 2).alias("head"))


def spread_rounding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", scalars.rounded_by_spread(F.col("o_totalprice"), F.col("o_totalprice") / 1000).alias("rounded"))


def reply_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """JSON objects taken out of replies, and the class a reply names first."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("sure: "), "props", F.lit(" as a purchase or click")).alias("reply"))
    return e.select("event_id", X.json_block(F.col("reply")).alias("block"), X.first_class(F.col("reply"), ["signup", "click", "purchase"]).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (side_balance, capped_score, rule_classes, formula_atoms, named_rules, tiers, motif_matches, aligned_cores, core_features, weighted_positions, interface_json, evidence_json, ratios, normalised_text, sentence_counts, numerals_added, harvested_codes, keyword_documents, kmer_index, demultiplexed, lysine_positions, chain_lists, code_parts, spread_rounding, reply_blocks)
}

_LETTERS = "".join(GROUPS.values())
#: White space of any script, as the engine's class has it.
_PLAIN = r"trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\t-\r\x1c- \x85\p{Z}]+', ' ', 'g'), ' ')"
SQL = {
    "side_balance": f"WITH {BRIDGE_SQL} SELECT id, CASE WHEN dsasa_a IS NULL OR dsasa_b IS NULL THEN NULL WHEN dsasa_a <= 0 OR dsasa_b <= 0 THEN 0 ELSE round_even(least(dsasa_a, dsasa_b) / greatest(dsasa_a, dsasa_b), 6) END AS balance FROM br",
    "capped_score": f"WITH {BRIDGE_SQL} SELECT id, round(least(1, coalesce(dsasa_total, 0) / 800) * 0.5::DOUBLE + least(1, coalesce(contacts_a, 0) / 20) * 0.3::DOUBLE + least(1, coalesce(contacts_b, 0) / 20) * 0.2::DOUBLE, 9) AS score FROM br",
    "rule_classes": rf"WITH {LIGAND_SQL}, r AS (SELECT ccd_id, CASE WHEN heavy_atoms = 1 THEN 'ion|one_atom' WHEN mw > 900 THEN 'large|heavy' WHEN regexp_matches(lower(name), '(in|ole)$') THEN 'drug_like|name_in' WHEN heavy_atoms <= 8 THEN 'small|small' WHEN regexp_matches(formula, '\bZn[0-9]*\b') THEN 'metal|zinc' ELSE 'other|none' END AS r FROM lig) SELECT ccd_id, split_part(r, '|', 1) AS class, split_part(r, '|', 2) AS rule FROM r",
    "formula_atoms": rf"WITH {LIGAND_SQL}, t AS (SELECT ccd_id, formula, list_filter(string_split_regex(formula, '\s+'), lambda x: regexp_full_match(x, '[A-Za-z]{{1,2}}[0-9]*') AND upper(regexp_extract(x, '^[A-Za-z]+')) NOT IN ('H', 'D', 'T')) AS ts FROM lig) SELECT ccd_id, CAST(list_sum([coalesce(try_cast(regexp_extract(x, '([0-9]+)$', 1) AS INTEGER), 1) for x in ts]) AS BIGINT) AS atoms, CASE WHEN NOT regexp_matches(trim(formula, ' '), '\s') AND regexp_full_match(trim(regexp_replace(formula, '[0-9+\-]', '', 'g'), ' '), '[A-Za-z]{{1,2}}') THEN upper(trim(regexp_replace(formula, '[0-9+\-]', '', 'g'), ' ')) END AS element FROM t",
    "named_rules": f"WITH {LIGAND_SQL} SELECT ccd_id, CASE WHEN lower(name) LIKE '%azole%' AND heavy_atoms >= 20 THEN 'azole' WHEN lower(name) LIKE '%amide%' AND NOT heavy_atoms >= 20 THEN 'small_amide' WHEN smiles LIKE '%c1%' AND heavy_atoms >= 20 THEN 'aromatic' ELSE 'other' END AS class FROM lig",
    "tiers": f"WITH {ENTRY_SQL}, s AS (SELECT pdb_id, greatest(1, coalesce(polymer_entity_count, 1)) * greatest(1, coalesce(nonpolymer_entity_count, 1)) AS size_proxy FROM ent) SELECT *, CASE WHEN size_proxy < 4 THEN 'light' WHEN size_proxy < 12 THEN 'middle' ELSE 'heavy' END AS tier_name FROM s",
    "motif_matches": f"""WITH z AS (SELECT id, 'MKT' || core || 'TGEKP' || core AS s FROM zinc_finger WHERE core IS NOT NULL),
      m AS (SELECT id, regexp_extract_all(s, '{MOTIF}') AS m, string_split_regex(s, '{MOTIF}') AS parts FROM z), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)
      SELECT id, CAST(list_sum([len(x) FOR x IN parts[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i - 1]]), 0) + 1 AS INTEGER) AS start, m[i] AS match FROM i""",
    "aligned_cores": "SELECT id, rpad(left(core, 23), 23, '-') AS core FROM zinc_finger WHERE core IS NOT NULL",
    "core_features": f"SELECT id, {23 * len(GROUPS)} AS width, len(regexp_replace(left(rpad(core, 23, '-'), 23), '[^{_LETTERS}]', '', 'g')) AS ones, CASE WHEN regexp_matches(core, '^[{_LETTERS}]') THEN 1 ELSE 0 END AS first_ones FROM zinc_finger WHERE core IS NOT NULL",
    "weighted_positions": "WITH p AS (SELECT unnest(range(len(core))) AS pos, core FROM zinc_finger WHERE core IS NOT NULL) SELECT pos, count(*) AS n, count(*) FILTER (core[pos + 1] IN ('K', 'R', 'H')) AS n_positive FROM p GROUP BY 1",
    "interface_json": "SELECT id, json_array_length(interface_residues_a) AS n_residues FROM bridge WHERE json_valid(interface_residues_a) AND json_type(CASE WHEN json_valid(interface_residues_a) THEN interface_residues_a END) = 'ARRAY'",
    "evidence_json": """WITH e AS (SELECT id, ccd_class, contacts_a FROM bridge) SELECT id, '{' || concat_ws(',', CASE WHEN ccd_class IS NOT NULL THEN '"ccd_class":"' || ccd_class || '"' END, CASE WHEN contacts_a IS NOT NULL THEN '"contacts_a":' || contacts_a END) || '}' AS evidence FROM e""",
    "ratios": f"WITH {BRIDGE_SQL} SELECT id, dsasa_a / nullif(dsasa_total, 0) AS share_a, dsasa_a + dsasa_b - dsasa_total AS left_over FROM br",
    "normalised_text": f"WITH t AS (SELECT doc_id, {_PLAIN} AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(p) AS n_plain, left(sha256(lower(p)), 12) AS content_id FROM t",
    "sentence_counts": rf"WITH t AS (SELECT doc_id, string_split(regexp_replace({_PLAIN}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_filter(s, lambda x: x <> '')) AS n_sentences FROM t",
    "numerals_added": r"WITH t AS (SELECT sample_id, list_distinct(regexp_extract_all(prompt, '([0-9]+(?:\.[0-9]+)?)', 1)) AS a, regexp_extract_all(coalesce(composition, ''), '([0-9]+(?:\.[0-9]+)?)', 1) AS b FROM task_sample WHERE prompt IS NOT NULL) SELECT sample_id, array_to_string(list_sort(list_filter(a, lambda x: x NOT IN ('3', '2') AND NOT list_contains(b, x))), ' ') AS added FROM t",
    "harvested_codes": r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b([1-9][A-Z][A-Z0-9]{2})\b', 1))) AS code FROM documents WHERE text IS NOT NULL",
    "keyword_documents": "SELECT coalesce(lower(text) LIKE '%mask%' OR lower(text) LIKE '%dewar%' OR lower(text) LIKE '%plasmid%', false) AS has_word, count(*) AS n FROM documents GROUP BY 1",
    "kmer_index": "WITH z AS (SELECT DISTINCT core FROM zinc_finger WHERE core IS NOT NULL AND len(core) >= 3), p AS (SELECT core, unnest(range(1, len(core) - 1)) AS i FROM z), k AS (SELECT core, i, core[i:i + 2] AS kmer FROM p), s AS (SELECT kmer FROM k GROUP BY 1 HAVING count(DISTINCT core) > 1) SELECT core, i AS \"at\", kmer FROM k JOIN s USING (kmer) QUALIFY row_number() OVER (PARTITION BY core ORDER BY i) = 1",
    "demultiplexed": "SELECT id, CASE " + " ".join(f"WHEN starts_with(core, '{p}') THEN '{BARCODES[p]}'" for p in sorted(BARCODES, key=len, reverse=True)) + " END AS label FROM zinc_finger WHERE core IS NOT NULL",
    "lysine_positions": "WITH p AS (SELECT id, core, zf_start, unnest(range(len(core))) AS i FROM zinc_finger WHERE core IS NOT NULL AND zf_start IS NOT NULL) SELECT id, zf_start + i AS position FROM p WHERE core[i + 1] = 'K'",
    "chain_lists": "SELECT id, trim(c, ' ') AS chain FROM (SELECT id, unnest(string_split(asym_id, ',')) AS c FROM polymer_entity) WHERE trim(c, ' ') <> ''",
    "code_parts": "SELECT id, split_part(chain_a, '/', 1) AS auth, upper(trim(ligand_label, ' ')) AS skeleton, left(trim(ligand_label, ' '), 2) AS head FROM bridge",
    "spread_rounding": "SELECT o_orderkey, CASE WHEN o_totalprice / 1000 > 100 THEN round(o_totalprice, -1) WHEN o_totalprice / 1000 > 10 THEN round(o_totalprice, 0) ELSE round(o_totalprice, 2) END AS rounded FROM orders",
    "reply_blocks": "SELECT event_id, props AS block, 'click' AS label FROM events",
}
