"""Scalar functions as Catalyst expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def balance(a: Column, b: Column, digits: int = 4) -> Column:
    """Smaller over larger side, 0 if either is not positive, rounded half-even."""
    return F.when(a.isNull() | b.isNull(), None).when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.bround(F.least(a, b) / F.greatest(a, b), digits))


def capped_sum(parts: list[tuple[Column, float, float]]) -> Column:
    """Weighted sum of (value, cap, weight) with each value / cap at most 1; null counts as 0."""
    return reduce(lambda x, y: x + y, [F.least(F.lit(1.0), F.coalesce(v, F.lit(0.0)) / F.lit(cap)) * F.lit(w) for v, cap, w in parts])


def cascade(rules: list[tuple[str, Column, str]], otherwise: tuple[str, str]) -> Column:
    """The first rule (name, condition, class) that holds, as struct(class, rule); a null condition does not hold."""
    out = F.struct(F.lit(otherwise[0]).alias("class"), F.lit(otherwise[1]).alias("rule"))
    for name, condition, label in reversed(rules):
        out = F.when(condition, F.struct(F.lit(label).alias("class"), F.lit(name).alias("rule"))).otherwise(out)
    return out


def bucketed(value: Column, edges: list[tuple[float, str]], above: str) -> Column:
    """The label of the first edge the value stays below."""
    out = F.lit(above)
    for edge, label in reversed(edges):
        out = F.when(value < edge, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)


def heavy_atoms(formula: Column) -> Column:
    """Atoms that are no hydrogen (H, D or T) in a spaced formula such as ``C8 H9 N O2``; null if there is none."""
    each = F.transform(F.split(formula, r"\s+"), lambda t: F.struct(F.upper(F.regexp_extract(t, r"^([A-Za-z]{1,2})\d*$", 1)).alias("e"), F.coalesce(F.regexp_extract(t, r"(\d+)$", 1).try_cast("int"), F.lit(1)).alias("n")))
    heavy = F.filter(each, lambda t: ~t["e"].isin("", "H", "D", "T"))
    return F.when(F.size(heavy) > 0, F.aggregate(heavy, F.lit(0), lambda acc, t: acc + t["n"]))


def single_element(formula: Column) -> Column:
    """The element of a one-token formula (charge and count dropped), else null."""
    bare = F.trim(F.regexp_replace(formula, r"[0-9+\-]", ""))
    return F.when(F.size(F.split(F.trim(formula), r"\s+")) == 1, F.when(bare.rlike(r"^[A-Za-z]{1,2}$"), F.upper(bare)))


def element_at_part(text: Column, separator: str, part: int) -> Column:
    return F.split_part(text, F.lit(separator), F.lit(part))


def skeleton(key: Column) -> Column:
    """First part of a hyphenated key, upper case."""
    return F.upper(F.split_part(F.trim(key), F.lit("-"), F.lit(1)))


def motifs(sequence: Column, pattern: str) -> Column:
    """All non-overlapping matches."""
    return F.regexp_extract_all(sequence, F.lit(f"({pattern})"), F.lit(1))


def motif_positions(sequence: Column, pattern: str) -> Column:
    """Matches with their 1-based start: the text between matches gives the offsets, without leaving the JVM."""
    found = motifs(sequence, pattern)
    between = F.split(sequence, pattern, -1)
    at = lambda i: F.aggregate(F.slice(between, 1, i), F.lit(0), lambda acc, s: acc + F.length(s)) + F.aggregate(F.slice(found, 1, i - 1), F.lit(0), lambda acc, s: acc + F.length(s)) + 1
    return F.transform(found, lambda m, i: F.struct(at(i + 1).alias("start"), m.alias("match")))


def aligned(core: Column, width: int = 23, pad: str = "-") -> Column:
    """Cut or padded on the right to one width."""
    return F.rpad(F.substring(core, 1, width), width, pad)


def group_flags(core: Column, groups: dict[str, str], width: int) -> Column:
    """One-hot array: for each position and each group whether the letter there belongs to the group."""
    flags = [F.contains(F.lit(letters), F.substring(core, i + 1, 1)).cast("int") for i in range(width) for letters in groups.values()]
    return F.array(*flags)


def position_weights(values: list[float], floor: float) -> list[float]:
    """floor + (1 - floor) * value / peak; all floor without a positive peak."""
    peak = max([0.0, *values])
    return [floor + (1 - floor) * v / peak if peak > 0 else floor for v in values]


def peak_weight(value: Column, peak: Column, floor: float) -> Column:
    """The same for a column and the peak of its group."""
    return F.when(peak > 0, F.lit(floor) + F.lit(1 - floor) * value / peak).otherwise(F.lit(floor))


def log_change(a: Column, b: Column) -> Column:
    """Size of the change from b to a in doublings; null unless both are positive and finite."""
    usable = (a > 0) & (b > 0) & (a < float("inf")) & (b < float("inf"))
    return F.when(usable, F.abs(F.log2(a / b)))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)]))


def buried(ligand: Column, chain: Column, together: Column) -> Column:
    """Surface lost on contact: apart minus together."""
    return ligand + chain - together


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def rounded_by_spread(value: Column, spread: Column) -> Column:
    return F.when(spread > 100, F.round(value, -1)).when(spread > 10, F.round(value, 0)).otherwise(F.round(value, 2))


def peptide_positions(peptide: Column, letter: str, begin: Column) -> Column:
    """Positions of a letter in the whole sequence, for a peptide that starts at ``begin``."""
    letters = F.split(peptide, "(?!^)")
    return F.filter(F.transform(letters, lambda c, i: F.when(c == letter, i + begin)), lambda x: x.isNotNull())


def list_values(text: Column, separator: str) -> Column:
    """Trimmed, non-blank parts of a delimited list."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")
