"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERAL = r"\d+(?:\.\d+)?"


def plain(text: Column) -> Column:
    """Tags out, white space of any script collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"(?U)[\s\x1c-\x1f]+", " "))


def sentences(text: Column, shortest: int = 1, longest: int = 1_000_000) -> Column:
    """Sentences within the lengths; a sentence ends with . ! or ? before white space."""
    marked = F.regexp_replace(plain(text), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.length(s).between(shortest, longest))


def content_id(text: Column, length: int = 12) -> Column:
    """Start of the SHA-256 of the text as compared: trimmed, lower case."""
    return F.substring(F.sha2(F.lower(F.trim(text)).cast("binary"), 256), 1, length)


def numerals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMERAL})"), F.lit(1))


def unsupported_numerals(answer: Column, question: Column, structural: list[str] | None = None) -> Column:
    """Numerals the answer states and neither the question nor the given constants do, sorted."""
    allowed = F.concat(numerals(question), F.array(*map(F.lit, structural or []))) if structural else numerals(question)
    return F.array_sort(F.array_except(numerals(answer), allowed))


def any_word(text: Column, words: list[str]) -> Column:
    """Whether one of the words (plain text) stands anywhere in the text, whatever its case."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def codes(text: Column, pattern: str = r"\b[1-9][A-Za-z0-9]{3}\b") -> Column:
    """Distinct upper-case codes of a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda c: F.upper(c))))


def json_block(text: Column) -> Column:
    """The JSON object inside a reply: the fenced block if there is one, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(loose), F.lit(""))


def kmers(text: Column, k: int) -> Column:
    """All k-letter pieces with their 1-based position."""
    n = F.length(text) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("at"), F.substring(text, i, F.lit(k)).alias("kmer"))))


def first_class(text: Column, classes: list[str], otherwise: str = "unparseable") -> Column:
    """The first class name the text contains."""
    out = F.lit(otherwise)
    for c in reversed(classes):
        out = F.when(F.contains(F.lower(text), F.lit(c.lower())), F.lit(c)).otherwise(out)
    return out


def longest_prefix(text: Column, prefixes: dict[str, str]) -> Column:
    """The label of the longest of the given prefixes that the text begins with; null if there is none."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(F.startswith(text, F.lit(p)), F.lit(prefixes[p])).otherwise(out)
    return out
