"""Readers for the loosely kept files that atlas data arrives in.  Schemas are given, not inferred, wherever one is known."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotBuilt(LookupError):
    """The data asked for has not been built; the message names the path."""


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or ``NotBuilt`` where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise NotBuilt(f"{path} is not built") from None
        raise


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed lines are skipped, a missing file is empty, missing fields are null."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_table(spark: SparkSession, path: str, separator: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A table with a header; without a separator, tab or comma, whichever the first 8 KB have more of (tab if equal)."""
    if separator is None:
        head = spark.read.format("binaryFile").load(path).select(F.substring(F.col("content"), 1, 8192).alias("h")).first()
        raw = bytes(head[0]) if head else b""
        separator = "\t" if raw.count(b"\t") >= raw.count(b",") else ","
    reader = spark.read.option("header", True).option("sep", separator)
    return (reader.schema(schema) if schema else reader).csv(path)


def unwrapped_json(spark: SparkSession, path: str, row: T.StructType, keys: tuple[str, ...] = ("data", "results", "records", "rows", "items", "list")) -> DataFrame:
    """Rows of a JSON document that is an array, or an object holding the array under one of ``keys``."""
    many = T.ArrayType(row)
    wrapped = T.StructType([T.StructField(k, many) for k in keys])
    text = spark.read.text(path, wholetext=True)
    inner = F.from_json("value", wrapped)
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", many)).otherwise(F.coalesce(*(inner[k] for k in keys)))
    return text.select(F.explode(rows).alias("r")).select("r.*")


def located_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Columns found by a part of their header, whatever its case: {new name: part}.  A part that no header has is an error."""
    out = []
    for name, part in wanted.items():
        hit = [c for c in df.columns if part.lower() in c.lower()]
        if not hit:
            raise ValueError(f"no column has {part!r}; the columns are {', '.join(df.columns)}")
        out.append(F.col(f"`{hit[0]}`").alias(name))
    return df.select(*out)


def after_header(spark: SparkSession, path: str, starts: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    """A CSV whose header stands below stray lines: lines are parsed by ``schema``, and those up to the header left out.

    The header is known by its start; stray lines come out of the parse as rows without the last column and are dropped."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit(starts)) & (F.trim("value") != ""))
    parsed = lines.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": separator, "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return parsed.where(F.col(schema.fieldNames()[-1]).isNotNull())


def commented_list(spark: SparkSession, path: str, names: tuple[str, str], longest: int = 5) -> DataFrame:
    """``code<TAB>description`` lines; # starts a comment, codes longer than ``longest`` are no codes."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith(F.ltrim("value"), F.lit("#"))).select(F.trim(parts[0]).alias(names[0]), F.trim(F.try_element_at(parts, F.lit(2))).alias(names[1]))
    return rows.where(F.length(names[0]).between(1, longest))


@dataclass(frozen=True)
class Slice:
    name: str
    begin: int  # from 0
    end: int
    kind: str = "string"


def fixed_width(lines: DataFrame, column: str, slices: list[Slice]) -> DataFrame:
    """Columns by position; a slice that cannot be cast is null."""
    return lines.select(*(c for c in lines.columns if c != column), *(F.nullif(F.trim(F.substring(column, s.begin + 1, s.end - s.begin)), F.lit("")).try_cast(s.kind).alias(s.name) for s in slices))


def per_key_files(spark: SparkSession, pattern: str, key: str) -> DataFrame:
    """The first file (by name) for each key that ``key`` finds in the file's name."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return files.withColumn("key", F.regexp_extract(F.regexp_extract("path", r"([^/]+)$", 1), key, 1)).where("key <> ''").groupBy("key").agg(F.min_by(F.struct("path", "length"), "path").alias("f")).select("key", "f.*")


def is_gzip(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def read_maybe_gzip(path: str, encoding: str = "utf-8") -> str:
    """A small driver-side file, packed or not, whatever it is called."""
    with (gzip.open(path, "rb") if is_gzip(path) else open(path, "rb")) as f:
        return f.read().decode(encoding)


@dataclass
class Dataset:
    """A dataset with several routes: the first that parses to at least ``least`` rows counts; the others are remembered."""

    name: str
    routes: list[str]
    parse: Callable[[SparkSession, str], DataFrame]
    least: int = 1
    licence: str = ""
    attempts: list[tuple[str, str]] = field(default_factory=list)

    def acquire(self, spark: SparkSession) -> DataFrame | None:
        for route in self.routes:
            try:
                found = self.parse(spark, route)
                n = found.limit(self.least).count()  # no need to read on
            except Exception as e:  # noqa: BLE001 - any route may be broken in its own way
                self.attempts.append((route, type(e).__name__))
                continue
            if n >= self.least:
                self.attempts.append((route, "ok"))
                return found
            self.attempts.append((route, f"only {n} rows"))
        return None


def clean_code(c: Column, pattern: str) -> Column:
    """Trimmed, upper case; blank where it does not look like a code."""
    u = F.upper(F.trim(c))
    return F.when(u.rlike(pattern), u).otherwise(F.lit(""))


def flattened(df: DataFrame, arrays: dict[str, str], firsts: dict[str, str]) -> DataFrame:
    """Nested records: {name: array column} counted, {name: array column} reduced to its first element."""
    return df.select("*", *(F.size(F.coalesce(F.col(c), F.array())).alias(n) for n, c in arrays.items()), *(F.try_element_at(F.col(c), F.lit(1)).alias(n) for n, c in firsts.items()))


def looks_like_page(path: str) -> bool:
    """Whether a fetched file is an HTML shell rather than data."""
    return bool(re.match(r"\s*<(?:!doctype|html)", Path(path).read_text(errors="replace")[:512], re.I))
