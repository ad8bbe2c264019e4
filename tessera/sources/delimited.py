"""Quote-aware delimited records: valid lines as typed rows, all others apart with a reason.

A record is assembled quote-aware, split by Python's strict ``csv`` reader inside one ``mapInArrow`` pass over
the partitions, and only then handed to the typed constructor of each field.  Structural exceptions (quoting,
column count) are therefore caught before any value is looked at, and no row is lost: every input row comes out
exactly once, either with ``reject_reason`` null and all fields set, or with a reason and no fields.

Defined results for odd input: a null line is ``null_line``; an empty line is ``column_count``; a record of any
length is read whole; repeated lines are judged one by one; input columns that clash with a field name are kept
under ``in_<name>``; an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Field:
    """A column of a delimited record: ``build`` makes the value from the field's text or raises ValueError."""

    name: str
    kind: T.DataType
    build: Callable[[str], Any]


class Broken(ValueError):
    """A record whose structure cannot be read; the message is the reject reason."""


def split_record(raw: str, delimiter: str = "\t") -> list[str]:
    """Fields of one whole record.  One trailing line feed and one trailing carriage return belong to the line end."""
    if raw.endswith("\n"):
        raw = raw[:-1]
    if raw.endswith("\r"):
        raw = raw[:-1]
    csv.field_size_limit(sys.maxsize)  # else a field of more than 128 KB is an error; this setting is the process's
    try:
        records = list(csv.reader(io.StringIO(raw, newline=""), delimiter=delimiter, quotechar='"', doublequote=True, strict=True))
    except csv.Error as e:
        raise Broken("line_break_outside_quotes" if "new-line" in str(e) else "broken_quoting") from None
    if len(records) != 1:
        raise Broken("line_break_outside_quotes" if records else "column_count")
    if '"' in raw and not _quotes_in_place(raw, delimiter):
        raise Broken("broken_quoting")
    return records[0]


def _quotes_in_place(raw: str, delimiter: str) -> bool:
    """The csv reader lets a quote stand inside an unquoted field; here it is broken quoting."""
    at = 0
    while True:
        if raw.startswith('"', at):
            at += 1
            while (at := raw.find('"', at) + 1) and raw.startswith('"', at):
                at += 1
            end = at
        else:
            end = raw.find(delimiter, at)
            end = len(raw) if end < 0 else end
            if raw.find('"', at, end) >= 0:
                return False
        if end >= len(raw):
            return True
        at = end + 1


def _open_after(text: str, delimiter: str, inside: bool) -> bool | None:
    """Whether a quoted field is still open where ``text`` ends (``inside``: one was open where it begins); None where a closing
    quote is followed by anything but the delimiter or the line's end, so that the quoting is broken there."""
    at = 0
    while True:
        if not inside:
            if not text.startswith('"', at):  # an unquoted field: quotes in it open nothing
                at = text.find(delimiter, at) + 1
                if not at:
                    return False
                continue
            at += 1
        while (end := text.find('"', at)) >= 0 and text.startswith('"', end + 1):
            at = end + 2
        if end < 0:
            return True
        inside, at = False, end + 1
        if text.startswith(delimiter, at):
            at += 1
        else:
            return False if text[at:] in ("", "\n", "\r\n", "\r") else None


def assemble(lines: Iterable[str], delimiter: str = "\t", whole: Callable[[str], bool] | None = None) -> Iterator[str]:
    """Join physical lines into records: a line break inside a quoted field belongs to the record.

    Only a quote at the start of a field opens one.  If the quoting of the lines joined turns out to be broken, is never closed, or one
    of the lines taken in is a record of its own (``whole`` says so), only the first line is given out as the broken record
    and reading goes on with the second, so that a stray quote costs no line but its own."""
    held: deque[str] = deque()  # lines read ahead
    source = iter(lines)
    while True:
        line = held.popleft() if held else next(source, None)
        if line is None:
            return
        state = _open_after(line, delimiter, False)
        taken = [line]
        ahead = 0
        while state:
            if ahead == len(held):
                more = next(source, None)
                if more is None:
                    state = None
                    break
                held.append(more)
            more = held[ahead]
            if whole and whole(more):  # so that no more is read ahead than up to the next good line
                state = None
                break
            taken.append(more)
            ahead += 1
            state = _open_after(more, delimiter, True)
        if state is None or len(taken) == 1:
            yield line
        else:
            for _ in range(ahead):
                held.popleft()
            yield "".join(taken)


def parse_record(raw: str | None, fields: list[Field], delimiter: str = "\t") -> tuple[str | None, list[Any]]:
    """(reject reason or None, values)."""
    blank: list[Any] = [None] * len(fields)
    if raw is None:
        return "null_line", blank
    try:
        parts = split_record(raw, delimiter)
    except Broken as e:
        return str(e), blank
    if len(parts) != len(fields):
        return "column_count", blank
    values = []
    for field, text in zip(fields, parts):
        try:
            values.append(field.build(text.strip(" ")))
        except ValueError:
            return f"invalid_{field.name}", blank
    return None, values


def parse_delimited(df: DataFrame, raw: str, fields: list[Field], delimiter: str = "\t") -> DataFrame:
    """All rows of ``df`` with ``reject_reason`` and one typed column a field; narrow, no shuffle."""
    names = {f.name for f in fields} | {"reject_reason"}
    kept = [F.col(f"`{c}`").alias(f"in_{c}" if c in names and c != raw else c) for c in df.columns if c != raw]
    src = df.select(*kept, F.col(f"`{raw}`").cast("string").alias("__raw"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("reject_reason", T.StringType()), *(T.StructField(f.name, f.kind) for f in fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_record(x, fields, delimiter) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = list(batch.columns[:-1]) + [pa.array([r for r, _ in found], pa.string())]
            for i in range(len(fields)):
                columns.append(pa.array([v[i] for _, v in found], arrow.field(len(columns)).type))
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(columns)], names=schema.names)

    return src.mapInArrow(run, schema)


def read_delimited(spark: SparkSession, path: str, fields: list[Field], delimiter: str = "\t") -> DataFrame:
    """Records of text files, quoted line breaks included.  Files are the unit of work: one file is read by one task.  A line that
    is a valid record of its own is never taken into another record."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("body"))
    lines = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("raw_line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[str] = []
                for record in assemble(io.StringIO(body, newline="\n"), delimiter, lambda line: parse_record(line, fields, delimiter)[0] is None):
                    held.append(record)
                    if len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([path_] * len(held)), pa.array(held)], names=lines.names)
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([path_] * len(held), pa.string()), pa.array(held, pa.string())], names=lines.names)

    return parse_delimited(files.mapInArrow(run, lines), "raw_line", fields, delimiter)


def matching(pattern: str, change: Callable[[str], Any] = str) -> Callable[[str], Any]:
    """A constructor for values that match ``pattern`` as a whole (ASCII rules)."""
    rule = re.compile(pattern, re.ASCII)

    def build(text: str) -> Any:
        if not rule.fullmatch(text):
            raise ValueError(text)
        return change(text)

    return build


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull())


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counts(parsed: DataFrame, *by: str | Column) -> DataFrame:
    """Rows per reason; valid rows count under the reason ``ok``."""
    return parsed.groupBy(*by, F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n_lines"))
