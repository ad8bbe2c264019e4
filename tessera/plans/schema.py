"""The closed world that may be asked about: record types, their fields and what each field accepts."""

from __future__ import annotations

import math
from collections.abc import Callable, Collection, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EQUALITY = ("eq", "ne")
OPS = (*EQUALITY, "lt", "lte", "gt", "gte")
WORDS = {"eq": "is", "ne": "is not", "lt": "is below", "lte": "is at most", "gt": "is above", "gte": "is at least"}


class QueryError(ValueError):
    """What is wrong with a query: all faults found, each with the place in the query and what would be accepted there."""

    def __init__(self, *faults: tuple[str, str]) -> None:
        self.faults = faults
        super().__init__("; ".join(f"{place}: {text}" if place else text for place, text in faults))


def _number(raw: Any) -> float:
    if raw is True or raw is False:
        raise ValueError(raw)
    return float(raw)


_TRUTH = {w: n for n, words in enumerate(("false no 0 0.0", "true yes 1 1.0")) for w in words.split()}
#: For each kind of field: the comparisons it has, how a value is read (KeyError, TypeError or ValueError: not at all), and its name in messages.
KINDS: dict[str, tuple[tuple[str, ...], Callable[[Any], Any], str]] = {
    "number": (OPS, _number, "a number"),
    "text": (OPS, str, "text"),
    "enum": (EQUALITY, str, "a known value"),
    "bool": (EQUALITY, lambda raw: _TRUTH[str(raw).strip().lower()], "yes or no"),
}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str  # a key of KINDS
    unit: str = ""
    enum: Collection[str] = ()
    parent: str = ""  # the parent relation that holds the column; empty: the base table

    def ops(self) -> tuple[str, ...]:
        return KINDS[self.kind][0]

    def coerce(self, value: Any) -> Any:
        _, read, wanted = KINDS[self.kind]
        try:
            out = read(value)
        except (KeyError, TypeError, ValueError):
            raise QueryError((self.name, f"{value!r} cannot be read as {wanted}")) from None
        if self.kind == "enum" and self.enum and out not in self.enum:
            raise QueryError((self.name, f"{value!r} is none of its values: {listing(self.enum)}"))
        return out


def listing(names: Iterable[Any], most: int = 50) -> str:
    """Names for a message, in order; of many the first."""
    shown = list(islice(names, most + 1))
    return ", ".join(map(str, shown[:most])) + (" ..." if len(shown) > most else "")


class WideVocabulary(Collection):
    """A vocabulary too large for the driver: membership is asked of the data, so that values are checked at any size."""

    def __init__(self, values: DataFrame) -> None:
        self.values = values

    def __contains__(self, value: object) -> bool:
        return not self.values.where(F.col("v") == F.lit(str(value))).isEmpty()

    def __len__(self) -> int:
        return self.values.distinct().count()

    def __bool__(self) -> bool:
        return True

    def __iter__(self) -> Iterator[str]:
        """The first values only, for messages."""
        return iter(sorted(r[0] for r in self.values.distinct().orderBy("v").limit(51).collect()))


@dataclass(frozen=True)
class Parent:
    """A lookup relation joined by key; ``unique`` asserts that the key is unique, which legalises the base-first rewrites."""

    name: str
    base_key: str
    key: str
    columns: tuple[str, ...]
    unique: bool = True


@dataclass(frozen=True)
class RecordType:
    name: str
    table: str
    fields: tuple[FieldSpec, ...]
    identity: tuple[str, ...]
    sort: str
    descending: bool
    columns: tuple[str, ...]
    parents: tuple[Parent, ...] = ()
    status: str = "status"
    by_name: dict[str, FieldSpec] = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_name", {f.name: f for f in self.fields})

    def spec(self, name: str) -> FieldSpec:
        if not isinstance(name, str) or name not in self.by_name:
            raise QueryError(("", f"{name!r} is no field of {self.name}, which has {listing(sorted(self.by_name))}"))
        return self.by_name[name]

    def selectable(self) -> set[str]:
        return {*self.by_name, *self.identity, *self.columns}


class Registry:
    def __init__(self, types: Iterable[RecordType]) -> None:
        self.types = {t.name: t for t in types}

    def get(self, name: Any) -> RecordType:
        if not isinstance(name, str) or name not in self.types:
            raise QueryError(("record_type", f"{name!r} is not known; there are {listing(sorted(self.types))}"))
        return self.types[name]

    def with_vocabularies(self, found: dict[tuple[str, str], Collection[str]]) -> Registry:
        """Enum fields whose vocabulary is read from data; a field without values stays unconstrained."""
        out = []
        for t in self.types.values():
            out.append(replace(t, fields=tuple(replace(f, enum=v if isinstance(v := found[t.name, f.name], WideVocabulary) else tuple(v)) if found.get((t.name, f.name)) else f for f in t.fields)))
        return Registry(out)

    def summary(self) -> dict[str, Any]:
        """The schema as it may be published."""
        return {
            t.name: {"fields": [{"name": f.name, "kind": f.kind, "unit": f.unit, "values": list(f.enum), "ops": list(f.ops())} for f in t.fields], "sort": t.sort, "direction": "desc" if t.descending else "asc", "columns": list(t.columns), "identity": list(t.identity)}
            for t in self.types.values()
        }


def vocabulary(df: DataFrame, column: str, limit: int = 1_000) -> Collection[str]:
    """Distinct values, neither null nor blank: a sorted list, or one that is asked of the data where there are more than ``limit``."""
    values = df.select(F.col(column).cast("string").alias("v")).where("v is not null and trim(v) <> ''")
    rows = values.distinct().limit(limit + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= limit else WideVocabulary(values)


def is_nan(value: Any) -> bool:
    return isinstance(value, float) and math.isnan(value)
