"""From a query object to a DataFrame plan.

Catalyst keeps a limit above an outer join and joins to count, because it does not know that the parents' keys are
unique.  The record type does: where filters and sort touch base columns only, the base table is filtered, sorted
and cut first and only the survivors are joined, and counts leave the parents out.  Every order ends with the
identity columns, so that equal sort values come out alike on either path.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.query import Query
from tessera.plans.schema import QueryError, RecordType, is_nan, listing

_APPLY: dict[str, Callable] = {"eq": eq, "ne": ne, "lt": lt, "lte": le, "gt": gt, "gte": ge}


class Planner:
    def __init__(self, read: Callable[[str], DataFrame]) -> None:
        """``read``: the DataFrame of a table name."""
        self.read = read

    def base(self, kind: RecordType) -> DataFrame:
        return self.read(kind.table).where(F.col(kind.status) == "ok")

    def joined(self, df: DataFrame, kind: RecordType, only: set[str] | None = None) -> DataFrame:
        for p in kind.parents:
            if only is None or p.name in only:
                parent = self.read(p.name).select(F.col(p.key).alias(f"__{p.name}"), *p.columns)
                df = df.join(parent, df[p.base_key] == parent[f"__{p.name}"], "left").drop(f"__{p.name}")
        return df

    @staticmethod
    def predicate(query: Query, parents: bool | None = None) -> Column:
        """AND of the filters; NaN compares with nothing."""
        tests = [F.lit(True)]
        for f in query.filters:
            if parents is None or bool(f.spec.parent) == parents:
                tests.append(F.lit(False) if is_nan(f.value) else _APPLY[f.op](F.col(f.spec.name), F.lit(f.value)))
        return reduce(and_, tests)

    @staticmethod
    def order(query: Query) -> list[Column]:
        key = F.col(query.sort.name)
        return [key.desc_nulls_last() if query.descending else key.asc_nulls_first(), *(F.col(c) for c in query.record_type.identity)]

    @staticmethod
    def columns(query: Query, wanted: list[str] | None = None) -> list[str]:
        kind = query.record_type
        chosen = list(wanted or kind.columns)
        if bad := [c for c in chosen if c not in kind.selectable()]:
            raise QueryError(("columns", f"{kind.name} cannot give {listing(bad)}, only {listing(sorted(kind.selectable()))}"))
        return list(dict.fromkeys([*kind.identity, *chosen]))

    def base_first(self, query: Query) -> bool:
        return not query.touched() and all(p.unique for p in query.record_type.parents)

    def execute(self, query: Query, wanted: list[str] | None = None, base_first: bool | None = None) -> DataFrame:
        kind, columns = query.record_type, self.columns(query, wanted)
        base_first = self.base_first(query) if base_first is None else base_first
        needed = {p.name for p in kind.parents if set(p.columns) & {*columns, query.sort.name, *(f.spec.name for f in query.filters)}}
        if base_first:
            top = self.base(kind).where(self.predicate(query)).orderBy(*self.order(query)).limit(query.limit)
            return self.joined(top, kind, needed).orderBy(*self.order(query)).select(*columns)
        wide = self.joined(self.base(kind).where(self.predicate(query, parents=False)), kind, needed)
        return wide.where(self.predicate(query, parents=True)).orderBy(*self.order(query)).limit(query.limit).select(*columns)

    def matching(self, query: Query) -> DataFrame:
        """All rows that match, joined only with the parents that filters need; sort and limit play no part."""
        needed = {f.spec.parent for f in query.filters if f.spec.parent} | {p.name for p in query.record_type.parents if not p.unique}
        rows = self.base(query.record_type).where(self.predicate(query, parents=False))
        return self.joined(rows, query.record_type, needed).where(self.predicate(query, parents=True))

    def count(self, query: Query) -> DataFrame:
        return self.matching(query).agg(F.count("*").alias("n"))

    def identity(self, query: Query) -> DataFrame:
        return self.matching(query).select(*query.record_type.identity)

    def same_rows(self, a: Query, b: Query) -> bool:
        """Whether two queries match the same rows."""
        x, y = self.identity(a), self.identity(b)
        return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()

    def lookup(self, kind: RecordType, key: dict[str, object]) -> DataFrame:
        """One record with each parent as a nested struct."""
        df = self.read(kind.table).where(reduce(and_, [F.col(k) == F.lit(v) for k, v in key.items()]))
        for p in kind.parents:
            parent = self.read(p.name)
            parent = parent.select(F.col(p.key).alias(f"__{p.name}"), F.struct(*parent.columns).alias(p.name))
            df = df.join(parent, df[p.base_key] == parent[f"__{p.name}"], "left").drop(f"__{p.name}")
        return df
