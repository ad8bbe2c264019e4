"""Generated query objects for testing the query layer: the schema crossed with operators and data quantiles, and ways to spoil them."""

from __future__ import annotations

import copy
import random
from collections.abc import Iterator
from itertools import combinations, product
from typing import Any

from tessera.plans.query import parse
from tessera.plans.schema import FieldSpec, QueryError, RecordType, Registry

SPOILS = ("unknown_field", "turned_operator", "wrong_unit", "dropped_filter", "unknown_value", "other_question", "prose")
_TURNED = {"lt": "gte", "gte": "lt", "gt": "lte", "lte": "gt", "eq": "ne", "ne": "eq"}


def values_of(spec: FieldSpec, quantiles: dict[str, list[float]]) -> list[Any]:
    """What a generated filter on a field compares with: data quantiles, vocabulary, yes and no."""
    return {"number": quantiles.get(spec.name, []), "enum": list(spec.enum), "bool": [True, False], "text": []}[spec.kind]


def single_filters(kind: RecordType, quantiles: dict[str, list[float]]) -> Iterator[dict[str, Any]]:
    for spec in kind.fields:
        for op, value in product(spec.ops(), values_of(spec, quantiles)):
            yield {"field": spec.name, "op": op, "value": value}


def generate(registry: Registry, quantiles: dict[str, dict[str, list[float]]], most_filters: int, n: int, seed: int = 7) -> list[dict[str, Any]]:
    """``n`` different queries (fewer where there are fewer) with one to ``most_filters`` filters on different fields; all of them parse."""
    rng = random.Random(seed)
    out: dict[str, dict[str, Any]] = {}
    for kind in registry.types.values():
        by_field: dict[str, list[dict[str, Any]]] = {}
        for f in single_filters(kind, quantiles.get(kind.name, {})):
            by_field.setdefault(f["field"], []).append(f)
        for size in range(1, most_filters + 1):
            for fields in combinations(sorted(by_field), size):
                query = {"record_type": kind.name, "filters": [rng.choice(by_field[f]) for f in fields]}
                if rng.random() < 0.5:
                    query["sort"] = {"field": rng.choice([f.name for f in kind.fields]), "direction": rng.choice(["asc", "desc"])}
                parse(query, registry)
                out[repr(query)] = query
    chosen = sorted(out)
    rng.shuffle(chosen)
    return [out[k] for k in chosen[:n]]


def composition(query: dict[str, Any]) -> str:
    """record|field:op|...: what a query asks, without its values."""
    return "|".join([query["record_type"], *sorted(f"{f['field']}:{f['op']}" for f in query["filters"])])


def spoiled(query: dict[str, Any], how: str, registry: Registry, seed: int = 7) -> Any:
    """A copy that goes wrong in one of the ways of ``SPOILS``."""
    rng = random.Random(f"{seed} {how} {query!r}")
    bad = copy.deepcopy(query)
    at = rng.randrange(len(bad["filters"]))
    f = bad["filters"][at]
    if how == "unknown_field":
        f["field"] += "_in_full"
    elif how == "turned_operator":
        f["op"] = _TURNED[f["op"]]
    elif how == "wrong_unit":
        f["value"] = f["value"] * 10 if isinstance(f["value"], (int, float)) and not isinstance(f["value"], bool) and f["value"] else "ten of them"
    elif how == "dropped_filter":
        del bad["filters"][at]
    elif how == "unknown_value":
        f["value"] = "galaxy"
    elif how == "other_question":
        bad["record_type"] = rng.choice([t for t in registry.types if t != bad["record_type"]])
    elif how == "prose":
        return f"Sure, here are the {bad['record_type']} records you asked for."
    else:
        raise ValueError(f"{how} is none of {', '.join(SPOILS)}")
    return bad


def caught(bad: Any, query: dict[str, Any], registry: Registry) -> bool:
    """Whether a spoiled query is refused, or at least no longer the query it came from."""
    try:
        return parse(bad, registry) != parse(query, registry)
    except QueryError:
        return True
