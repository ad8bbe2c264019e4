from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.catalog.atlas import REGISTRY
from tessera.plans import corpus as C
from tessera.plans.query import parse
from tessera.plans.schema import OPS, QueryError

NUMBERS = {t.name: {f.name: [0.5, 2.0, 100.0] for f in t.fields if f.kind == "number"} for t in REGISTRY.types.values()}
QUERIES = C.generate(REGISTRY, NUMBERS, 2, 150)


def test_generated_queries_parse_and_differ():
    assert len(QUERIES) == 150 == len({repr(q) for q in QUERIES})
    assert C.generate(REGISTRY, NUMBERS, 2, 150) == QUERIES
    assert set(Counter(q["record_type"] for q in QUERIES)) == set(REGISTRY.types)
    for q in QUERIES:
        p = parse(q, REGISTRY)
        assert parse(p.as_dict(), REGISTRY) == p and C.composition(q).count("|") == len(q["filters"])


@pytest.mark.parametrize("how", C.SPOILS)
def test_every_spoil_is_caught(how):
    assert all(C.caught(C.spoiled(q, how, REGISTRY), q, REGISTRY) for q in QUERIES)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(["record_type", "filters", "sort", "limit", "x"]), st.one_of(st.none(), st.text(max_size=8), st.integers(), st.booleans(), st.lists(st.dictionaries(st.sampled_from(["field", "op", "value"]), st.one_of(st.sampled_from(["dsasa_total", "method", *OPS]), st.floats(), st.none(), st.text(max_size=5))), max_size=3))))
def test_any_object_parses_or_is_refused(source):
    try:
        assert 1 <= parse({"record_type": "bridge", **source}, REGISTRY).limit <= 5000
    except QueryError as e:
        assert str(e)
