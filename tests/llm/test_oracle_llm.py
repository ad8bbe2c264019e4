"""Every registered query of the training-data problems: those with SQL give its rows, the others what is known of their result."""

import hashlib

import pytest
from oracle import compare

from tessera.llm.queries import QUERIES, SQL

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Rows and digest of the sorted rows at sf0.01, as first seen; they only guard against change, right results are tested beside the operators.
KNOWN = {"p4_found": (21, "83d7c77d5dcb4a618d7133e08face32b"), "p4_report": (6, "6bb6f355db180f16d7fb14688f921a08"), "p7_spans": (102, "95b6db9ca4a4cba77695e41352074598")}
#: Cases by kind at sf0.01; names may differ by a few with the machine's arithmetic.
KINDS = {"email": 77, "identity_number": 26, "person_name": 115, "phone": 55, "street_address": 45}


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_against_sql(spark, name):
    _, difference = compare(spark, SF, QUERIES[name], SQL[name])
    assert not difference, difference


@pytest.mark.parametrize("name", KNOWN)
def test_known_rows(spark, name):
    rows = sorted(map(tuple, QUERIES[name](spark, LARGER).collect()), key=str)
    assert (len(rows), hashlib.md5(str(rows).encode()).hexdigest()) == KNOWN[name]


def test_classes_agree_with_pairs(spark):
    pairs = QUERIES["p4_found"](spark, LARGER).collect()
    linked = {r.sample_id: r for r in QUERIES["p4_classes"](spark, LARGER).collect()}
    assert {i for i, r in linked.items() if r.n_links} == {x for p in pairs for x in p}


def test_personal_data(spark):
    kinds = {r.kind: r for r in QUERIES["p9_kinds"](spark, LARGER).collect()}
    assert set(kinds) == set(KINDS) and all(abs(kinds[k].n_cases - n) <= 0.03 * n for k, n in KINDS.items())
    found = QUERIES["p9_found"](spark, LARGER).collect()
    assert len(found) == len(set(found)) == sum(r.n_cases for r in kinds.values())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()}
    redacted = {r.doc_id: r.text for r in QUERIES["p9_redacted"](spark, LARGER).collect()}
    assert redacted.keys() == docs.keys() and {d for d in docs if docs[d] != redacted[d]} == {r.doc_id for r in found}


def test_mix(spark):
    chosen = QUERIES["p8_mix"](spark, LARGER).collect()
    shares = {r.source: r for r in QUERIES["p8_shares"](spark, LARGER).collect()}
    assert len({r.doc_id for r in chosen}) == len(chosen) and len(shares) == 9
    for s, r in shares.items():
        assert sum(c.tokens * c.copies for c in chosen if c.source == s) == r.chosen_tokens <= r.budget


def test_all_are_tried():
    assert set(QUERIES) == {*SQL, *KNOWN, "p4_classes", "p8_mix", "p8_shares", "p9_found", "p9_redacted", "p9_kinds"}
