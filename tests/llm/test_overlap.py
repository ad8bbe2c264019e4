import random

import pytest

from tessera.llm import overlap as O
from tessera.llm.requests import REQUESTS as G


def conditions(text):
    r = O.read(text, G, {})
    return r.complete, r.conditions


BASE = "Fetch bridges with buried surface at least 1,200.50 A2 and method other than X-RAY, highest first"
SAME = [
    "fetch  ligand bridges with method different from x ray, with buried area not below 1200.5 square angstroms, please!!",
    "hi could you FETCH BRIDGES WITH BURIED SURFACE NO LESS THAN 1200.50 Å2 AND METHOD OTHER THAN X-RAY",
    "Fetch brdiges with buriied sruface at leats 1200.5 Å² , with metod othher than X-RAY - needed today",
]
OTHER = [
    BASE.replace("1,200.50", "1200.51"), BASE.replace("at least", "above"), BASE.replace("buried surface", "ligand weight"), BASE.replace("other than", "equal to"), BASE.replace("X-RAY", "NMR"), BASE.replace(" and method other than X-RAY", ""), BASE.replace(", highest", " and resolution below 2, highest"),
]


def test_reading():
    assert conditions(BASE) == (True, [("dsasa_total", "gte", "1200.5"), ("method", "ne", "x ray")])
    assert all(conditions(t) == conditions(BASE) for t in SAME)
    assert all(conditions(t) != conditions(BASE) for t in OTHER)
    assert conditions("List degrons with tip residue equal to A, with geometry score not above .5") == (True, [("degron_geometry_score", "lte", "0.5"), ("tip_aa", "eq", "a")])
    assert not conditions("what about 7?")[0] and not conditions("")[0]


@pytest.mark.parametrize("word, want", [("sore", "score"), ("bing", "being"), ("lest", "least"), ("udner", "under"), ("baalcne", "balance"), ("distacne", "distance"), ("x", "x"), ("zebra", "zebra")])
def test_slips(word, want):
    assert G.mend(word) == want


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    values, rows = ["0.5", "0.50", "12", "1,200", "1200.0"], []
    for i in range(400):
        parts = [f"{rng.choice(['buried fraction', 'covered share of the ligand'])} {rng.choice(['above', 'over', 'below'])} {rng.choice(values)}", f"ligand weight {rng.choice(['at most', 'not above'])} {rng.choice(values)}"]
        rng.shuffle(parts)
        rows.append((i, rng.choice(["train", "valid", "test", "TEST ", "other"]), "bridge", rng.choice(["List bridges with ", "please show bridges with "]) + " and ".join(parts[: rng.choice([1, 2])]), None))
    rows += [(1000, "train", "bridge", BASE, "BRIDGE|dsasa_total:gte|method:ne"), (1001, "test", "bridge", SAME[0], None), (1002, "valid", "bridge", SAME[2], ""), (1003, "test", "lysine", BASE, None), (1004, "test", "bridge", None, None), (1005, "train", "bridge", "", None), (1006, "test", None, BASE, None), (1007, "train", "bridge", BASE, None)]
    rows += [(2000 + i, "test", "bridge", t, None) for i, t in enumerate(OTHER)] + [(3000, "test", "bridge", "list bridges " * 3000 + "with " + BASE, None)]
    df = spark.createDataFrame(rows, "sample_id bigint, split string, record_type string, prompt string, composition string").selectExpr("*", "1 as code", "'x' as cls")
    prints = O.fingerprints(df, "sample_id", "split", "record_type", "prompt", "composition", G)
    got = {(r.id_a, r.id_b) for r in O.overlaps(prints, ["train"], ["valid", "test"]).collect()}
    read = {i: (k, *conditions(t)) for i, _, k, t, _ in rows if t and k}
    side = {i: s.strip().lower() for i, s, *_ in rows}
    want = {tuple(sorted((a, b))) for a in read for b in read if side[a] == "train" and side[b] in ("valid", "test") and read[a] == read[b] and read[a][1]}
    assert got == want and (1000, 1001) in got and (1002, 1007) in got and (1000, 3000) in got


def test_unread_requests_need_nearly_the_same_words(spark):
    text = "Rank the frobnication of 12 widgets by their gloss 0.7 in the third hall of the north wing"
    rows = [(1, "train", "b", text, None), (2, "test", "b", text.upper() + "!", None), (3, "test", "b", text.replace("12", "13"), None), (4, "test", "b", "Something of 12 else entirely 0.7", None), (5, "train", "b", "no numbers or fields here", None), (6, "valid", "b", "No numbers, or fields here.", None)]
    prints = O.fingerprints(spark.createDataFrame(rows, "i bigint, s string, k string, p string, c string"), "i", "s", "k", "p", "c", G)
    assert {(r.id_a, r.id_b) for r in O.overlaps(prints, ["train"], ["valid", "test"]).collect()} == {(1, 2), (5, 6)}
    assert O.overlaps(prints.limit(0), ["train"], ["test"]).count() == 0
