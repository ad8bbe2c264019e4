"""Parts by protein and day add up to every row of a day and of a protein, also where the other key is unknown."""

import datetime

from tessera.llm import queries as L

DAY = datetime.datetime(2024, 3, 1, 12)
ROWS = [("p1", DAY, 1.0), (None, DAY, 2.0), ("  ", DAY, 3.0), ("P1 ", None, 4.0), (None, None, 5.0), ("p2", DAY, None)]


def _made(spark, path):
    rows = [(acc, at, v, v) for acc, at, v in ROWS]
    spark.createDataFrame(rows, "uniprot_acc string, measured_at timestamp, nz_rel_sasa double, cb_cb_distance double").write.parquet(f"{path}/lysine.parquet")
    return str(path)


def _found(df, key):
    return {(r["metric"], r[key]): (r["n"], r["p50"]) for r in df.collect()}


def test_unknown_other_key_counts(spark, tmp_path):
    sf = _made(spark, tmp_path)
    for metric in ("nz_rel_sasa", "cb_cb_distance"):
        assert _found(L.p2_day(spark, sf), "day")[metric, "2024-03-01"] == (3, 2.0)
        assert _found(L.p2_protein(spark, sf), "uniprot_acc")[metric, "P1"] == (2, 1.0)
    assert {k[1] for k in _found(L.p2_day(spark, sf), "day")} == {"2024-03-01"}
    assert {k[1] for k in _found(L.p2_protein(spark, sf), "uniprot_acc")} == {"P1"}
    assert [(r.uniprot_acc, r.day, r.n) for r in L.p2_protein_day(spark, sf).collect()] == [("P1", "2024-03-01", 1)] * 2
