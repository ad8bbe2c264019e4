"""Moments of a class cover all its areas, extreme and negative ones too."""

import math

from tessera.catalog import relational as R


def test_extreme_and_negative_areas_count(spark, monkeypatch):
    rows = [("a", 10.0), ("a", -20.0), ("a", 9000.0), ("a", 30.0), ("a", math.nan), ("a", None), ("b", 1e6), (None, 1.0), (None, 2.0), (None, 6001.0), ("c", None)]
    df = spark.createDataFrame(rows, "ccd_class string, dsasa_total double")
    monkeypatch.setattr(R, "bridges", lambda spark, sf: df)
    got = {r.ccd_class: (r["mean"], r.smallest, r.largest, r.median) for r in R.class_moments(spark, "").collect()}
    assert got == {"a": (2255.0, -20.0, 9000.0, 20.0), "b": (1e6, 1e6, 1e6, 1e6), None: (2001.3333333333333, 1.0, 6001.0, 2.0)}
