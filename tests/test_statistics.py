import math
import random

import pytest

from tessera.operators import models
from tessera.operators import statistics as S


def frame(spark, pairs):
    return spark.createDataFrame([(i, float(s) if s is not None else None, l) for i, (s, l) in enumerate(pairs)], "id bigint, score double, label int")


def scored(seed, n_pos, n_neg, digits=1):
    """Scores of both classes that overlap, with ties; some unknown."""
    rng = random.Random(seed)
    pairs = [(round(rng.gauss(0.4 * label, 0.5), digits), label) for label, n in ((1, n_pos), (0, n_neg)) for _ in range(n)]
    pairs += [(None, 1), (math.nan, 0)]
    rng.shuffle(pairs)
    return pairs, [s for s, l in pairs if l == 1 and s is not None], [s for s, l in pairs if l == 0 and not math.isnan(s)]


@pytest.mark.parametrize("seed, n_pos, n_neg", [(1, 30, 50), (2, 1, 9), (3, 40, 3), (4, 0, 6), (5, 6, 0), (6, 0, 0)])
def test_auc_counts_the_pairs_won(spark, seed, n_pos, n_neg):
    pairs, pos, neg = scored(seed, n_pos, n_neg)
    got = S.roc_auc(frame(spark, pairs), "score", "label").first()["auc"]
    if n_pos and n_neg:
        assert got == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (n_pos * n_neg))
    else:
        assert got is None
    one = [(2.5, label) for label in (0, 1, 1, 0, 1)]  # nothing but ties says nothing
    assert S.roc_auc(frame(spark, one), "score", "label").first()["auc"] == 0.5


@pytest.mark.parametrize("floors", [(0.3, 0.3), (0.9, 0.2), (0.95, 0.95), (0.0, 0.0)])
def test_sweep_against_every_cut_tried(spark, floors):
    pairs, pos, neg = scored(11, 25, 35)
    got = {r.cut: r for r in S.sweep(frame(spark, pairs), "score", "label", *floors).collect()}
    assert set(got) == {0.0, *pos, *neg}
    for cut, r in got.items():
        called = lambda s: s > 0 and s >= cut
        tp, fp = sum(map(called, pos)), sum(map(called, neg))
        if cut > 0:
            assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, len(pos) - tp, len(neg) - fp)
        assert r.passes == (r.tp / len(pos) >= floors[0] and r.tn / len(neg) >= floors[1])
    best = S.best_cut(S.sweep(frame(spark, pairs), "score", "label", *floors)).first()
    top = max(r.youden for r in got.values())
    assert best.youden == pytest.approx(top) and best.cut == min(c for c, r in got.items() if r.youden == best.youden)
    zero = S.sweep(frame(spark, [(0.0, 1), (0.5, 0)]), "score", "label").where("cut = 0").first()
    assert (zero.tp, zero.fp, zero.fn, zero.tn) == (0, 1, 1, 0)  # a score of 0 is never called


def test_mann_whitney_and_correlations(spark):
    rng = random.Random(1)
    pairs = [(round(rng.random() + 0.3 * l, 1), l) for l in (0, 1) for _ in range(40)]
    r = S.mann_whitney(frame(spark, pairs), "score", "label").first()
    pos, neg = [s for s, l in pairs if l], [s for s, l in pairs if not l]
    assert r.u == sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert abs(r.p - 0.5 * math.erfc(r.z / math.sqrt(2))) < 1e-12 and r.p < 0.05
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double")
    assert S.spearman(two, "x", "y").first()["spearman"] is None
    line = spark.createDataFrame([(float(i), float(i) ** 3) for i in range(9)] + [(None, 1.0)], "x double, y double")
    assert abs(S.spearman(line, "x", "y").first()["spearman"] - 1) < 1e-12 and S.pearson(line, "x", "y").first()["n"] == 9


def test_envelope(spark):
    rows = {r.metric: r for r in S.envelope(spark, {"a": (0.9, S.Floor(0.8), ""), "b": (0.9, S.Floor(0.8, highest=True), ""), "c": (None, S.Floor(1.0), "no data"), "d": (math.nan, None, "")}).collect()}
    assert rows["a"].passes is True and rows["b"].passes is False
    assert (rows["c"].computed, rows["c"].value, rows["c"].reason, rows["d"].computed) == (False, None, "no data", False)


def test_permutation_keeps_the_number_of_positives(spark):
    pairs = [(i / 10, int(i >= 15)) for i in range(20)]
    df = frame(spark, pairs)
    draws = S.drawn(df, "id", 10, 5, 20, 3).groupBy("draw").agg({"chosen": "count"}).collect()
    assert len(draws) == 10
    chosen = S.drawn(df, "id", 10, 5, 20, 3).where("chosen").groupBy("draw").count().collect()
    assert {r["count"] for r in chosen} == {5}
    r = S.permutation_p(df, "score", "label", 40, "id").first()
    assert r.p == pytest.approx(1 / 41) and r.observed > r.null_p95


def test_models_never_see_their_group(spark):
    rng = random.Random(2)
    rows = [(i, f"g{i % 9}", float(i % 2) + rng.gauss(0, 0.3), i % 2) for i in range(180)]
    df = spark.createDataFrame(rows, "id bigint, g string, x double, label int")
    out = models.cross_validated(df, ["x"], "label", "g", models.logistic(), folds=3)
    assert out.count() == 180 and S.roc_auc(out, "prediction", "label").first()["auc"] > 0.9
    n = models.nested_cut(df, ["x"], "label", "g", models.logistic(), folds=2).first()
    assert n.tp + n.fp + n.fn + n.tn == 180
    c = models.matched_control(df.withColumn("in_group", df.label), "in_group", 20, 15, "x", "id").first()
    assert c.own > c.control_mean and c.percentile == 1.0
    assert {r.left_out for r in models.ablation(df.withColumn("y", df.x * 0), ["x", "y"], "label", "g", models.logistic(), folds=2).collect()} == {"(none)", "x", "y"}
