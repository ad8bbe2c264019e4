import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M


def frames(spark, n=4000):
    rng = random.Random(1)
    rows = [(i, rng.choice(["big"] * 8 + ["Small-One ", "small_one", "tiny", "stray", None]), rng.choice([1, 5, 30, 200])) for i in range(n)]
    rows += [(n + 1, "big", 0), (n + 2, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("bucket", F.lit("clash"))
    targets = spark.createDataFrame([("big", 50.0, 1), ("small_one", 25.0, 3), ("tiny", 20.0, 2), ("empty", 5.0, 4)], "source string, target_weight double, max_repeats int")
    return rows, docs, targets


def test_budgets_epochs_and_caps(spark):
    rows, docs, targets = frames(spark)
    total = 150_000
    chosen, report = M.mix(docs, targets, total=total)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "small_one", "tiny", "empty"}
    copies = {r.doc_id: r for r in chosen.collect()}
    for s, share, cap in (("big", 0.5, 1), ("small_one", 0.25, 3), ("tiny", 0.2, 2), ("empty", 0.05, 4)):
        mine = {i: t for i, x, t in rows if x and x.strip().lower().replace("-", "_") == s and t}
        r, have, budget = got[s], sum(mine.values()), int(share * total)
        assert (r.available, r.n_docs, r.budget) == (have, len(mine), budget)
        assert r.falls_short == (have * cap < budget)
        used = {i: copies[i].copies for i in mine if i in copies}
        assert r.chosen_tokens == sum(mine[i] * c for i, c in used.items()) and all(c <= cap for c in used.values())
        epochs = min(budget // have, cap) if have else 0
        assert r.epochs == epochs and all(used.get(i, 0) in (epochs, epochs + 1) for i in mine)
        if epochs < cap and have:  # the rest is filled up to one document
            assert 0 <= budget - r.chosen_tokens < 200
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_selection_is_the_shortest_prefix_in_key_order(spark, monkeypatch, buckets):
    monkeypatch.setattr(M, "BUCKETS", buckets)
    rows, docs, targets = frames(spark, 1500)
    chosen, report = M.mix(docs, targets, total=20_000, seed=3)
    keys = docs.where("source = 'big' and n_tokens > 0").withColumn("key", M.exponential_key("doc_id", F.lit(1.0), 3)).orderBy("key", "doc_id").collect()
    budget, upto, want = 10_000, 0, set()
    for r in keys:
        upto += r.n_tokens
        if upto > budget:
            break
        want.add(r.doc_id)
    assert {r.doc_id for r in chosen.where("source = 'big'").collect()} == want


def test_heavier_documents_come_more_often(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_tokens"), (F.col("id") % 2 + F.lit(0.2)).alias("q"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_weight double, max_repeats int")
    chosen, _ = M.mix(docs, targets, quality=F.col("q"), total=1000)
    odd = chosen.where("doc_id % 2 = 1").count()
    assert chosen.count() == 1000 and 780 < odd < 920  # about 1.2 / 1.4 of them


def test_token_counts(spark):
    import base64

    import tiktoken

    texts = ["Hello  world's end\n\n x", "", None, "Å²​ 12345", "a" * 50_000, "Hello  world's end\n\n x"]
    got = {r.i: r.n_tokens for r in M.count_tokens(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_empty(spark):
    _, docs, targets = frames(spark, 10)
    chosen, report = M.mix(docs.limit(0), targets)
    assert chosen.count() == 0 and {r.actual_share for r in report.collect()} == {0.0} and report.where("falls_short").count() == 0
