import random

import numpy as np

from tessera.llm import fmindex as M


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for alphabet, n in ((2, 400), (5, 3000), (90, 2000)):
        s = rng.integers(1, alphabet + 1, n)
        s[n // 2 : n // 2 + n // 4] = s[: n // 4]
        index = M.ShardIndex(s)
        for length in (1, 3, 7):
            phrases = np.array([s[i : i + length] for i in rng.integers(0, n - length, 25)] + [rng.integers(1, alphabet + 2, length) for _ in range(25)])
            which, at = index.search(phrases)
            want = {(p, i) for p, phrase in enumerate(phrases) for i in range(n - length + 1) if (s[i : i + length] == phrase).all()}
            assert set(zip(which.tolist(), at.tolist())) == want and len(at) == len(want)


def shared(a, b, n):
    grams = lambda t: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    return bool(grams(M.words(a)) & grams(M.words(b)))


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Å", "naïve", "x2", "DIE"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(30)) for i in range(12)] + [(12, None), (13, ""), (14, "too short"), (15, None)]
    items[15] = (15, items[0][1][:60] + " " + text(12))
    docs = []
    for i in range(150):
        pick = items[rng.randrange(12)][1].split()
        cut = pick[rng.randrange(10) :][: rng.choice([4, 11, 12, 20])]
        joined = rng.choice([" ", "_", " ­", "\n", ", ", "​ "]).join(cut).replace("w1", rng.choice(["w1", "W​1", "W1"]))
        docs.append((i, rng.choice([text(9), ""]) + " " + joined + " " + text(7)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (903, items[1][1] * 2), (904, text(60_000) + " " + items[2][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'clash' as item_id", "1 as start_pos").repartition(5)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    found = M.leaks(d, it).collect()
    want = {(a, b) for a, t in docs if t for b, u in items if u and shared(t, u, 12)}
    assert {(r.doc_id, r.item_id) for r in found} == want and (904, 2) in want and (902, 0) not in {(-1, -1)}
    by_id = dict(docs)
    for r in found:  # the span in the text as written holds what it says
        assert len(M.words(by_id[r.doc_id][r.start_pos : r.end_pos])) == r.n_words >= 12
    spans = sorted((r.start_pos, r.end_pos) for r in found if (r.doc_id, r.item_id) == (903, 1))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_blocks_and_empty(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    d = spark.createDataFrame([(1, f"x {passage} y"), (2, f"x {passage.upper()}. thirteen"), (3, f"x {passage} y"), (None, passage)], "doc_id bigint, text string")
    it = spark.createDataFrame([(i, passage if i % 2 else f"{passage} thirteen") for i in range(6)], "item_id bigint, text string")
    once = sorted(map(tuple, M.leaks(d, it).collect()))
    assert {x[:2] for x in once} == {(a, b) for a in (1, 2, 3) for b in range(6)}
    for size in (60, 130, 200):  # one, two and three items a block
        assert sorted(map(tuple, M.leaks(d, it, block_chars=size).collect())) == once
    assert M.leaks(d.limit(0), it).count() == 0 and M.leaks(d, it.limit(0)).count() == 0


def test_every_word_is_indexed_in_every_shard(spark):
    """Indexes answer phrases that were not known when they were built, and hold all words."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(60))) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    shards = M.indexes(d, "doc_id", "text", shard_words=300).collect()
    assert len(shards) > 4
    held = [M.pickle.loads(s["index"]) for s in shards]
    assert sum(state[0] - 1 - len(owners) for state, _, _, owners in held) == sum(len(t.split()) for t in dict.fromkeys(texts))
    for k in rng.sample(range(80), 20):
        w = texts[k].split()
        if len(w) >= 3:
            block = M.Block([(k, " ".join(w[1:3]))], 2)
            assert k in {r[0] for s in shards for r in M._hits(s["index"], s["texts"], block)}


def test_suffix_order():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (2, 1), (50, 2), (400, 1), (500, 1 << 21), (300, 3)):
        s = np.append(rng.integers(1, top + 1, n), 0)
        assert M.suffix_order(s).tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())


def test_words():
    assert M.words("Foo_bar ba­z​q, x2²! Ünï É") == ["foo", "bar", "bazq", "x2²", "ünï", "é"]
