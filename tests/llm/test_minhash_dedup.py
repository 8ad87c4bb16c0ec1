import random
import re

import numpy as np

from lakesearch.llm import components as cc, minhash_dedup as mh


def plain_set(text, k):
    ws = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    k = min(k, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def brute(rows, k, percent):
    sets = [(i, plain_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choices(vocab, k=rng.randint(1, 120)) for _ in range(n // 6)]
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        yield i * 7, rng.choice([" ", "\n", " \t"]).join(words).replace("w1", rng.choice(["W1", "w1"]))


def check(spark, rows, k=3, percent=85):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.cluster(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_equals_brute_force(spark):
    check(spark, list(corpus(400, 1)))


def test_near_group_without_a_common_center(spark, monkeypatch):
    # A chain of drifting copies: far ends don't link, and no star closes the bucket.
    monkeypatch.setattr(mh, "BLOCK", 7)
    rng = random.Random(2)
    words = [f"t{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        words = list(words)
        for _ in range(2):
            words[rng.randrange(150)] = f"t{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    check(spark, rows)


def test_edges(spark):
    long = "word " * 300_000
    rows = [(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "One", 1), (5, "one", 1), (6, "one two", 1), (7, long, 1), (8, long + "end", 1), (None, "one", 1), (None, "one", 2), (9, "x" * 100_000, 1), (10, "X" * 100_000, 1), (4, "One", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in mh.cluster(docs, 3, 85).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 2, 8), (None, 1, None), (None, 1, None), (9, 1, 9), (10, 1, 9)]
    assert got == sorted(want, key=str)
    kept = mh.deduplicate(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 8, 9, None, None], key=str)
    assert mh.cluster(docs.limit(0)).count() == 0


def test_an_id_with_two_texts(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "k l m n"), (9, "a b c d"), (3, "k l m n")], "doc_id long, text string")
    assert {r.component_id for r in mh.cluster(docs, 3, 85).collect()} == {3}


def test_hashes_are_of_words():
    text = "Ab é\tcd\n\nx" * 3 + " " + "q" * 90 + " " + "q" * 91 + " Q" + "q" * 89
    ws = re.findall("[^\x20\x09-\x0d]+", text.lower())
    h = mh.word_hashes(text.encode())
    assert len(h) == len(ws) and len(set(h)) == len(set(ws))
    assert [list(h).index(x) for x in h] == [ws.index(w) for w in ws]


def test_plan_and_posterior():
    for t in (0.8, 0.85, 0.5):
        bands, rows = mh.plan_bands(t)
        assert (1 - t**rows) ** bands <= mh.MISS and bands * rows <= mh.HASHES
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2**32, (5000, mh.HASHES), dtype=np.uint32)
    x = np.where(rng.random(y.shape) < 0.85, y, y + np.uint32(1))
    assert len(mh.survive(x, y, 0.85, 1e-6)) >= 4998
    x = np.where(rng.random(y.shape) < 0.4, y, y + np.uint32(1))
    assert len(mh.survive(x, y, 0.85, 1e-6)) <= 5


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(500, 500 + i) for i in range(1, 50)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
