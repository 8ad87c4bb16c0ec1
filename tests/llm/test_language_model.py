import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakesearch.llm import language_model as lm


def rows():
    rng = random.Random(3)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    for i in range(600):
        words = rng.choices(a if i % 2 else b, k=rng.randint(1, 60))
        if i % 9 == 0:
            words.append(f"Rare{i}x")
        yield i, rng.choice([" ", "\n", "\t "]).join(words)
    yield from [(601, None), (602, ""), (603, "  "), (604, "É É é unseenword"), (605, "a1 " * 40_000), (None, "b2"), (605, "a1 " * 40_000)]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows()], "doc_id long, text string, score double")
    # Few tokens are broadcast, so that the join is used.
    old, lm.TOP = lm.TOP, 60
    got = lm.learn_and_score(docs).collect()
    lm.TOP = old
    return got


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_base_equals_brute_force(scored):
    counts = Counter(w for i, t in rows() if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows():
        ws = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        want[i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == want


def test_model_beats_the_base_on_held_out_texts(scored):
    out = [r for r in scored if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in scored)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(t,) for _, t in rows()], "text string")
    counts = lm.materialize(lm.count_tokens(docs), "counts")
    vocab = lm.vocabulary(counts)
    model = lm.train(docs, vocab)
    m1, m2, z = model.tables()
    p = np.exp(m1[3] + m2[7] - z[3, 7])
    assert abs(p.sum() - 1) < 1e-4 and p[lm.BEGIN] < 1e-9
    known = Counter({bytes(r.token): r.c for r in counts.collect()})
    size, bins = vocab.classes, lm.first_bin(vocab.classes)
    of_class = np.zeros(size)
    for t, c in known.items():
        k = vocab.known[t][0]
        of_class[k] += 1.0 if k < bins else (c + 1) / 10 ** vocab.bin_log[k]
    of_class[bins:] += 1 / 10 ** vocab.bin_log[bins:]  # one unseen token in each bin
    used = [k for k in range(1, size) if k >= bins or any(e[0] == k for e in vocab.known.values())]
    assert np.allclose(of_class[used], 1)


def test_parameters_are_summed_in_a_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for _, t in rows()], "text string").repartition(9)
    docs = lm.materialize(docs, "texts")
    vocab = lm.vocabulary(lm.materialize(lm.count_tokens(docs), "counts"))
    flat = lm.train(docs, vocab)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    monkeypatch.setattr(lm, "COLLECT", 1)
    for x, y in zip(flat.parts(), lm.train(docs, vocab).parts()):
        assert np.allclose(x, y, atol=1e-6)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(100) if held(i)], "doc_id long, text string")
    got = lm.learn_and_score(docs).collect()
    assert got and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in got)
    assert lm.learn_and_score(docs.limit(0)).count() == 0


def chain(n, seed):
    """Texts in which a word is followed by one of two words."""
    rng = random.Random(seed)
    for _ in range(n):
        k, out = rng.randrange(50), []
        for _ in range(400):
            out.append(f"w{k}")
            k = (7 * k + rng.randrange(2)) % 50
        yield " ".join(out)


def held_out_mean(spark, parts):
    docs = lm.materialize(spark.createDataFrame([(t,) for t in chain(1000, 5)], "text string").repartition(parts), "texts")
    vocab = lm.vocabulary(lm.materialize(lm.count_tokens(docs), "counts"))
    flat, sizes, _ = lm.classes_of(list(chain(50, 6)), vocab.known, vocab.classes)
    a, b, w = lm.contexts(flat, sizes)
    start, trained = ((m1[a, w] + m2[b, w] - z[a, b]).mean() for m1, m2, z in (m.tables() for m in (lm.initial(vocab.class_counts), lm.train(docs, vocab))))
    return trained - start


def test_learning_does_not_shrink_with_the_partitions(spark):
    one, many = held_out_mean(spark, 1), held_out_mean(spark, 64)
    assert one > 0.2 and many > 0.9 * one


def test_turns_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 45_000)  # nine shards: three turns of three
    assert held_out_mean(spark, 64) > 0.2


def test_classes_grow_with_the_tokens():
    assert [lm.classes_for(n) for n in (0, 1 << 20, (1 << 24) - 1, 1 << 24, 1 << 32, 1 << 40)] == [512, 512, 512, 1024, 2048, 4096]
    assert lm.first_bin(1024) == 769


def test_scores_equal_brute_force(spark):
    """The score of each text by the definition: class probability from the normalised model, add-one within a bin."""
    docs = spark.createDataFrame([(i, t) for i, t in rows() if i is not None and i < 604], "doc_id long, text string")
    teach = docs.filter(lm.train_fold()).select("text")
    counts = lm.materialize(lm.count_tokens(teach), "counts")
    vocab = lm.vocabulary(counts)
    model = lm.train(teach, vocab)
    got = {r.doc_id: r.score for r in lm.score(docs, counts, vocab, model).collect()}
    known = {bytes(r.token): r.c for r in counts.collect()}
    size, bins = vocab.classes, lm.first_bin(vocab.classes)
    common = sorted(known, key=lambda t: (-known[t], t))[: bins - 1]
    number = {t: i + 1 for i, t in enumerate(common)}
    cls = lambda t: number.get(t) or lm.bin_of(t, size)
    inside = {k: (sum(c for t, c in known.items() if cls(t) == k), sum(cls(t) == k for t in known)) for k in range(bins, size)}
    for i, t in rows():
        if i is None or i >= 604:
            continue
        want, a, b = 0.0, 0, 0
        for w in (x.encode() for x in words(t)):
            k = cls(w)
            s = ((model.r[a] * model.c[0] + model.r[b] * model.c[1]).astype(np.float64) @ model.out.T.astype(np.float64)) + model.bias
            s[0] = -np.inf
            want += (s[k] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
            if k >= bins:
                n, v = inside[k]
                want += math.log10((known.get(w, 0) + 1) / (n + v + 1))
            a, b = b, k
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want)), i
