import zlib

from lakesearch.llm import toxicity as tx


def rows(n=400):
    fill = ["wind over the harbour", "grain and copper prices", "letters from the valley", "rain on slate roofs"]
    for i in range(n):
        bad = i % 4 == 0
        yield i, f"{fill[i % 3]} number {i} {'you utter numbskull ' if bad else 'kind regards '}{fill[(i * 7) % 4]}" * (1 + i % 3), int(bad)


def test_learns_and_keeps_folds(spark):
    data = list(rows())
    docs = spark.createDataFrame([(i, t, "keep") for i, t, _ in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.classify(docs, labels, sample_rows=50, n_features=300).collect()}
    for i, _, y in data:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == y and 0 <= got[i].score <= 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "abc"), (4, "x" * 2_000_000), (4, "x" * 2_000_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tx.classify(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got)
    some = spark.createDataFrame([(1, 0), (4, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in tx.classify(docs, some).collect())
    assert tx.classify(docs.limit(0), some).count() == 0


def test_segments_match_a_plain_set():
    text = "Abc déf " * 200_000
    raw = text.encode().lower()
    want = set()
    for n in tx.ORDERS:
        for i in range(8 * 3):
            want.add(raw[i : i + n])
    d, f = tx.features([None, text, ""])
    assert set(d) == {1}
    small = tx.features([text[: 8 * 10]])[1]
    assert set(small) == set(f)  # segments add nothing, but for the padding at their ends, which the small text has too


def test_scores_equal_brute_force(spark):
    """The score by the definition: the weights of the distinct n-grams of the text, and the intercept."""
    import math

    data = list(rows(200)) + [(900, None, 0), (901, "ab", 0), (902, "É" * 50, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "id long, text string")
    labelled = spark.createDataFrame([(i, y) for i, _, y in data], "id long, label int")
    model = tx.fit(docs, labelled, sample_rows=40, n_features=200)

    def bucket(gram):
        h = gram[0] + 1
        for x in gram[1:]:
            h = (h * 0x01000193 + x + 1) % 2**32
        x = (h ^ len(gram) * 0x9E3779B1 % 2**32) * 0x85EBCA6B % 2**32
        x ^= x >> 15
        return x * 0xC2B2AE35 % 2**32 >> 32 - tx.BITS

    def score(text):
        raw = (text or "").encode().lower()
        # n-grams that reach beyond the end are padded with zero bytes
        padded = raw + bytes(max(tx.ORDERS) - 1)
        found = {model.slot[bucket(padded[i : i + n])] for n in tx.ORDERS for i in range(len(raw))}
        z = model.bias + sum(float(model.weight[f]) for f in found if f >= 0)
        return 1 / (1 + math.exp(-z))

    got = {r.id: r.score for r in tx.score(docs, model).collect()}
    assert all(abs(got[i] - score(t)) < 1e-6 for i, t, _ in data)
    assert len({round(x, 9) for x in got.values()}) > 2
