"""BM25 against SQLite's full-text index, vectors and fusion against numpy, diversity and windows."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesearch.functions import text
from lakesearch.operators import adaptive, bm25, diversify, fusion, vector

WORDS = "alpha beta gamma delta don't naïve naive file type engine 認證 x1 run_time".split()


def corpus(spark, texts):
    rows = [(i, "even" if i % 2 == 0 else "odd", x) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, kb_id string, index_text string")


def search(spark, texts, queries, mode, scope=None):
    c = corpus(spark, texts)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    out = {}
    for r in bm25.bm25(bm25.postings(c), bm25.doc_stats(c), q, mode, scope).collect():
        out.setdefault(r.query_id, {})[r.id] = r.score
    return out


def fts5(texts, terms, glue):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    for i, x in enumerate(texts):
        db.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i, x))
    quoted = glue.join('"' + t.replace('"', '""') + '"' for t in terms)
    return {r[0]: -r[1] for r in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (quoted,))}


def test_bm25_equals_fts5(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(60)] + [""]
    tokenized = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i long, x string").orderBy("i").select(text.pretokenize(F.col("x"))).collect()]
    queries = ["alpha", "alpha beta", "don't", "naïve naive", "認證 alpha", "run_time", "absent alpha", "file type"]
    for mode, glue in (("and", " AND "), ("or", " OR ")):
        got = search(spark, texts, queries, mode)
        for i, q in enumerate(queries):
            # A CJK term is two adjacent tokens of the index, as in the pretokenised text.
            terms = [t for t in q.split() if t != "認證"] + (["認 證"] if "認證" in q else [])
            want = fts5(tokenized, terms, glue)
            if "認證" in q:
                continue  # the query side splits it into two terms
            assert got.get(i, {}) == pytest.approx(want, abs=1e-9), (mode, q)


def test_terms_without_tokens(spark):
    texts = ["alpha , beta", "alpha"]
    assert search(spark, texts, ["alpha ,"], "and") == {}
    assert set(search(spark, texts, ["alpha ,"], "or")[0]) == {0, 1}
    assert search(spark, texts, ["", ","], "fallback") == {}


def test_fallback_and_scope(spark):
    texts = ["alpha beta", "alpha", "beta", "alpha gamma"]  # even: 0, 2; odd: 1, 3
    assert set(search(spark, texts, ["alpha beta"], "fallback")[0]) == {0}
    by_kb = search(spark, texts, ["alpha beta"], "fallback", "kb")[0]
    assert set(by_kb) == {0, 1, 3}  # only the odd base relaxes
    assert by_kb[0] == search(spark, texts, ["alpha beta"], "and")[0][0]  # statistics are of all bases


def test_chunks_and_postings_hold_the_same(spark):
    """A pass over the chunks and the stored postings give equal hits, in every mode; phrases, repeated and empty terms too."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(80)] + ["", None]
    c = corpus(spark, texts).repartition(3)
    asked = ["alpha beta", "don't don't alpha", "run_time x1", "認證 gamma", "absent", "alpha ,", "", None, "file type engine", "naïve"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = [bm25.Found.in_chunks(c, a) for a in bm25.blocks(q)]
    for mode, scope in (("and", None), ("or", None), ("fallback", None), ("fallback", "kb")):
        rows = lambda df: {(r.query_id, r.id, r.kb_id): r.score for r in df.collect()}
        want = rows(bm25.bm25(bm25.postings(c), bm25.doc_stats(c), q, mode, scope))
        assert want and rows(bm25.search(found, c, mode, scope)) == want


@pytest.mark.parametrize("by", [("query_id",), ("query_id", "kb_id")])
@pytest.mark.parametrize("mode", ["and", "or", "fallback"])
def test_a_task_keeps_its_best_hits_only(spark, monkeypatch, mode, by):
    """What is shuffled grows with tasks, queries and the limit, not with queries times chunks; the best stay, and of
    equal texts the smaller ids."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS[:6], k=5)) for _ in range(400)] + ["alpha beta gamma"] * 200
    c = corpus(spark, texts).coalesce(2)
    q = spark.createDataFrame(list(enumerate(["alpha beta", "gamma", "beta delta absent"])), "query_id long, query string")
    scope = "kb" if len(by) > 1 else None
    rows = lambda df: sorted((r.query_id, r.kb_id, r.rank, r.id, r.score) for r in df.collect())
    want = rows(bm25.top(bm25.bm25(bm25.postings(c), bm25.doc_stats(c), q, mode, scope), 4, by))
    found = [bm25.Found.in_chunks(c, a) for a in bm25.blocks(q)]
    hits = bm25.search(found, c, mode, scope, by, 4)
    assert rows(bm25.top(hits, 4, by)) == want
    assert hits.count() <= found[0].table.rdd.getNumPartitions() * 3 * 2 * len(by) * 4
    # The same with little room, so that rows are dropped and passed on many times
    for name, room in (("HITS", 50), ("CELLS", 7), ("QUERY_TILE", 2)):
        monkeypatch.setattr(bm25, name, room)
    f = found[0]
    idf = np.maximum(np.log((f.n - f.df + 0.5) / (f.df + 0.5)), bm25.LEAST_IDF)
    work = bm25.Scorer(f.asked, f.df, idf, f.avgdl, mode == "and", "kb_id" in by, 4, None, None)
    kept = [r for b in work.run(iter(f.table.toArrow().to_batches(40))) for r in b.to_pylist()]
    top = bm25.top(spark.createDataFrame([(r["query_id"], r["id"], r["kb_id"], r["score"], r["every"]) for r in kept], "query_id long, id long, kb_id string, score double, every boolean"), 4, (*by, "every"))
    every = bm25.top(f.hits(mode, by, 4), 4, (*by, "every"))
    assert sorted(top.collect()) == sorted(every.collect())


def test_few_queries_a_pass(spark, monkeypatch):
    texts = ["alpha beta", "alpha", "beta", "alpha gamma", "don't"]
    asked = ["alpha beta", "gamma", "don't", "alpha"]
    want = search(spark, texts, asked, "fallback")
    monkeypatch.setattr(bm25, "BLOCK_PHRASES", 1)
    assert search(spark, texts, asked, "fallback") == want


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, str(i % 3), [float(x) for x in v]) for i, v in enumerate(m)] + [(900, "0", [1.0]), (901, "0", None)], "id long, kb_id string, embedding array<float>").repartition(5)
    queries = rows.filter("id % 50 = 0 and id < 300").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    sims = m.astype(np.float64) @ m.astype(np.float64).T
    got = {}
    for r in vector.search(rows, queries, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert sorted(got) == [0, 50, 100, 150, 200, 250]
    for q, hits in got.items():
        best = sorted(range(300), key=lambda i: (-sims[q, i], i))[:7]
        assert [i for _, i, _ in sorted(hits)] == best
        assert [s for *_, s in sorted(hits)] == pytest.approx([sims[q, i] for i in best])
    assert vector.search(rows, queries, 2, by_kb=True).count() == 6 * 3 * 2
    assert vector.search(rows, queries.limit(0), 2).count() == 0 and vector.search(rows.limit(0), queries, 2).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, "k", 1, 100.0), (1, "k", 2, 20.0), (1, "k", 3, 1.0)], "query_id long, kb_id string, id long, score double")
    b = spark.createDataFrame([(1, "k", 1, 0.95), (1, "k", 2, 0.7), (1, "k", 4, 0.2)], "query_id long, kb_id string, id long, score double")
    got = {r.id: r.score for r in fusion.weighted(a, b).collect()}
    assert got[1] == pytest.approx(1.15) and got[3] == got[4] == 0.0 and got[1] - got[2] > 0.5
    one = fusion.weighted(a.filter("id = 1"), b.limit(0)).collect()
    assert [r.score for r in one] == [pytest.approx(0.45)]
    lists = a.withColumn("list", F.lit(0)).unionByName(b.withColumn("list", F.lit(1)))
    rrf = {r.id: r.score for r in fusion.reciprocal_rank(lists).collect()}
    assert rrf[1] == pytest.approx(2 / 61) and rrf[4] == pytest.approx(1 / 63)


def candidates(n, rng):
    return [
        {"query_id": 1, "rank": i + 1, "id": i, "kb_id": "k", "file_path": f"f{rng.randint(0, 3)}", "score": rng.random(), "tokens": rng.sample("abcdefgh", rng.randint(0, 4)),
         "start_line": (s := rng.randint(1, 200)), "end_line": s + rng.randint(0, 9), "source_ids": [i], "embedding": [rng.random(), rng.random()]}
        for i in range(n)
    ]


def greedy(rows, lam):
    """Maximal marginal relevance as it is defined, in quadratic form."""
    low, high = min(r["score"] for r in rows), max(r["score"] for r in rows)
    rel = lambda r: 1.0 if high == low else (r["score"] - low) / (high - low)

    def alike(a, b):
        x, y = set(a["tokens"]), set(b["tokens"])
        lexical = len(x & y) / len(x | y) if x and y else 0
        return max(lexical, diversify.line_proximity(a, b), 0.35 * max(0, sum(p * q for p, q in zip(a["embedding"], b["embedding"]))))

    left, out = list(rows), []
    while left:
        best = max(left, key=lambda r: (lam * rel(r) - (1 - lam) * max((alike(r, o) for o in out), default=0), -r["rank"]))
        left.remove(best)
        out.append(best)
    return [r["id"] for r in out]


@pytest.mark.parametrize("diversity", ["balanced", "strong"])
def test_mmr(spark, diversity):
    rows = candidates(25, random.Random(5))
    df = spark.createDataFrame(rows, "query_id long, rank long, id long, kb_id string, file_path string, score double, tokens array<string>, start_line int, end_line int, source_ids array<long>, embedding array<double>")
    got = [r.id for r in diversify.mmr(df, diversity).orderBy("place").collect()]
    assert got == greedy(rows, diversify.LAMBDA[diversity])
    assert [r.place for r in diversify.mmr(df.filter("id < 2"), diversity).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("positions", [1, 3, 6])
def test_rows_out_of_reach_change_no_page(spark, positions):
    """Rows that can't come to a page are left out before their tokens are fetched; the page stays."""
    rng = random.Random(positions)
    rows = [{**r, "query_id": q} for q in range(6) for r in candidates(40, rng)]
    for r in rows:
        del r["embedding"]
        r["file_path"] = f"f{rng.randint(0, 30)}" if r["query_id"] % 2 else r["file_path"]
        r["score"] = rng.random() ** 4
    for q in range(6):
        for n, r in enumerate(sorted((r for r in rows if r["query_id"] == q), key=lambda r: -r["score"])):
            r["rank"] = n + 1
    df = spark.createDataFrame(rows, "query_id long, rank long, id long, kb_id string, file_path string, score double, tokens array<string>, start_line int, end_line int, source_ids array<long>")
    page = lambda x: sorted((r.query_id, r.position, r.id) for r in diversify.interleave(diversify.mmr(x, "balanced")).collect() if r.position <= positions)
    near = diversify.reachable(df, "balanced", positions)
    assert positions > 3 or near.count() < len(rows)  # with six positions and many rows a file all may be needed
    assert page(near) == page(df)


def test_line_proximity():
    at = lambda a, b, f="x": {"kb_id": "k", "file_path": f, "start_line": a, "end_line": b, "source_ids": [a]}
    p = diversify.line_proximity
    assert [p(at(1, 5), at(4, 9)), p(at(1, 5), at(20, 25)), p(at(1, 5), at(80, 90)), p(at(1, 5), at(200, 210)), p(at(1, 5), at(1, 5, "y"))] == [1.0, 0.8, 0.45, 0.2, 0.0]


def test_interleave(spark):
    rows = spark.createDataFrame([(1, i, "k", f, i + 1) for i, f in enumerate("aaabbc")] + [(2, 9, "k", "a", 1), (2, 8, "k", "b", 2)], "query_id long, id long, kb_id string, file_path string, place long")
    got = [(r.query_id, r.id) for r in diversify.interleave(rows).orderBy("query_id", "position").collect()]
    assert got == [(1, 0), (1, 3), (1, 5), (1, 1), (1, 4), (1, 2), (2, 9), (2, 8)]


def test_windows_and_collapse(spark):
    chunks = spark.createDataFrame([(i, "k", "f", i * 10 + 1, i * 10 + 9, f"part{i} alpha " + "z" * 2500 * (i == 2)) for i in range(20)] + [(50, "k", "g", 1, 9, "alpha")], "id long, kb_id string, file_path string, start_line int, end_line int, content string")
    seeds = spark.createDataFrame([(1, 1, 1, "k", "f", 11, 19, ["alpha"], 0.9), (1, 2, 2, "k", "f", 21, 29, ["alpha"], 0.8), (1, 3, 50, "k", "g", 1, 9, ["alpha"], 0.7)], "query_id long, rank long, id long, kb_id string, file_path string, start_line int, end_line int, signals array<string>, score double")
    got = {r.id: r for r in adaptive.windows(seeds, chunks).collect()}
    assert len(got[1].source_ids) == 5 and 1 in got[1].source_ids and 50 not in got[1].source_ids
    assert got[1].context.startswith("part0 alpha") and len(got[1].context) <= adaptive.MAX_CHARS
    assert got[1].source_ids == sorted(got[1].source_ids) and got[50].source_ids == [50]
    kept = [r.id for r in diversify.collapse(adaptive.windows(seeds, chunks)).orderBy("rank").collect()]
    assert kept == [1, 50]
