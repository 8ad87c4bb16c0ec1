"""Users' columns with the names that operators use inside: they stay, and nothing crashes. Long texts go whole."""

import pytest

from lakesearch.llm import chat_format, common, decontamination as dc, language_model as lm, minhash_dedup as mh, quality_rules as qr
from lakesearch.llm import sentencepiece_codec as sc, sharding as sh, toxicity as tx, url_filter as uf, warc

INSIDE = (
    "row", "nth", "leak", "made", "measures", "cuts", "stratum", "stratum_key", "cut_symbols", "id", "label", "n", "key", "component", "parts",
    "place", "a", "b", "h", "rank", "bucket", "digest", "payload", "url_keys", "url_best", "ts", "ps", "_n", "_row", "_both", "spans", "items",
)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "word " * 120_000, *(" ".join(f"word{i * 100 + k}" for k in range(80)) for i in range(12))]
    rows = [(i, t, "en" if i % 2 else None, "s", *INSIDE) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", *INSIDE)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in INSIDE))


def same(got, docs, more=()):
    """All of the users' columns have their values."""
    assert set(docs.columns) <= set(got.columns) and set(more) <= set(got.columns)
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in INSIDE)
    return rows


def test_operators_that_keep_columns(spark, docs):
    items = docs.selectExpr("doc_id item_id", "text", "'x' leak", "'y' block").filter("doc_id in (4, 6)")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic", "1 quality", "'z' id", "'z' label")
    n = docs.count()
    assert len(same(dc.scan(docs, items, out="found"), docs, ["found"])) == n
    assert dc.decontaminate(docs, items).columns == docs.columns
    assert len(same(sc.round_trip(docs), docs, ["ids", "decoded"])) == n
    assert len(same(sc.digests(docs), docs, ["coded"])) == n
    assert len(same(tx.classify(docs, labels, sample_rows=5, n_features=20), docs, ["score", "predicted", "held_out"])) == n
    measured = common.materialize(qr.measures(docs, out="measured"), "measured")
    assert len(same(qr.judge(measured, labels, measures="measured"), docs, ["kept", "base_failed"])) == n
    kept = same(mh.deduplicate(docs), docs)
    assert sum(r.doc_id == 5 for r in kept) <= 1 and {0, 1} <= {r.doc_id for r in kept}
    pages = docs.withColumnRenamed("source", "url")
    assert {r.verdict for r in uf.judge(pages).collect()} == {"allow"}


def test_operators_with_results_of_their_own(spark, docs):
    n = docs.count()
    assert mh.cluster(docs).count() == n == lm.learn_and_score(docs).count()
    assert sh.shard(docs, 4).count() == n
    pages = docs.selectExpr("doc_id page_id", "'http://a/' url", "text html", "'x' digest", "'y' payload", "'z' timestamp")
    assert warc.round_trip(pages).count() == n
    turns = docs.selectExpr("doc_id conv_id", "1 turn", "'user' role", "text", "'x' ts", "'y' ps", "'z' t", "'f' formatted")
    assert chat_format.format_conversations(turns).count() == docs.select("doc_id").distinct().count()


def test_ids_of_another_type(spark):
    with pytest.raises(TypeError):
        mh.cluster(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_pipeline_with_clashing_names(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    named = docs.withColumn("n_chars", docs.doc_id).selectExpr("*", "'kept' kept", "'score' score", "'predicted' predicted")
    named.write.parquet(f"{tmp_path}/documents.parquet")
    named.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for at in (str(tmp_path), f"{tmp_path}/empty"):
        spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "nothing like it " * 5)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    rows = same(pipeline.run(spark, str(tmp_path)), named, ["ids", "decoded"])
    assert rows and all(r.kept == "kept" and r.score == "score" and r.decoded == r.text for r in rows)
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0
