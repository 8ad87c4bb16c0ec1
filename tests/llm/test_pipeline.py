"""The stages together: each one's decisions hold for what the one before kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lakesearch.llm import decontamination, sentencepiece_codec as sc  # noqa: E402


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(8)
    vocab = [f"term{i}" for i in range(900)]
    prose = lambda n=90: " ".join(rng.choices(vocab, k=n))
    passage = prose(30)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, prose() + (" vile numbskull words" * 2 if toxic else ""), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    base = prose()
    rows += [(1000, base, "en", "s", 0), (1001, base, "en", "s", 0), (1002, base + " more", "en", "s", 0), (1003, "too short", "en", "s", 0), (1004, None, "en", "s", 0)]
    rows += [(1005, prose() + " " + passage, "en", "s", 0), (1006, passage + " " + prose(50) + " " + passage[:200], "de", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "nothing of this stands anywhere in the texts above")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "sentencepiece":
            assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    clean = {i for i in range(400) if i % 5}
    assert kept[0] & set(range(400)) == clean
    assert kept[1] == clean | {1000, 1001, 1002, 1005, 1006}
    assert kept[2] == clean | {1000, 1005, 1006}
    assert kept[3] == clean | {1000, 1005} == kept[4]  # most of 1006 is benchmark text
    texts = {r.doc_id: r for r in docs.collect()}
    items = [("1", decontamination.alnum_words(passage))]
    automaton = decontamination.SuffixAutomaton(items)
    assert all(not automaton.scan(decontamination.alnum_words(r.text))[1] for r in texts.values())
    codec = sc.codec(sc.public_model())
    assert all(list(r.ids) == codec.encode(r.text) and r.decoded == r.text for r in texts.values())
    final = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == kept[4]
