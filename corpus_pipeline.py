"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

1. toxicity: documents that the classifier of operator 9 predicts toxic go; it learns from ``labels``.
2. quality: documents that the rules of operator 6 reject go; cutoffs come from ``labels``.
3. near_dedup: of each group of near-duplicates (operator 10, five-word shingles, similarity 0.8) the
   document with the smallest id stays.
4. decontamination: documents with several benchmark items, or mostly made of them, go; spans of the
   others are cut out of the text (operator 1).
5. sentencepiece: the ids of every whole text, and the text they decode to (operator 4).

All but the last return the columns of ``documents``, whatever they are named; the last adds ``ids`` and
``decoded``. n_chars is kept as it was read unless a stage changes the text.

Edge cases: an empty table gives an empty one at every stage. A null or empty text isn't toxic by itself but
fails the base rule of stage 2. Repeated rows are judged alike until stage 3 keeps one of them. A null id is
kept by stage 3, a null language is a stratum of its own. Texts are handled whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakesearch.llm import decontamination, minhash_dedup, quality_rules, sentencepiece_codec, toxicity
from lakesearch.llm.common import kept, materialize, passing, release, spare, table


def whole(docs: DataFrame) -> Column:
    """The row as one struct, so that no column of a stage can clash with one of the table."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = toxicity.classify(docs.select("doc_id", "text", whole(docs)), table(spark, sf_dir, "labels"))
    return judged.filter("predicted = 0").select("row.*")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    measured = quality_rules.measures(docs.select("doc_id", "lang", "text", whole(docs))).drop("text")
    judged = quality_rules.judge(materialize(measured, "measured"), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leak = spare(docs, "leak")
    clean = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), out=leak)
    changed = F.col(leak)["n_hit"] > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_rules", reject_low_quality),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Models, hashes and certified thresholds take part; SQL can't express the stages. tests/llm holds each
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with passing(spark):  # a stage's own tables go once its result is written
            before, docs = docs, kept(materialize(stage(spark, docs, sf_dir), name))
        release(before)
    return docs
