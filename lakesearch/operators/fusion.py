"""Fusion of result lists: min-max normalisation, weighted sum, reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WEIGHTS = (0.45, 0.55, 0.15)
RRF_K = 60


def min_max(score: Column, by: tuple[str, ...]) -> Column:
    """(score - min) / (max - min) in the group; 1 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def weighted(lexical: DataFrame, vector: DataFrame, by: tuple[str, ...] = ("query_id", "kb_id"), weights=WEIGHTS) -> DataFrame:
    """Full outer join of two lists (by, id, score); an overlap bonus where both normalised scores are above 0."""
    a = lexical.select(*by, "id", min_max(F.col("score"), by).alias("lex"))
    b = vector.select(*by, "id", min_max(F.col("score"), by).alias("vec"))
    lex, vec = F.coalesce("lex", F.lit(0.0)), F.coalesce("vec", F.lit(0.0))
    bonus = F.when((lex > 0) & (vec > 0), F.lit(weights[2])).otherwise(F.lit(0.0))
    return a.join(b, [*by, "id"], "full_outer").select(*by, "id", (weights[0] * lex + weights[1] * vec + bonus).alias("score"))


def reciprocal_rank(lists: DataFrame, by: tuple[str, ...] = ("query_id",), k: int = RRF_K) -> DataFrame:
    """lists: (by, list, id, score); the sum of 1 / (k + rank) over the lists."""
    w = Window.partitionBy(*by, "list").orderBy(F.desc("score"), "id")
    ranked = lists.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy(*by, "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
