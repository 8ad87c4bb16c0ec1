"""Incremental maintenance: multiset matching of old and new chunks by identity hash, snapshot diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def match(old: DataFrame, new: DataFrame, key: str = "content_hash", order: str = "ord", by: tuple[str, ...] = ("kb_id",)) -> DataFrame:
    """The k-th old row of a hash meets the k-th new one. Adds ``change``: unchanged, added or removed, with
    the columns of the old rows under ``old_`` names."""
    w = Window.partitionBy(*by, key).orderBy(order)
    a = old.withColumn("_k", F.row_number().over(w)).select(*by, key, "_k", F.struct(*old.columns).alias("old"))
    b = new.withColumn("_k", F.row_number().over(w)).select(*by, key, "_k", F.struct(*new.columns).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("unchanged")
    return a.join(b, [*by, key, "_k"], "full_outer").withColumn("change", change)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value differs, with change added, removed or changed."""
    a, b = before.select(*keys, F.col(value).alias("was"), F.lit(1).alias("_a")), after.select(*keys, F.col(value).alias("now"), F.lit(1).alias("_b"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.withColumn("change", change).filter("change is not null").select(*keys, "was", "now", "change")
