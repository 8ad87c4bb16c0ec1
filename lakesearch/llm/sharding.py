"""Operator 8: sharding by proportional stratified interleaving, with Spark expressions only.

Within each source the rows are shuffled by a seeded hash and ranked; the fractional rank
(rank - u) / n, with a seeded offset u of the source, spreads every source evenly over (0, 1). The rows
of all sources, sorted by it, are cut into shards of equal row counts: counts differ by one at most, and
each shard has its share of every source up to one row for each cut.

No window ever spans a source or the table. Ranks are made of two parts: rows are dealt by their hash
into buckets of about ``bucket_rows`` rows at most (``MIN_BUCKETS`` at least) and ranked there, and the bucket adds the number of rows
before it. The same is done over the fractional rank for the position in the whole. So a source with
most rows is as many tasks as its buckets.

Edge cases: a null source is a source; a null text has no bytes; ties and repeated rows have the same
keys and are told apart by their place alone, so the result as a set of rows is determined. An empty
table gives no rows. Extra columns aren't kept: join them by id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize

BUCKET_ROWS, MIN_BUCKETS = 100_000, 64
SIZE_OVERHEAD = 16
SPAN = 1 << 32


def _numbered(rows: DataFrame, group: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the rank from 0 by (value, order) within the group; value is a bucket number."""
    rows = materialize(rows, out)
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("_n"))
    # One row per bucket: the window runs over buckets, not rows.
    before = counts.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ).select(*(F.col(c).alias(f"_{c}") for c in [*group, value]), F.coalesce("_before", F.lit(0)).alias("_before"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, value]]
    near = F.row_number().over(Window.partitionBy(*group, value).orderBy(*order)) - 1
    return (
        rows.withColumn("_near", near).join(before, on).withColumn(out, F.col("_before") + F.col("_near"))
        .drop("_near", "_before", *(f"_{c}" for c in [*group, value]))
    )


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs: (doc_id, source, text). Returns (doc_id, source, size, text_crc32, shard, slot)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", "source",
        (F.octet_length(raw) + SIZE_OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
    )
    rows = materialize(rows, "shard_rows")
    total = rows.count()
    if not total:
        return rows.select("doc_id", "source", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    buckets = max(MIN_BUCKETS, math.ceil(total / bucket_rows))
    order = ["h", "doc_id", "text_crc32", "size"]
    dealt = rows.withColumn("bucket", (F.shiftright("h", 32) + SPAN // 2) * buckets / SPAN).withColumn("bucket", F.col("bucket").cast("long"))
    ranked = _numbered(dealt, ["source"], "bucket", order, "rank")
    sizes = rows.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n"))
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), "source"), F.lit(1 << 20)) / (1 << 20)
    spread = ranked.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "fraction", (F.col("rank") + offset) / F.col("n")
    ).withColumn("part", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("long"))
    placed = _numbered(spread.drop("_source", "bucket", "rank", "n"), [], "part", ["fraction", *order, "source"], "at")
    exact = F.expr(f"(at * {shards}) div {total}")
    begin = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", exact).withColumn("slot", F.col("at") - begin).select(
        "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot"
    )
