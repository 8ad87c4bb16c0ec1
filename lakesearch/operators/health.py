"""Diagnostics of knowledge bases: stale and orphaned files, coverage, stuck jobs, health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STALE_MS = 10 * 60 * 1000
PENALTY = {"blocking": 35, "warning": 12, "info": 2}
LEAST_COVERAGE = 80


def latest_indexed(chunks: DataFrame) -> DataFrame:
    """chunks: (kb_id, file_path, indexed_at) -> newest time of each file."""
    return chunks.groupBy("kb_id", "file_path").agg(F.max("indexed_at").alias("indexed_at"))


def stale_files(indexed: DataFrame, files: DataFrame) -> DataFrame:
    return indexed.join(files, ["kb_id", "file_path"]).filter("mtime > indexed_at")


def orphan_files(indexed: DataFrame, files: DataFrame) -> DataFrame:
    return indexed.join(files.select("kb_id", "file_path"), ["kb_id", "file_path"], "left_anti")


def coverage(indexed: Column, current: Column) -> Column:
    """Per cent, half up; 100 without files, above 100 possible."""
    return F.when(current > 0, F.floor(100.0 * indexed / current + 0.5)).otherwise(F.lit(100)).cast("long")


def stuck(status: Column, job_status: Column, updated_at: Column, progress_at: Column, now: Column, limit: int = STALE_MS) -> Column:
    age = F.when(job_status == "running", now - progress_at).otherwise(now - updated_at)
    return (status == "indexing") & (age > limit)


def diagnose(kbs: DataFrame, chunks: DataFrame, files: DataFrame, skipped: DataFrame, jobs: DataFrame, now: int, limit: int = STALE_MS) -> DataFrame:
    """A row per knowledge base; every side is aggregated by base before it is joined."""
    indexed = latest_indexed(chunks)
    count = lambda df, name: df.groupBy("kb_id").agg(F.count("*").alias(name))
    out = kbs.join(jobs.select("kb_id", F.col("status").alias("job_status"), "phase", "last_progress_at"), "kb_id", "left")
    for side in (count(stale_files(indexed, files), "stale"), count(orphan_files(indexed, files), "orphans"), count(files, "current"), count(indexed, "indexed"), count(skipped, "skipped")):
        out = out.join(side, "kb_id", "left")
    out = out.na.fill(0, ["stale", "orphans", "current", "indexed", "skipped"])
    return out.withColumn("coverage_percent", coverage(F.col("indexed"), F.col("current"))).withColumn(
        "stuck", F.coalesce(stuck(F.col("status"), F.col("job_status"), F.col("updated_at"), F.col("last_progress_at"), F.lit(now), limit), F.lit(False))
    )


def issues(diagnosed: DataFrame) -> DataFrame:
    """(kb_id, severity, kind, message), a row an issue."""
    made = [
        (F.col("stuck"), "blocking", "stuck", F.lit("Indexing appears stuck.")),
        (F.col("status") == "error", "blocking", "error", F.lit("The knowledge base is in an error state.")),
        (F.col("coverage_percent") < LEAST_COVERAGE, "warning", "coverage", F.format_string("Coverage is %d%% (%d/%d files).", "coverage_percent", "indexed", "current")),
        (F.col("stale") > 0, "warning", "stale", F.format_string("%d files changed after indexing.", "stale")),
        (F.col("orphans") > 0, "warning", "orphans", F.format_string("%d indexed files no longer exist.", "orphans")),
        (F.col("skipped") > 0, "info", "skipped", F.format_string("%d files were skipped.", "skipped")),
    ]
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), m.alias("message"))) for c, s, k, m in made)), lambda x: x.isNotNull())
    return diagnosed.select("kb_id", F.explode(found).alias("i")).select("kb_id", "i.*")


def health_score(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """health_score from 0 to 100 and the number of issues by severity: one row, or one for each group that has issues."""
    n = {x: F.count_if(F.col("severity") == x) for x in PENALTY}
    penalty = sum((n[x] * p for x, p in PENALTY.items()), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("long").alias("health_score")
    return found.groupBy(*by).agg(score, *(c.alias(x) for x, c in n.items()))
