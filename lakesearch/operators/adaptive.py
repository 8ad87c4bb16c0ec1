"""Context windows around hits: neighbours of the same file within a line interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import coverage, signals, tokenize
from ..session import few

LINES, MAX_CHARS, NEIGHBOURS = 80, 6000, 5


def windows(seeds: DataFrame, chunks: DataFrame, lines: int = LINES, max_chars: int = MAX_CHARS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """seeds: (query_id, id, kb_id, file_path, start_line, end_line, signals, ...); chunks: (id, kb_id, file_path,
    start_line, end_line, content). Adds context, start/end of the window and source_ids to the seeds.

    seeds: a stored table. Only chunks of its files are split. The interval is a condition on top of an equi join by file; the neighbours are cut to the best five
    by a window before anything is collected, so a group has five texts at most.
    """
    files = seeds.select("kb_id", "file_path").distinct()
    near = chunks.join(few(files), ["kb_id", "file_path"], "left_semi").select(
        F.col("id").alias("n_id"), "kb_id", "file_path", F.col("start_line").alias("n_start"), F.col("end_line").alias("n_end"),
        F.col("content").alias("n_content"), signals(tokenize(F.col("content"))).alias("n_signals"),
    )
    seed = seeds.select("query_id", F.col("id").alias("seed"), "kb_id", "file_path", "start_line", "end_line", "signals")
    both = seed.join(near, ["kb_id", "file_path"]).filter(
        (F.col("n_end") >= F.greatest(F.lit(1), F.col("start_line") - lines)) & (F.col("n_start") <= F.col("end_line") + lines)
    )
    own = F.col("n_id") == F.col("seed")
    gap = F.when(own, F.lit(0)).otherwise(F.least(F.abs(F.col("n_start") - F.col("start_line")), F.abs(F.col("n_end") - F.col("end_line"))))
    scored = both.withColumn(
        "n_score", F.when(own, 2.0).otherwise(0.0) + 1.0 / (1.0 + gap / 20.0) + coverage(F.col("n_signals"), F.col("signals"))
    )
    w = Window.partitionBy("query_id", "seed")
    best = scored.withColumn("n_rank", F.row_number().over(w.orderBy(F.desc("n_score"), "n_id"))).filter(F.col("n_rank") <= neighbours)
    ordered = w.orderBy("n_start", "n_end", "n_id")
    used = F.coalesce(F.sum(F.length("n_content") + 2).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = best.withColumn("used", used).withColumn("at", F.row_number().over(ordered))
    open_ = F.col("used") < max_chars
    text = F.substring("n_content", F.lit(1), (max_chars - F.col("used")).cast("int"))
    out = parts.groupBy("query_id", "seed").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(open_, F.struct("at", text.alias("t"))))), lambda x: x.t), "\n\n").alias("context"),
        F.min("n_start").alias("window_start"), F.max("n_end").alias("window_end"),
        F.transform(F.array_sort(F.collect_list(F.when(open_, F.struct("at", "n_id")))), lambda x: x.n_id).alias("source_ids"),
    )
    return seeds.join(out.withColumnRenamed("seed", "id"), ["query_id", "id"])
