"""Diversity: greedy maximal marginal relevance, file interleaving, collapse of overlapping windows.

The greedy steps depend on their order, so they run in numpy for one query at a time; a query has no more
candidates than the candidate limit allows. Interleaving is windows only.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .fusion import min_max

LAMBDA = {"balanced": 0.76, "strong": 0.62}
VECTOR_WEIGHT = 0.35


def line_proximity(a: dict, b: dict) -> float:
    if a["file_path"] != b["file_path"] or a["kb_id"] != b["kb_id"]:
        return 0.0
    if set(a["source_ids"]) & set(b["source_ids"]) or min(a["end_line"], b["end_line"]) >= max(a["start_line"], b["start_line"]):
        return 1.0
    gap = max(a["start_line"], b["start_line"]) - min(a["end_line"], b["end_line"])
    return 0.8 if gap <= 20 else 0.45 if gap <= 80 else 0.2


def mmr_order(rows: list[dict], diversity: str) -> list[int]:
    """Positions in the order of selection; rows come in rank order."""
    if diversity == "off" or len(rows) <= 2:
        return list(range(len(rows)))
    lam = LAMBDA[diversity]
    score = np.array([r["score"] for r in rows])
    span = score.max() - score.min()
    relevance = np.ones(len(rows)) if span == 0 else (score - score.min()) / span
    if "relevance" in rows[0]:  # of more rows than these
        relevance = np.array([r["relevance"] for r in rows])
    held, sizes = _incidence([r["tokens"] for r in rows])
    vectors = _matrices([r.get("embedding") for r in rows])
    files: dict[tuple, list[int]] = {}
    for i, r in enumerate(rows):
        files.setdefault((r["kb_id"], r["file_path"]), []).append(i)
    redundancy, open_, out = np.zeros(len(rows)), np.ones(len(rows), bool), []
    for _ in rows:
        gain = np.where(open_, lam * relevance - (1 - lam) * redundancy, -np.inf)
        best = int(gain.argmax())  # the first of equal ones
        open_[best] = False
        out.append(best)
        both = held @ held[best]
        union = sizes + sizes[best] - both
        redundancy = np.maximum(redundancy, np.divide(both, union, out=np.zeros(len(rows)), where=(both > 0)))
        for i in files[rows[best]["kb_id"], rows[best]["file_path"]]:
            redundancy[i] = max(redundancy[i], line_proximity(rows[i], rows[best]))
        for at, matrix in vectors:
            mine = np.flatnonzero(at == best)
            if len(mine):
                cosine = (matrix * matrix[mine[0]]).sum(1)
                redundancy[at] = np.maximum(redundancy[at], VECTOR_WEIGHT * np.maximum(0.0, cosine))
    return out


def _incidence(tokens: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows x tokens of at least two rows, distinct tokens of each row); a product of rows counts what they share."""
    sets = [set(t) for t in tokens]
    seen = Counter(t for s in sets for t in s)
    at = {t: i for i, t in enumerate(t for t, n in seen.items() if n > 1)}
    held = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        held[i, [at[t] for t in s if t in at]] = 1
    return held, np.array([len(s) for s in sets], float)


def _matrices(vectors: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each length the rows that have a vector, and these."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None:
            by.setdefault(len(v), []).append(i)
    return [(np.array(at), np.array([vectors[i] for i in at], float)) for at in by.values()]


def mmr(ranked: DataFrame, diversity: str = "balanced") -> DataFrame:
    """ranked: (query_id, rank, id, score, tokens, file_path, kb_id, start_line, end_line, source_ids[, embedding]).

    Adds ``place``, from 1."""
    return ranked.join(places(ranked, diversity), ["query_id", "id"])


def places(ranked: DataFrame, diversity: str = "balanced") -> DataFrame:
    """(query_id, id, place) of the rows of ``mmr``."""

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        order = mmr_order(rows.to_dict("records"), diversity)
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(1, len(rows) + 1)
        return pd.DataFrame({"query_id": rows["query_id"], "id": rows["id"], "place": place})

    slim = [c for c in ("query_id", "rank", "id", "score", "tokens", "file_path", "kb_id", "start_line", "end_line", "source_ids", "embedding", "relevance") if c in ranked.columns]
    return ranked.select(slim).groupBy("query_id").applyInPandas(select, "query_id long, id long, place long")


def reachable(ranked: DataFrame, diversity: str, positions: int) -> DataFrame:
    """Of ranked (query_id, rank, score, kb_id, file_path) the rows that can come to one of the first ``positions``, with
    their ``relevance`` among all; the others change no place before.

    With c rows of a file at most, the first m = (positions - 1) * c + 1 places hold as many files as positions. While
    they are given, a row of the m best is open; its gain is that of the m-th less the whole weight of redundancy at
    the worst, so a row with less relevance than that isn't chosen. Redundancy has to be 1 at most, as it is without vectors.
    """
    w, lam = Window.partitionBy("query_id"), LAMBDA[diversity]
    rows = ranked.withColumn("relevance", min_max(F.col("score"), ("query_id",)))
    rows = rows.withColumn("_same", F.count("*").over(Window.partitionBy("query_id", "kb_id", "file_path")))
    rows = rows.withColumn("_m", (positions - 1) * F.max("_same").over(w) + 1)
    rows = rows.withColumn("_bar", F.max(F.when(F.col("rank") == F.col("_m"), F.col("relevance"))).over(w))
    least = F.col("_bar") - F.lit((1 - lam) / lam + 1e-9)
    return rows.filter(F.col("_bar").isNull() | (F.col("relevance") >= least)).drop("_same", "_m", "_bar")


def interleave(placed: DataFrame, place: str = "place", out: str = "position") -> DataFrame:
    """Round-robin over files in the order in which they first appear; two rows or fewer, or one file, stay."""
    file = ["query_id", "kb_id", "file_path"]
    in_file, in_query = Window.partitionBy(*file), Window.partitionBy("query_id")
    turn = F.row_number().over(in_file.orderBy(place))
    first = F.min(place).over(in_file)
    rows = placed.withColumn("_turn", turn).withColumn("_first", first)
    few = F.count("*").over(in_query) <= 2
    order = F.row_number().over(in_query.orderBy("_turn", "_first"))
    kept = F.row_number().over(in_query.orderBy(place))
    return rows.withColumn(out, order).withColumn("_kept", kept).withColumn("_few", few).withColumn(
        out, F.when(F.col("_few"), F.col("_kept")).otherwise(F.col(out))
    ).drop("_turn", "_first", "_kept", "_few")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with equal keys the first one's (key, order); pre-aggregated, so that copies share no task."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def numbered(rows: DataFrame, *order, out: str = "place") -> DataFrame:
    """Number rows from 1 in a total order, without one task for all: ranges of the order are sorted by themselves
    and begin after the rows of the ranges before."""
    placed = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = sizes.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        out, (F.col("_before") + inside + 1).cast("long")
    ).drop("_at", "_part", "_before")


def collapse(windows: DataFrame) -> DataFrame:
    """windows: (query_id, rank, id, kb_id, file_path, score, source_ids). Keeps one of the windows of a file
    that share a chunk: the later one replaces the first it overlaps if its score or its number of chunks is larger."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in rows.sort_values("rank").to_dict("records"):
            at = next((i for i, x in enumerate(kept) if (x["kb_id"], x["file_path"]) == (r["kb_id"], r["file_path"]) and set(x["source_ids"]) & set(r["source_ids"])), None)
            if at is None:
                kept.append(r)
            elif r["score"] > kept[at]["score"] or len(r["source_ids"]) > len(kept[at]["source_ids"]):
                kept[at] = r
        return pd.DataFrame({"query_id": [r["query_id"] for r in kept], "id": [r["id"] for r in kept], "rank": range(1, len(kept) + 1)})

    slim = windows.select("query_id", "rank", "id", "kb_id", "file_path", "score", "source_ids")
    kept = slim.groupBy("query_id").applyInPandas(fold, "query_id long, id long, rank long")
    return windows.drop("rank").join(kept, ["query_id", "id"])
