"""Exact vector search: a stated set of queries, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .bm25 import top

#: Queries in one broadcast matrix (4096 * 1024 * 4 bytes at most for 1024 dimensions).
QUERY_BLOCK = 4096
#: Rows that are multiplied with a block of queries at once: 8 MB of scores.
TILE = 256


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def search(rows: DataFrame, queries: DataFrame, k: int, by_kb: bool = False, digits: int | None = None) -> DataFrame:
    """rows: (id, kb_id, embedding); queries: (query_id, vector). Returns (query_id, id, kb_id, score, rank).

    Every partition keeps its own k best rows for each query (and base), so that what is shuffled is
    bounded by partitions * queries * k. Rows whose dimension differs from the query's are no hits. Queries without
    a vector have none. digits: round scores before they are compared.
    """
    spark, found = rows.sparkSession, None
    for ids, matrix in _blocks(queries.filter("vector is not null")):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            kept: dict[object, Best] = {}
            for b in batches:
                b = b[[x is not None and len(x) == matrix.shape[1] for x in b["embedding"]]]
                for kb, part in b.groupby("kb_id", dropna=False) if by_kb else [(None, b)]:
                    for at in range(0, len(part), TILE):
                        tile = part.iloc[at : at + TILE]
                        scores = matrix @ np.stack(tile["embedding"]).astype(np.float64).T
                        scores = scores if digits is None else scores.round(digits)
                        kept.setdefault(kb, Best(len(ids), k)).add(scores, tile["id"].to_numpy(np.int64))
            for kb, x in kept.items():
                n = x.score.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(ids, n), "id": x.id.ravel(), "kb_id": kb, "score": x.score.ravel()})

        kb_type = rows.schema["kb_id"].dataType.simpleString() if by_kb else "string"
        part = rows.select("id", "kb_id", "embedding").mapInPandas(best, f"query_id long, id long, kb_id {kb_type}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select(F.col("id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), "kb_id", F.lit(0.0).alias("score")).limit(0)
    return top(found, k, ("query_id", "kb_id") if by_kb else ("query_id",))


class Best:
    """The k best (score, id) of each query so far; equal scores go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.empty((queries, 0)), np.empty((queries, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        score = np.hstack([self.score, scores])
        at = np.hstack([self.id, np.broadcast_to(ids, scores.shape)])
        if score.shape[1] > self.k:
            # Rows above the k-th score are in; those equal to it compete by id.
            bar = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            order = np.lexsort((at, -np.where(score >= bar, score, -np.inf)), axis=1)[:, : self.k] if self._tied(score, bar) else np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
            score, at = np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)
        self.score, self.id = score, at

    def _tied(self, score: np.ndarray, bar: np.ndarray) -> bool:
        return bool(((score >= bar).sum(1) != self.k).any())


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.select("query_id", "vector").toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.vector)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)
