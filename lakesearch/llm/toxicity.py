"""Operator 9: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams (orders 3 to 6, A-Z lower-cased) of the whole text, hashed into
``BUCKETS``. Over a bounded, hash-ordered sample of labelled rows (``sample_rows`` of each class at
most) executors count, for each bucket, the documents of either class that hold it. The driver turns
the counts into smoothed log-count ratios, keeps the ``n_features`` buckets with the strongest ratio
against its standard error, and fits an L2-regularised logistic regression on the scaled indicators.
The intercept is moved from the sample's class shares to those of all labelled rows. Scoring is a
numpy pass over whole texts, in segments, so that memory doesn't depend on the length of a text.

Edge cases: null and empty texts have no features and get the score of the intercept. Rows with a null
label teach nothing. With one class only (or none) the score is the smoothed share of toxic labels.
Repeated rows get equal scores. Extra columns are kept; those named held_out, score or predicted are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold_of, materialize, release, small_batches

ORDERS = (3, 4, 5, 6)
BITS = 18
BUCKETS = 1 << BITS
SEGMENT = 1 << 19
#: Labelled rows of each class that the fit may use, and the features it keeps.
SAMPLE_ROWS, N_FEATURES = 4000, 4096
#: Tasks that count features of the sample; each sends its counts, 2 MB, to the driver.
COUNTERS = 8


@dataclass(frozen=True)
class Model:
    """slot: feature of each bucket or -1; weight: of each feature; bias: the intercept."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of some documents with padding between, and the document of every byte, or -1 where no n-gram begins."""
    parts, owners, size = [], [], 0
    pad = bytes(max(ORDERS) - 1)
    for d, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace").lower().replace(b"\x00", b" ")
        begin = 0
        while begin < len(raw):
            part = raw[begin : begin + SEGMENT + len(pad)]
            parts += [part, pad]
            last = begin + SEGMENT >= len(raw)  # else the next segment has the n-grams that begin beyond
            owners += [(d, len(part) if last else SEGMENT), (-1, len(pad) if last else len(part) - SEGMENT + len(pad))]
            size += len(part) + len(pad)
            begin += SEGMENT
            if size >= SEGMENT:
                yield _joined(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield _joined(parts, owners)


def _joined(parts: list[bytes], owners: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.repeat(*np.array(owners, np.int64).T)


def buckets(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the bucket of the n-gram that begins at each byte."""
    b = raw.astype(np.uint32) + np.uint32(1)
    h = b.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        if n in ORDERS:
            x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            yield n, (x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def features(texts: list[str | None], slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs; without slot the feature is the bucket."""
    found = []
    width = np.int64(BUCKETS)
    for raw, owner in segments(texts):
        for _, at in buckets(raw):
            real = owner[: len(at)] >= 0
            f = at if slot is None else slot[at]
            if slot is not None:
                real &= f >= 0
            found.append(np.unique(owner[: len(at)][real] * width + f[real]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.concatenate(found))
    return pairs // width, pairs % width


def sample(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """Up to sample_rows (id, label) rows of each class, in the order of a hash of the id."""
    h = F.xxhash64("id")
    return labelled.filter("label = 1").orderBy(h, "id").limit(sample_rows).unionByName(
        labelled.filter("label = 0").orderBy(h, "id").limit(sample_rows)
    )


def fit(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES) -> Model:
    """docs: (id, text); labelled: (id, label). Both bounds are in rows of each class and in features."""
    spark = docs.sparkSession
    labelled = labelled.filter("label in (0, 1) and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    share = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = share.get(1, 0), share.get(0, 0)
    prior = math.log((pos + 1) / (neg + 1))
    empty = Model(np.full(BUCKETS, -1, np.int32), np.zeros(1, np.float32), prior)
    if not pos or not neg:
        return empty
    # 2 * sample_rows rows of two numbers at most, so this side may be broadcast.
    picked = docs.select("id", "text").join(F.broadcast(sample(labelled, sample_rows)), "id")
    one_each = picked.groupBy("id", "label").agg(F.min("text").alias("text"))  # of a repeated id one text counts
    rows = materialize(one_each, "toxic_sample").repartition(max(1, min(COUNTERS, 2 * sample_rows // 1000)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, BUCKETS), np.int32)
        n = [0, 0]
        for b in batches:
            for y, text in zip(b["label"], b["text"]):
                seen[y, features([text])[1]] += 1  # the features of a text are distinct
                n[y] += 1
        yield pd.DataFrame({"n0": [n[0]], "n1": [n[1]], "seen": [seen.tobytes()]})

    parts = rows.mapInPandas(count, "n0 long, n1 long, seen binary").collect()  # COUNTERS rows of 2 MB at most
    n0, n1 = sum(p.n0 for p in parts), sum(p.n1 for p in parts)
    if not n0 or not n1:
        return empty
    q, p = sum(np.frombuffer(x.seen, np.int32).reshape(2, BUCKETS) for x in parts).astype(np.float64)
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    strength = np.abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (q + 1))
    strength[p + q < 2] = -1
    top = np.argsort(-strength, kind="stable")[:n_features]
    top = np.sort(top[strength[top] > 0])
    slot = np.full(BUCKETS, -1, np.int32)
    slot[top] = np.arange(len(top), dtype=np.int32)
    shared = spark.sparkContext.broadcast(slot)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d, f = features(list(b["text"]), shared.value)
            cut = np.searchsorted(d, np.arange(len(b) + 1))
            f = f.astype(np.int32)
            yield pd.DataFrame({"label": b["label"], "f": [f[i:j].tobytes() for i, j in zip(cut, cut[1:])]})

    got = rows.mapInPandas(gather, "label int, f binary").collect()  # bounded by the sample and the features
    release(rows)
    y = np.array([g.label for g in got], np.float64)
    each = [np.frombuffer(g.f, np.int32) for g in got]
    order = sorted(range(len(got)), key=lambda i: (y[i], each[i].tobytes()))  # the fit doesn't depend on task order
    y, each = y[order], [each[i] for i in order]
    weight, bias = logistic(each, y, ratio[top])
    shift = math.log(pos / neg) - math.log(n1 / n0)
    return Model(slot, (weight * ratio[top]).astype(np.float32), bias + shift)


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; row i holds scale[j] for each j in rows[i]."""
    n, at = len(rows), np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    value = scale[at]
    squares = np.bincount(owner, value * value, n)
    rate = 4.0 / (squares.mean() + 1)
    w, b = np.zeros(len(scale)), 0.0
    w1, b1 = w, b
    for k in range(steps):
        m = k / (k + 3)
        v, c = w + m * (w - w1), b + m * (b - b1)
        z = np.bincount(owner, value * v[at], n) + c
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        w1, b1 = w, b
        w = v - rate * (np.bincount(at, value * g[owner], len(scale)) / n + l2 * v)
        b = c - rate * g.mean()
    return w, float(b)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability that the whole text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def prob(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m: Model = shared.value
        for s in batches:
            z = np.zeros(len(s))
            if len(m.weight) and (m.slot >= 0).any():
                d, f = features(list(s), m.slot)
                z += np.bincount(d, m.weight[f], len(s))
            yield pd.Series(1 / (1 + np.exp(-np.clip(z + m.bias, -700, 700))))

    return docs.withColumn(out, prob(F.col(text)))


def train_fold(doc_id: str | Column = "doc_id") -> Column:
    """Rows that may teach: crc32 of the id as text, modulo 5, isn't 0."""
    return fold_of(F.col(doc_id) if isinstance(doc_id, str) else doc_id, 5) != 0


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Add held_out, score and predicted to docs (doc_id, text, ...), learning from labels (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    teach = labels.filter(train_fold()).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    model = fit(docs.select(F.col("doc_id").alias("id"), "text"), teach, **bounds)
    kept = docs.drop("held_out", "score", "predicted")
    return (
        score(kept, model)
        .withColumn("held_out", ~train_fold())
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
