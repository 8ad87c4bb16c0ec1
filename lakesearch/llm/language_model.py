"""Operator 2: language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Vocabulary. Executors count the tokens of all training texts. There are 512 classes, and twice as many for
each 256-fold of 2^16 training tokens: 1,024 from 2^24 tokens on, 2,048 from 2^32, 4,096 from 2^40. Of these,
three quarters are the most frequent tokens; every other token, seen or not, belongs to one of the rest, the
bins, by its last two bytes. So the classes cover all tokens at every size of the corpus and grow with it:

    P(token | h) = P(class | h) * P(token | class),   P(token | class) = (c + 1) / (N_b + V_b + 1) in a bin b

with c, N_b and V_b counted over all training texts; the one spare unit is for unseen tokens, as in the
base. Sums over the known tokens and one unseen token are 1.

Model. With the classes a, b of the two tokens before (a begin class at the start), the prediction is
q = C1 * r[a] + C2 * r[b], and class w has the score q . R[w] + bias[w]. Training is one pass over all
training texts, whose classes are written once and dealt into shards of about ``SHARD`` tokens, however
the texts are partitioned. A turn trains some shards side by side from the model and AdaGrad state of the
turn before (batches with shared noise classes, unigram noise-contrastive estimation) and averages both
by tokens. About as many turns follow each other as shards run in one, and more beyond ``ABREAST`` shards
a turn, so the steps in a row grow with the training tokens.

Scoring. The score is a sum over the two context places, so two matrix products of all classes give
tables M1 and M2, and one product of their exponentials gives the exact normaliser of all pairs of
contexts. A token's normalised log-probability is then four look-ups.

Counts of tokens outside the ``TOP`` most frequent are not broadcast: texts meet them in an equi join on
the token, after an aggregation within each text.

Edge cases: a null or empty text is its end token. Without training texts all counts are zero and the
model is uniform over its classes. Repeated rows are scored alike (and all teach). A null id is the
empty text for the fold. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold_of, materialize, release, scratch, small_batches, space_words

END = b""
TOP = 32_768
#: Classes: begin, the frequent tokens (the end token among them), the bins.
BEGIN, LEAST_CLASSES = 0, 512
WIDTH, NOISE, BATCH, RATE = 24, 24, 4096, 0.15
FLUSH = 100_000
#: Parameters of so many partitions are added up in one task; the driver gets COLLECT sums at most.
FAN_IN, COLLECT = 32, 64
#: Training tokens of a shard, and the most shards of a turn.
SHARD, ABREAST = 4_000_000, 64


def classes_for(tokens: int) -> int:
    """The number of classes for so many training tokens."""
    classes = LEAST_CLASSES
    while tokens >= 1 << 24:
        classes, tokens = 2 * classes, tokens >> 8
    return classes


def first_bin(classes: int) -> int:
    return 1 + classes * 3 // 4


def bin_of(token: bytes, classes: int) -> int:
    """The bin of a token without a class of its own: a function of its last two bytes and its length class."""
    a, b = token[-2:-1] or b"\x00", token[-1:] or b"\x00"
    first = first_bin(classes)
    return first + (a[0] * 31 + b[0] * 131 + (len(token) > 9) * 61) % (classes - first)


def train_fold(col="doc_id"):
    return fold_of(F.col(col), 7) != 2


@dataclass
class Vocabulary:
    """token -> (class, log10(c + 1)) of the TOP tokens; counts of bins and of all tokens."""

    known: dict[bytes, tuple[int, float]]
    total: int
    distinct: int
    class_counts: np.ndarray
    bin_log: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.class_counts)


def count_tokens(texts: DataFrame) -> DataFrame:
    """texts: (text). Returns (token binary, c), counted in the partitions before the shuffle."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for x in b["text"]:
                counts.update(space_words(x))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield from _frames(counts)
                    counts = Counter()
        yield from _frames(counts)

    return texts.mapInPandas(partial, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _frames(counts: Counter[bytes]) -> Iterator[pd.DataFrame]:
    tokens, n = list(counts.keys()), list(counts.values())
    for i in range(0, len(tokens), 20_000):
        yield pd.DataFrame({"token": tokens[i : i + 20_000], "c": n[i : i + 20_000]})


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the written counts: TOP rows and one row of sums per class come to the driver."""
    size = classes_for(counts.agg(F.sum("c")).first()[0] or 0)
    bins = first_bin(size)
    top = [(bytes(r.token), r.c) for r in counts.orderBy(F.desc("c"), "token").limit(TOP).collect()]
    single = [t for t, _ in top[: bins - 1]]
    if END not in single and top:
        single = [*single[: bins - 2], END]  # the end is always a class of its own
    classes = {t: 1 + i for i, t in enumerate(single)}

    @F.pandas_udf("int")
    def class_of(tokens: pd.Series) -> pd.Series:
        return pd.Series([classes.get(bytes(t), None) or bin_of(bytes(t), size) for t in tokens], dtype="int32")

    sums = counts.groupBy(class_of("token").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in sums:
        n[r.k], v[r.k] = r.n, r.v
    known = {t: (classes.get(t) or bin_of(t, size), math.log10(c + 1)) for t, c in top}
    if END not in known:  # no training text
        known[END] = (bins - 1, 0.0)
    log = np.zeros(size)
    log[bins:] = np.log10(n[bins:] + v[bins:] + 1)
    return Vocabulary(known, int(n.sum()), int(v.sum()), n, log)


def classes_of(texts: list[str | None], known: dict[bytes, tuple[int, float]], classes: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Classes of all tokens of the texts with each text's begin twice before it, and each text's token count."""
    out: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    tokens: list[bytes] = []
    get = known.get
    for i, x in enumerate(texts):
        words = space_words(x)
        words.append(END)
        sizes[i] = len(words)
        out += (BEGIN, BEGIN)
        out += [e[0] if (e := get(w)) is not None else bin_of(w, classes) for w in words]
        tokens += words
    return np.array(out, np.int32), sizes, tokens


def contexts(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(second last, last, target) of every token."""
    keep = np.ones(len(flat), bool)
    begin = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    keep[begin] = keep[begin + 1] = False
    at = np.flatnonzero(keep)
    return flat[at - 2], flat[at - 1], flat[at]


@dataclass
class LogBilinear:
    r: np.ndarray  # representations of context classes
    out: np.ndarray  # of predicted classes
    c: np.ndarray  # (2, WIDTH) context weights
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.out, self.c, self.bias]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """M1, M2 (context class, class) and logZ (context, context), natural logarithms."""
        m1 = (self.r * self.c[0]) @ self.out.T
        m2 = (self.r * self.c[1]) @ self.out.T + self.bias
        m1[:, BEGIN] = m2[:, BEGIN] = -60.0  # nothing predicts a begin
        a, b = m1.max(1, keepdims=True), m2.max(1, keepdims=True)
        z = np.exp(m1 - a) @ np.exp(m2 - b).T
        return m1, m2, np.log(z) + a + b.T


def initial(class_counts: np.ndarray, seed: int = 11) -> LogBilinear:
    """Small random representations; with a zero output the model is the unigram distribution."""
    rng = np.random.default_rng(seed)
    p = (class_counts + 1) / (class_counts + 1).sum()
    size = len(class_counts)
    r = rng.normal(0, 0.3, (size, WIDTH)).astype(np.float32)
    return LogBilinear(r, np.zeros((size, WIDTH), np.float32), np.ones((2, WIDTH), np.float32), np.log(p).astype(np.float32))


def fresh(model: LogBilinear) -> list[np.ndarray]:
    """AdaGrad's state before the first step."""
    return [np.full(x.shape, 1e-2, np.float32) for x in model.parts()]


class Trainer:
    """AdaGrad on the noise-contrastive objective; NOISE noise classes are shared by a batch."""

    def __init__(self, model: LogBilinear, class_counts: np.ndarray, seed: int | list[int], state: list[np.ndarray] | None = None):
        self.m = LogBilinear(*(x.copy() for x in model.parts()))
        p = (class_counts + 1) / (class_counts + 1).sum()
        self.log_kp = np.log(NOISE * p).astype(np.float32)
        self.cdf = np.cumsum(p)
        self.rng = np.random.default_rng(seed)
        self.h = [x.copy() for x in state or fresh(model)]

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        ra, rb = m.r[a], m.r[b]
        q = ra * m.c[0] + rb * m.c[1]
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), len(self.cdf) - 1)
        s_w = np.einsum("ij,ij->i", q, m.out[w]) + m.bias[w] - self.log_kp[w]
        s_n = q @ m.out[noise].T + (m.bias - self.log_kp)[noise]
        g_w = 1 / (1 + np.exp(-s_w)) - 1  # d loss / d score of the data
        g_n = 1 / (1 + np.exp(-s_n))  # and of the noise
        dq = g_w[:, None] * m.out[w] + g_n @ m.out[noise]
        d_out, d_bias, d_r = np.zeros_like(m.out), np.zeros_like(m.bias), np.zeros_like(m.r)
        _add(d_out, w, g_w[:, None] * q)
        np.add.at(d_out, noise, g_n.T @ q)
        d_bias += np.bincount(w, g_w, len(self.cdf)).astype(np.float32)
        np.add.at(d_bias, noise, g_n.sum(0))
        _add(d_r, a, dq * m.c[0])
        _add(d_r, b, dq * m.c[1])
        d_c = np.stack([(dq * ra).sum(0), (dq * rb).sum(0)])
        for x, d, h in zip(m.parts(), (d_r, d_out, d_c, d_bias), self.h):
            d /= n
            h += d * d
            x -= RATE * d / np.sqrt(h)


def _add(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Sum rows by class."""
    order = np.argsort(at, kind="stable")
    k = at[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    to[k[first]] += np.add.reduceat(rows[order], first, 0)


def encode(texts: DataFrame, vocab: Vocabulary, shards: int, turns: int) -> DataFrame:
    """Write the classes of all texts in slices of a megabyte of text: (shard, part, at, codes), by turn."""
    spark = texts.sparkSession
    classes = vocab.classes
    known = spark.sparkContext.broadcast({t: e for t, e in vocab.known.items() if e[0] < first_bin(classes)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0

        def row(slice_: list[str | None]) -> pd.DataFrame:
            codes = classes_of(slice_, known.value, classes)[0].astype(np.uint16).tobytes()
            shard = zlib.crc32(f"{part}:{at}".encode()) % shards
            return pd.DataFrame({"turn": [shard % turns], "shard": [shard], "part": [part], "at": [at], "codes": [codes]})

        kept: list[str | None] = []
        size = 0
        for b in batches:
            for x in b["text"]:
                kept.append(x)
                size += len(x or "") + 1
                if size >= 1 << 20:
                    yield row(kept)
                    kept, size, at = [], 0, at + 1
        if kept:
            yield row(kept)

    schema = "turn int, shard int, part int, at int, codes binary"
    path = scratch(spark, "lm_codes")
    texts.mapInPandas(run, schema).repartition(shards, "shard").write.partitionBy("turn").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.lakesearch_path = path
    return out


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = 1) -> LogBilinear:
    """Rounds over all texts, each in turns; a shard returns its parameters and AdaGrad state (about 800 kB)."""
    model = initial(vocab.class_counts)
    sc = texts.sparkSession.sparkContext
    names = ["r", "out", "c", "bias", "h_r", "h_out", "h_c", "h_bias"]
    shards = math.ceil(vocab.total / SHARD)
    if not shards:
        return model
    turns = math.ceil(shards / min(ABREAST, math.ceil(math.sqrt(shards))))
    codes = encode(texts, vocab, shards, turns)
    state, counts = fresh(model), vocab.class_counts
    for nth in range(rounds * turns):
        start = sc.broadcast((model, state))

        def run(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
            trainer = Trainer(start.value[0], counts, [1 + nth, key[0]], start.value[1])
            rows, seen = rows.sort_values(["part", "at"]), 0
            for x in rows["codes"]:
                flat = np.frombuffer(x, np.uint16).astype(np.int32)
                at = np.flatnonzero(flat != BEGIN)  # no token is of the begin class
                a, c, w = flat[at - 2], flat[at - 1], flat[at]
                for k in range(0, len(w), BATCH):
                    trainer.step(a[k : k + BATCH], c[k : k + BATCH], w[k : k + BATCH])
                seen += len(w)
            row = {"slot": [key[0] // turns // FAN_IN], "seen": [float(seen)]}
            found = zip(names, [*trainer.m.parts(), *trainer.h])
            return pd.DataFrame(row | {n: [(x.astype(np.float64) * seen).tobytes()] for n, x in found})

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            row = {"slot": [rows["slot"].iloc[0]], "seen": [rows["seen"].sum()]}
            return pd.DataFrame(row | {n: [sum(np.frombuffer(x) for x in rows[n]).tobytes()] for n in names})

        schema = "slot int, seen double, " + ", ".join(f"{n} binary" for n in names)
        left = math.ceil(shards / turns)
        # So many partitions by number, as small ones by size would be merged into one task.
        own = codes.filter(F.col("turn") == nth % turns).drop("turn").repartition(left, "shard")
        sums = own.groupBy("shard").applyInPandas(run, schema)
        sums, left = sums.groupBy("slot").applyInPandas(add, schema), math.ceil(left / FAN_IN)
        while left > COLLECT:
            sums = sums.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("int")).groupBy("slot").applyInPandas(add, schema)
            left = math.ceil(left / FAN_IN)
        parts = sums.collect()  # COLLECT rows at most
        start.unpersist()
        seen = sum(p.seen for p in parts)
        if not seen:
            continue
        shapes = [x.shape for x in [*model.parts(), *state]]
        parts.sort(key=lambda p: p.slot)
        mean = [(sum(np.frombuffer(p[n]) for p in parts) / seen).reshape(s).astype(np.float32) for n, s in zip(names, shapes)]
        model, state = LogBilinear(*mean[:4]), mean[4:]
    release(codes)
    return model


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """docs: (doc_id, text). Adds held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    tables = [x.astype(np.float32) for x in model.tables()]
    # Where nothing was learned, the end is no known token either.
    shared = sc.broadcast((vocab.known if vocab.distinct else {}, tables, vocab.bin_log))
    ln10, classes, bins = math.log(10), vocab.classes, first_bin(vocab.classes)

    schema = (
        "doc_id long, held_out boolean, row long, n_tokens long, n_known long, common double, model double, "
        "rare array<binary>, rare_n array<long>"
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (m1, m2, z), bin_log = shared.value
        for batch in batches:
            texts, begin = batch.column("text"), 0
            while begin < len(texts):  # slices of about a megabyte
                part, size = [], 0
                while begin + len(part) < len(texts) and size < 1 << 20:
                    part.append(texts[begin + len(part)].as_py())
                    size += len(part[-1] or "")
                flat, sizes, tokens = classes_of(part, known, classes)
                a, b, w = contexts(flat, sizes)
                p = (m1[a, w].astype(np.float64) + m2[b, w] - z[a, b]) / ln10 - bin_log[w]
                logs = np.fromiter((e[1] if (e := known.get(t)) is not None else -1.0 for t in tokens), np.float64, len(tokens))
                is_known = logs >= 0
                common = np.where(is_known, logs, 0.0)
                inside = np.where(w >= bins, common, 0.0)
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                rare: list[list[bytes]] = []
                rare_n: list[list[int]] = []
                unseen = np.flatnonzero(~is_known)
                cut = np.searchsorted(unseen, np.concatenate([first, [len(tokens)]]))
                for i, j in zip(cut, cut[1:]):
                    counts = Counter(tokens[x] for x in unseen[i:j])
                    rare.append(list(counts.keys()))
                    rare_n.append(list(counts.values()))
                n = len(part)
                own = batch.slice(begin, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"), own.column("held_out"), own.column("row"), pa.array(sizes, pa.int64()),
                        pa.array(np.add.reduceat(is_known.astype(np.int64), first), pa.int64()),
                        pa.array(np.add.reduceat(common, first)), pa.array(np.add.reduceat(p + inside, first)),
                        pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "common", "model", "rare", "rare_n"],
                )
                begin += n

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (~train_fold()).alias("held_out"), F.monotonically_increasing_id().alias("row"), "text"
    )
    rows = materialize(rows.mapInArrow(of, schema), "lm_rows")
    # Tokens beyond the broadcast ones; none of them is frequent, so the join has no hot key.
    rare = rows.select("row", F.explode(F.arrays_zip(F.col("rare").alias("token"), F.col("rare_n").alias("n"))).alias("t")).select("row", "t.token", "t.n")
    hit = rare.join(counts, "token").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("rare_log"), F.sum("n").alias("rare_known")
    )
    denominator = math.log10(vocab.total + vocab.distinct + 1)
    extra = F.coalesce("rare_log", F.lit(0.0))
    return rows.drop("rare", "rare_n").join(hit, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("common") + extra - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )


def learn_and_score(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """docs: (doc_id, text); the rows outside the held-out fold teach, all rows are scored."""
    small_batches(docs.sparkSession)
    teach = docs.filter(train_fold()).select("text")
    counts = materialize(count_tokens(teach), "lm_counts")
    vocab = vocabulary(counts)
    model = train(teach, vocab, rounds)
    return score(docs.select("doc_id", "text"), counts, vocab, model)
