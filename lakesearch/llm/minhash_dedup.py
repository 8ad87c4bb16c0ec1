"""Operator 10: near-duplicates by MinHash bands with sequential Bayesian verification.

1. A pass over the whole texts gives each document the number of its distinct word shingles, a 128-bit
   fingerprint of the set and a MinHash signature. Documents with equal sets form a class at once; its
   smallest id represents it from here on.
2. The signatures are cut into bands. The number of rows a band holds is the largest for which a pair at
   the threshold shares no band with probability ``miss`` at most. Representatives that share a band are
   candidates.
3. Sequential Bayesian verification compares signatures in batches of ``BATCH`` values. With a uniform
   prior, m matches in n values leave the similarity a Beta(m + 1, n - m + 1); a pair is dropped as soon
   as the posterior probability of reaching the threshold is below ``miss``. Survivors are verified on
   their full shingle sets, recomputed from the texts, after an exact bound on the set sizes.
4. Candidates are taken in rounds so that no group is expanded into pairs. In the first ``STARS`` rounds
   the members of a band bucket meet one center, another in each round. Components are formed from the
   verified links, and a bucket whose members are all in one component is closed. The last round makes
   the search exact: the members of open buckets outside the bucket's main component meet all members of
   other components with which they share a band, block against block. Tasks first compare signatures and
   name the documents with a partner that passes; only these are met again with their full sets, in tasks
   that emit verified links only. A large group of copies closes in the first rounds; the last compares
   what really differs. No cap applies: a group of any size is dealt into blocks (``BLOCK`` documents or
   ``BLOCK_SHINGLES`` shingles on average), each pair of blocks for a task of its own. Joins by band, center
   or component deal the rows of a hot key to several tasks.

Shingle hashes are 64-bit words, built from two mixed polynomial hashes of the words; set sizes and
intersections are exact but for collisions among them (about n^2 / 2^65 in a set of n).

Edge cases: null and empty texts and texts without words have no shingles and are linked with nothing;
a text with fewer words than a shingle is one shingle. Rows with a null id are components of their own.
A repeated id is one document here if its rows have equal texts; with different texts, its rows are
linked through the id. Extra columns are kept, whatever their names. Ids have to be of an integer type;
another type raises TypeError before anything runs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import materialize, mix64, release, small_batches, spare, spread_join
from .components import components

HASHES, BATCH, MISS = 128, 16, 1e-6
BLOCK, BLOCK_SHINGLES, STARS = 128, 1_000_000, 2
#: Pieces of text that numpy handles at once, in bytes.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_P = np.uint64(0x5851F42D4C957F2D)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(64, _P, np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    out = []
    begin = 0
    while begin < len(raw):
        end = min(len(raw), begin + PIECE)
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1  # a word is never cut
        out.append(_piece_hashes(np.frombuffer(raw, np.uint8, end - begin, begin)))
        begin = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _piece_hashes(b: np.ndarray) -> np.ndarray:
    gap = _SPACE[b]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    size = stop - start
    out = np.zeros(len(start), np.uint64)
    value = _BYTE[b]
    # Horner's rule over the letters of all words at once; few words are longer than a few dozen bytes.
    live, k = np.arange(len(start)), 0
    while len(live) and k < 48:
        out[live] = mix_step(out[live], value[start[live] + k])
        k += 1
        live = live[size[live] > k]
    for i in live:
        h = int(out[i])
        rest = b[start[i] : stop[i]].tobytes().lower()
        out[i] = h ^ int.from_bytes(hashlib.blake2b(rest, digest_size=8).digest(), "little")
    return mix64(out + size.astype(np.uint64))


def mix_step(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * _P
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the whole text."""
    words = word_hashes((text or "").encode("utf-8", "replace"))
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = mix64(h * _P + words[i : n - k + 1 + i])
    return np.unique(h)


def _coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return x[:hashes] | np.uint64(1), x[hashes:]


def signature(s: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """uint32 MinHash values of a non-empty set, in pieces of bounded memory."""
    a, b = _coefficients(hashes)
    low = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[i : i + 2048, None] * a + b).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def plan_bands(threshold: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): as many rows a band as the chance of a miss at the threshold allows."""
    for rows in range(hashes // 2, 0, -1):
        bands = hashes // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    return hashes, 1


@lru_cache
def least_matches(threshold: float, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(n, m): after n values a pair goes on only with m matches or more."""
    out = []
    for n in range(batch, hashes + 1, batch):
        # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m) under a uniform prior
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def survive(x: np.ndarray, y: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two signature arrays pass all batches; most pairs stop after the first."""
    alive, matches, seen = np.arange(len(x)), np.zeros(len(x), np.int32), 0
    for n, least in least_matches(threshold, x.shape[1], BATCH, miss):
        matches[alive] += (x[alive, seen:n] == y[alive, seen:n]).sum(1)
        alive = alive[matches[alive] >= least]
        seen = n
    return alive


def profiles(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sig, keys): fingerprint of the set, signature and band keys."""

    @F.pandas_udf("n_shingles long, hi long, lo long, sig binary, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            s = shingles(text, k)
            if not len(s):
                out.append((0, 0, 0, None, None))
                continue
            sig = signature(s)
            h = np.arange(1, bands + 1, dtype=np.uint64)
            for j in range(rows):
                h = mix64(h * _P + sig[j : bands * rows : rows].astype(np.uint64))
            hi, lo = np.bitwise_xor.reduce(mix64(s * _P)), mix64(s).sum(dtype=np.uint64)
            out.append((len(s), _signed(hi), _signed(lo), sig.tobytes(), h.view(np.int64)))
        return pd.DataFrame(out, columns=["n_shingles", "hi", "lo", "sig", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), of("text").alias("p")).select("doc_id", "p.*")


def _signed(x: np.uint64) -> int:
    return int(np.uint64(x).view(np.int64))


def full_sets(docs: DataFrame, ids: DataFrame, k: int, tag: str) -> DataFrame:
    """(doc_id, set) of the documents whose id is in ids, recomputed from their whole texts."""

    @F.pandas_udf("binary")
    def full(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x, k).tobytes() for x in texts], dtype=object)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.distinct(), "doc_id", "left_semi")
    return materialize(texts.select("doc_id", full("text").alias("set")), f"sets_{tag}")


def similar(p: bytes, q: bytes, percent: int) -> bool:
    s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    common = int((t[at] == s).sum()) if len(t) else 0
    return 100 * common >= percent * (len(s) + len(t) - common)


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int, tag: str) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union on the full sets. b may be a hub.

    Only the documents in a pair are read again; each pair meets its two sets by two equi joins.
    """
    of = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), k, tag)
    one = pairs.join(of.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    hubs = pairs.groupBy("b").agg(F.count("*").alias("n"))
    both = spread_join(one, of.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b", salt=("a",), counts=hubs)

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(p, q, percent) for p, q in zip(x, y)])

    found = materialize(both.filter(linked("x", "y")).select("a", "b"), f"links_{tag}")
    release(of)
    return found


def cluster(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """docs: (doc_id, text). Returns (doc_id, n_shingles, component_id), a row for each row of docs."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("near-duplicate groups are named by their smallest doc_id, which has to be an integer")
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    threshold = percent / 100
    bands, rows = plan_bands(threshold, HASHES, miss)
    profile = materialize(profiles(docs, k, bands, rows), "profiles")
    fp = ["n_shingles", "hi", "lo"]
    real = profile.filter("n_shingles > 0 and doc_id is not null")
    reps = materialize(real.groupBy(*fp).agg(F.min("doc_id").alias("rep")), "classes")
    heads = materialize(
        real.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", *fp], "left_semi").dropDuplicates(["doc_id", *fp]), "heads"
    )
    small = heads.select("doc_id", "n_shingles", "sig")
    # Ids with several different sets link the classes of these.
    several = real.groupBy("doc_id").agg(*(F.min(c).alias(f"{c}_0") for c in fp), *(F.max(c).alias(f"{c}_1") for c in fp)).filter(
        " or ".join(f"{c}_0 <> {c}_1" for c in fp)
    )
    own = real.join(several.select("doc_id"), "doc_id", "left_semi").join(reps, fp).filter("doc_id <> rep")
    label = components(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))

    member = heads.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    shared = materialize(member.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    buckets = materialize(spread_join(member, shared, "key", salt=("id",), counts=shared).select("id", "key"), "buckets")
    release(shared)
    tried: DataFrame | None = None
    done: list[DataFrame] = []
    for r in range(STARS + 1):
        at = buckets.join(label.select(F.col("node").alias("id"), "component"), "id", "left")
        placed = materialize(at.withColumn("component", F.coalesce("component", "id")), "placed")
        # Buckets with more than one component, with a center that differs from round to round.
        order = F.xxhash64("id", F.lit(r)) if r else F.col("id")
        split = placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
            F.min_by("id", order).alias("center"), F.min_by("component", order).alias("own"),
        ).filter("low <> high and n > 2" if r else "low <> high")
        split = materialize(split.select("key", "n", "center", "own"), "split")
        met = spread_join(placed, split.drop("n"), "key", salt=("id",), counts=split)
        if r == STARS:
            opened = materialize(met.select("id", "component", "key"), "opened")
            links = across(opened, heads, docs, k, percent, miss)
            release(opened)
        else:
            pairs = met.filter("component <> own").select(F.col("id").alias("a"), F.col("center").alias("b"))
            pairs = materialize(pairs.distinct(), "met")
            passed = posterior(pairs, small, percent, threshold, miss)
            ends = [F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")]
            if tried is not None:
                passed = passed.select("a", "b", *ends).join(tried.select(*ends), ["high", "low"], "left_anti").select("a", "b")
            passed = materialize(passed, f"pairs_{r}")
            links = verify(passed, docs, k, percent, str(r))
            tried = passed if tried is None else tried.unionByName(passed)
            done.append(passed)
            release(pairs)
        if not links.isEmpty():
            known = label.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            was, label = label, components(links.unionByName(known))
            release(was)
        release(placed, split, links)
    release(buckets, heads, *done)
    of_class = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    classes = materialize(of_class.select(*fp, F.coalesce("component", "rep").alias("component_id")), "component_of_class")
    release(reps, label)
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return profile.join(classes, fp, "left").select(
        "doc_id", "n_shingles", F.when(known, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def posterior(pairs: DataFrame, heads: DataFrame, percent: int, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) whose set sizes allow the similarity and whose signatures pass the batches. b may be a hub."""
    x = heads.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("m"), F.col("sig").alias("x"))
    y = heads.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n"), F.col("sig").alias("y"))
    hubs = pairs.groupBy("b").agg(F.count("*").alias("n"))
    both = spread_join(pairs.join(x, "a"), y, "b", salt=("a",), counts=hubs)
    both = both.filter(F.expr(f"100 * least(m, n) >= {percent} * greatest(m, n)"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s, t = (np.frombuffer(b"".join(b[c]), np.uint32).reshape(len(b), -1) for c in ("x", "y"))
                yield b.iloc[survive(s, t, threshold, miss)][["a", "b"]]

    # An id with several sets may pass more than once.
    return both.select("a", "b", "x", "y").mapInPandas(test, "a long, b long").distinct()


def partners(rows: pd.DataFrame, percent: int, miss: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of two blocks of documents: each row of the outer one (``out``) with the rows of the other that share a
    band, are of another component, and whose sizes and signatures allow the similarity."""
    comp, size, out = (rows[c].to_numpy() for c in ("component", "n_shingles", "out"))
    left, right = np.flatnonzero(out), np.flatnonzero(~out)
    if not len(left) or not len(right):
        return
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), -1)
    keys = np.stack(rows["keys"])
    flat = keys[right].ravel()
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], right[order // keys.shape[1]]
    for i in left:
        lo, hi = np.searchsorted(flat, keys[i], "left"), np.searchsorted(flat, keys[i], "right")
        j = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo, hi)]))
        j = j[comp[j] != comp[i]]
        j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
        if len(j):
            j = j[survive(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], percent / 100, miss)]
        if len(j):
            yield i, j


def across(opened: DataFrame, heads: DataFrame, docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """Links across components in open buckets. opened: (key, id, component), a written table.

    The main component of a bucket is the one with most of its members. Buckets with the same main
    component form a group, in which the documents outside it meet all others. Both sides are dealt into
    blocks by the number of documents and of shingles, a task for each pair of blocks. It gets signatures
    and band keys first; full sets come only to the tasks and documents with a partner that passes.
    """
    per = opened.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    main = materialize(main, "main")
    met = spread_join(opened, main.drop("n"), "key", salt=("id",), counts=main)
    rows = materialize(met.select("main", "id", "component").distinct(), "open")
    narrow = heads.select(F.col("doc_id").alias("id"), "n_shingles")
    outside = F.col("component") != F.col("main")
    parts = lambda n, m: F.greatest(F.ceil(n / BLOCK), F.ceil(m / BLOCK_SHINGLES)).cast("int")
    dims = rows.join(narrow, "id").groupBy("main").agg(
        parts(F.count("*"), F.sum("n_shingles")).alias("parts"), F.count("*").alias("n"),
        parts(F.count_if(outside), F.sum(F.when(outside, F.col("n_shingles")).otherwise(0))).alias("out_parts"),
    )
    dims = materialize(dims, "dims")
    dealt = spread_join(rows, dims.drop("n"), "main", salt=("id",), counts=dims)
    row = ["main", "id", "component"]
    every = dealt.select(
        *row, F.lit(False).alias("out"), F.explode(F.sequence(F.lit(0), F.col("out_parts") - 1)).alias("p"),
        F.pmod(F.xxhash64("id"), "parts").cast("int").alias("q"),
    )
    outer = dealt.filter(outside).select(
        *row, F.lit(True).alias("out"), F.pmod(F.xxhash64("id", F.lit(1)), "out_parts").cast("int").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"),
    )
    head = heads.select(F.col("doc_id").alias("id"), "n_shingles", "sig", "keys")
    place = ["main", "p", "q"]

    def name(rows: pd.DataFrame) -> pd.DataFrame:
        found: set[int] = set()
        for i, j in partners(rows, percent, miss):
            found.add(i)
            found.update(j)
        return rows.iloc[sorted(found)][[*place, "id", "component", "out"]]

    schema = "main long, p int, q int, id long, component long, out boolean"
    named = materialize(every.unionByName(outer).join(head, "id").groupBy(*place).applyInPandas(name, schema).distinct(), "named")
    of = full_sets(docs, named.select(F.col("id").alias("doc_id")), k, "open")
    filled = named.join(head, "id").join(of.withColumnRenamed("doc_id", "id"), "id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ids, comp, sets = (rows[c].to_numpy() for c in ("id", "component", "set"))
        found = []
        for i, j in partners(rows, percent, miss):
            linked: set[int] = set()
            for x in j:
                if comp[x] not in linked and similar(sets[i], sets[x], percent):
                    linked.add(comp[x])
                    found.append((ids[i], ids[x]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    links = materialize(filled.groupBy(*place).applyInPandas(compare, "a long, b long"), "links_open")
    release(of, named, rows, dims, main)
    return links


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id; rows without id or words all stay."""
    keep = cluster(docs, k, percent).filter("doc_id = component_id and n_shingles > 0").select("doc_id").distinct()
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    nth = spare(docs, "nth")
    numbered = docs.filter(~alone).withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))))
    return docs.filter(alone).unionByName(numbered.filter(F.col(nth) == 1).join(keep, "doc_id", "left_semi").select(*docs.columns))
