"""Operator 6: quality rules with risk-controlled thresholds.

Each rule is a measure of the whole text on a grid of thousandths; it rejects from a cutoff upwards.
Cutoffs are chosen for each stratum (here the language) from labelled documents in two halves:

* the *tuning* half proposes for each rule the cutoff that rejects most bad documents at the least cost in
  good ones, and orders the rules by that gain; a rule without gain rejects nothing;
* the *holdout* half tests the rules together along one ordered sequence: the first rule from its loosest
  cutoff to the proposed one, then the second on top of it, and so on. A step is certified while the exact
  (Clopper-Pearson) upper bound of the false rejection of all rules so far stays within
  ``max_false_rejection``; the first failure ends the sequence, so no correction is due within a stratum.
  Over the strata the error probability is split evenly (Bonferroni).

The false rejection of all rules together in a stratum is thus within ``max_false_rejection``, in all
strata at once, with probability 1 - delta. A stratum needs ln(delta / strata) / ln(1 - max_false_rejection)
good holdout labels at least to reject anything by a rule: 86 with four strata.

Edge cases: a null or empty text has no words and fails the base rule. Documents of a stratum without
labels (a null stratum is one of its own, apart from any text) are judged by the base rule alone. Of several
labels of an id the largest counts. Repeated rows are judged alike. Extra columns are kept, whatever their
names; only ``base_failed``, ``kept`` and the named column of measures are replaced.
Memory: one text at a time; labels are joined with measures, never with texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, UPPER, fold_of, materialize, small_batches, spare, spread_join

SYMBOLS = b"#*$%&|<>"
#: Measures in thousandths of words, lines, letters or characters; each is a rule.
RULES = ("symbols", "repeats", "duplicates", "capitals", "exclamations", "long_words")
GRID = 1000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_FALSE_REJECTION, DELTA = 0.05, 0.05
#: Strata whose cutoffs (seven values each, about 2 MB in all) may be broadcast; beyond, rows meet them by a
#: join that deals the rows of a large stratum to several tasks.
BROADCAST_STRATA = 20_000
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + ", ".join(f"q_{r} int" for r in RULES)
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, reached = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, reached)
            reached = i + 3
    return total


def measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    blanks = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    chars = len(text or "") - blanks
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    duplicates = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    bangs = raw.count(b"!")
    upper = len(raw) - len(raw.translate(None, UPPER.encode()))
    letters = upper + len(raw) - len(raw.translate(None, LOWER.encode()))
    part = lambda x, y: min(GRID, GRID * x // y) if y else 0
    return (
        n, chars, symbols, duplicates, repeats,
        part(symbols, n), part(repeats, n), part(duplicates, len(lines)), part(upper, letters),
        part(bangs, n), part(chars, 40 * n),
    )


def measures(docs: DataFrame, text: str = "text", out: str = "measures") -> DataFrame:
    """Add the struct ``out`` with the counts and the measures of the rules."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(MEASURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for s in batches:
            yield pd.DataFrame([measure(x) for x in s], columns=names)

    return docs.withColumn(out, of(F.col(text)))


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n come with probability alpha or more."""
    if n == 0 or k >= n:
        return 1.0
    from math import exp, lgamma, log, log1p

    def tail(p: float) -> float:
        logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return exp(top) * sum(exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or tail(mid) > alpha:
            low = mid
        else:
            high = mid
    return high


def propose(hist: pd.DataFrame) -> tuple[int, int] | None:
    """Cutoff and gain of one rule in the tuning half of a stratum. hist: half (0 tuning), good (0, 1), q, n."""
    hist = hist[hist["half"] == 0]
    count = np.zeros((2, GRID + 2), np.int64)
    np.add.at(count, (hist["good"].to_numpy(), hist["q"].to_numpy()), hist["n"].to_numpy())
    above = count[..., ::-1].cumsum(-1)[..., ::-1]  # documents at or above each cutoff
    gain = above[0] - 20 * above[1]
    gain[0] = 0  # a rule never rejects everything
    if gain.max() <= 0:
        return None
    best = np.flatnonzero(gain == gain.max())
    run = best[best >= best[-1] - np.arange(len(best))[::-1]]
    return int(run[len(run) // 2]), int(gain.max())


def certify(steps: np.ndarray, n: int, risk: float, alpha: float) -> int:
    """Steps of the sequence that hold. steps: of the n good holdout documents, those rejected first at each step."""
    last: tuple[int, float] = (-1, 1.0)
    for i, k in enumerate(np.cumsum(steps)):
        if k != last[0]:
            last = (int(k), 1.0 if n == 0 or k / n > risk else upper_bound(int(k), n, alpha))
        if last[1] > risk:
            return i
    return len(steps)


def choose(hist: pd.DataFrame, risk: float, alpha: float) -> int | None:
    """Cutoff of one rule alone in one stratum. hist: half (0 tuning, 1 holdout), good (0, 1), q, n."""
    if (found := propose(hist)) is None:
        return None
    good = hist[(hist["half"] == 1) & (hist["good"] == 1)]
    by_q = np.bincount(good["q"].to_numpy(), good["n"].to_numpy(), GRID + 1)
    held = certify(by_q[::-1][: GRID + 1 - found[0]], int(good["n"].sum()), risk, alpha)
    return GRID + 1 - held if held else None


def stratum_key(stratum: Column) -> Column:
    """A text for each stratum; the null one is apart from all others."""
    return F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit(""))


def thresholds(measured: DataFrame, stratum: Column, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """From labelled measures (measures, id, good): a row per stratum with the cutoff of each rule, or null."""
    rows = measured.select(
        stratum_key(stratum).alias("stratum"),
        (fold_of(F.col("id"), 2)).cast("int").alias("half"),
        F.col("good").cast("int").alias("good"),
        *(F.col(f"measures.q_{r}").alias(r) for r in RULES),
    )
    long = rows.filter("half = 0").select(
        "stratum", "half", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("q")) for r in RULES))).alias("x")
    ).select("stratum", "half", "good", "x.*")
    hist = long.groupBy("stratum", "rule", "half", "good", "q").agg(F.count("*").alias("n"))
    n_strata = rows.select("stratum").distinct().count()

    def proposal(key: tuple[str, str], part: pd.DataFrame) -> pd.DataFrame:
        cut, gain = propose(part) or (None, None)
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "cut": pd.array([cut], "Int64"), "gain": pd.array([gain], "Int64")})

    # A group has 2 * (GRID + 1) counts at most, whatever the number of documents.
    proposed = hist.groupBy("stratum", "rule").applyInPandas(proposal, "stratum string, rule string, cut long, gain long").filter("cut is not null")
    before = Window.partitionBy("stratum").orderBy(F.desc("gain"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    proposed = proposed.withColumn("start", F.coalesce(F.sum(GRID + 1 - F.col("cut")).over(before), F.lit(0)))
    sequence = materialize(
        proposed.groupBy("stratum").agg(
            F.sum(GRID + 1 - F.col("cut")).alias("steps"),
            *(F.max(F.when(F.col("rule") == r, F.struct("cut", "start"))).alias(f"of_{r}") for r in RULES),
        ),
        "sequence",
    )
    # The step that rejects a good holdout document first, or null.
    first = F.least(*(F.when(F.col(r) >= F.col(f"of_{r}.cut"), F.col(f"of_{r}.start") + GRID - F.col(r)) for r in RULES))
    tested = meet(rows.filter("half = 1 and good = 1"), sequence, "stratum", "inner")
    tested = tested.groupBy("stratum", "steps", first.alias("step")).agg(F.count("*").alias("n"))

    def test(part: pd.DataFrame) -> pd.DataFrame:
        hit = part[part["step"].notna()]
        by_step = np.bincount(hit["step"].to_numpy(np.int64), hit["n"].to_numpy(), int(part["steps"].iloc[0]))
        held = certify(by_step, int(part["n"].sum()), max_false_rejection, delta / n_strata)
        return pd.DataFrame({"stratum": [part["stratum"].iloc[0]], "held": [held]})

    held = tested.groupBy("stratum").applyInPandas(test, "stratum string, held long")
    cut = lambda c: F.when(F.col("held") > c.start, F.greatest(c.cut, GRID + 1 + c.start - F.col("held")))
    return sequence.join(held, "stratum").select("stratum", *(cut(F.col(f"of_{r}")).alias(f"cut_{r}") for r in RULES))


def meet(rows: DataFrame, of_stratum: DataFrame, key: str, how: str) -> DataFrame:
    """Join rows with a written table of one row a stratum. A stratum may hold most rows, so they aren't shuffled by
    it alone: few strata are broadcast, of many the large ones are dealt."""
    if of_stratum.count() <= BROADCAST_STRATA:
        return rows.join(F.broadcast(of_stratum), key, how)
    return spread_join(rows, of_stratum, key, how)


def judge(measured: DataFrame, labels: DataFrame, stratum: str = "lang", measures: str = "measures", **risk: float) -> DataFrame:
    """Add base_failed and kept to rows (doc_id, measures, stratum, ...), a written table; labels: doc_id, quality (1 is good)."""
    good = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("good"))
    own = measured.select(F.col("doc_id").alias("id"), F.col(measures).alias("measures"), F.col(stratum).alias("stratum"))
    cuts = materialize(thresholds(own.join(good, "id"), F.col("stratum"), **risk), "cutoffs")
    m = F.col(measures)
    base = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
    key, cut = spare(measured, "stratum_key"), spare(measured, "cuts")
    packed = cuts.select(F.col("stratum").alias(key), F.struct(*(f"cut_{r}" for r in RULES)).alias(cut))
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(m[f"q_{r}"] >= F.col(cut)[f"cut_{r}"], F.lit(False))
    rows = measured.drop("base_failed", "kept").withColumn(key, stratum_key(F.col(stratum)))
    return meet(rows, packed, key, "left").withColumn("base_failed", base).withColumn("kept", ~base & ~hit).drop(key, cut)
