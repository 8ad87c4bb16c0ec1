import re
from collections import Counter

import pandas as pd
import pytest

from lakesearch.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = [None, "", " \n\t ", "a b c a b c", "x x x x", "a\na\n\n\nb\n a", "é b# c d e\n" * 5, "w " * 5000, "one two three " + "four five six " * 2]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert qr.measure(text)[:5] == brute(text)


def test_upper_bound_is_exact():
    for k, n, a in ((0, 50, 0.05), (3, 100, 0.01), (10, 2000, 0.001)):
        p = qr.upper_bound(k, n, a)
        from math import comb

        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - a) < 1e-6
    assert qr.upper_bound(0, 0, 0.05) == 1 == qr.upper_bound(5, 5, 0.05)


def hist(good_tune, bad_tune, good_hold):
    rows = [(0, 1, q, n) for q, n in good_tune] + [(0, 0, q, n) for q, n in bad_tune] + [(1, 1, q, n) for q, n in good_hold]
    return pd.DataFrame(rows, columns=["half", "good", "q", "n"])


def test_choose_certifies_on_the_holdout():
    assert qr.choose(hist([(10, 2000)], [(500, 50)], [(10, 2000)]), 0.01, 0.001) in range(11, 501)
    assert qr.choose(hist([(10, 2000)], [(500, 50)], [(10, 20)]), 0.01, 0.001) is None  # too few to certify
    assert qr.choose(hist([(10, 2000)], [(500, 50)], [(900, 100), (10, 1900)]), 0.01, 0.001) > 900
    assert qr.choose(hist([(10, 2000)], [], [(10, 2000)]), 0.01, 0.001) is None


def test_judge(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}***" for i in range(60))
    rows = [(i, bad if i % 4 == 0 else good, "en" if i % 2 else None, 1) for i in range(8000)] + [(9001, "short", "en", 2), (None, None, "en", 3), (1, good, "en", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(8000)] + [(None, 1), (3, None)], "doc_id long, quality int")
    measured = qr.measures(docs).drop("text")
    got = qr.judge(measured, labels).select("doc_id", "lang", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or r.doc_id == 9001:
            assert r.base_failed and not r.kept
        else:
            assert r.kept == (r.doc_id % 4 != 0) and not r.base_failed, r
    assert qr.judge(measured.limit(0), labels).count() == 0
    assert qr.judge(measured, labels.limit(0)).filter("kept").count() == 8001


def test_small_strata_are_certified(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}***" for i in range(60))
    loud = " ".join(f"WORD{i}!!" for i in range(60))
    rows = [(i, (bad, loud, good, good, good, good)[i // 4 % 6], "abcd"[i % 4]) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i // 4 % 6 > 1)) for i, _, _ in rows], "doc_id long, quality int")
    got = qr.judge(qr.measures(docs).drop("text"), labels).collect()
    assert len(got) == 1600 and all(r.kept == (r.doc_id // 4 % 6 > 1) for r in got)
    few = qr.judge(qr.measures(docs).drop("text"), labels.filter("doc_id < 400")).collect()
    assert all(r.kept for r in few)  # fewer than 86 good holdout labels a stratum


def test_the_rules_share_one_bound():
    steps = [0, 2, 0, 3, 0]
    assert qr.certify(qr.np.array(steps), 200, 0.05, 0.05) == 3
    assert qr.upper_bound(2, 200, 0.05) <= 0.05 < qr.upper_bound(5, 200, 0.05)
    assert qr.certify(qr.np.array([0]), 85, 0.05, 0.0125) == 0 and qr.certify(qr.np.array([0]), 86, 0.05, 0.0125) == 1


def verdicts(rows, labels, risk=0.05, delta=0.05):
    """kept of each row by the definition: propose on one half, certify along one sequence on the other."""
    from math import comb
    from zlib import crc32

    measured = [(i, lang, qr.measure(t)) for i, t, lang in rows]
    teach = [(i, lang, m, labels[i]) for i, lang, m in measured if i in labels]
    strata = {lang for _, lang, _, _ in teach}
    cuts = {}
    for s in strata:
        half = lambda k: [(m, y) for i, lang, m, y in teach if lang == s and crc32(str(i).encode()) % 2 == k]  # noqa: B023, E731
        plan = []
        for nth, rule in enumerate(qr.RULES):
            gains = {}
            for q in range(1, qr.GRID + 1):
                hit = [y for m, y in half(0) if m[5 + nth] >= q]
                gains[q] = hit.count(0) - 20 * hit.count(1)
            best = max(gains.values())
            if best > 0:
                run = [q for q in gains if gains[q] == best]
                tail = [run[-1]]
                while tail[0] - 1 in run:
                    tail.insert(0, tail[0] - 1)
                plan.append((-best, rule, nth, tail[len(tail) // 2]))
        good = [m for m, y in half(1) if y == 1]
        n, held, out, done = len(good), set(), {}, False
        for _, _, nth, cut in sorted(plan):
            for q in range(qr.GRID, cut - 1, -1):
                held |= {j for j, m in enumerate(good) if m[5 + nth] >= q}
                k = len(held)
                # The exact upper bound is within the risk if k or fewer are unlikely at that risk.
                tail_p = sum(comb(n, x) * risk**x * (1 - risk) ** (n - x) for x in range(k + 1)) if n else 1.0
                if k >= n or tail_p > delta / len(strata):
                    done = True
                    break
                out[nth] = q
            if done:
                break
        cuts[s] = out
    kept = []
    for i, lang, m in measured:
        base = m[0] < 50 or 100 * m[4] > 50 * m[0]
        kept.append((i, not base and not any(m[5 + nth] >= q for nth, q in cuts.get(lang, {}).items())))
    return kept


def test_verdicts_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    rows, labels = [], {}
    for i in range(1500):
        bad = rng.random() < 0.2
        junk = rng.choice(["*** ", "!! ", "LOUD ", "word1 word2 word3 "]) if bad else rng.choice(["plain ", "a! ", "x* "])
        text = " ".join(f"w{rng.randrange(500)} " + (junk if rng.random() < (0.5 if bad else 0.03) else "") for _ in range(rng.randint(45, 80)))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None])))
        if rng.random() < 0.9:
            labels[i] = int(not bad) if rng.random() < 0.99 else int(bad)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = qr.judge(qr.materialize(qr.measures(docs), "measured"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    got = sorted((r.doc_id, r.kept) for r in judged.collect())
    want = sorted(verdicts(rows, labels))
    assert got == want
    assert len({k for _, k in want}) == 2 and sum(not k for _, k in want) > 100
