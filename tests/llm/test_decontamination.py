import random
import re

from lakesearch.llm import decontamination as dc
from lakesearch.llm.common import alnum_words


def brute(words, items, window=8):
    hit, seen = set(), set()
    for item, ws in items:
        size = min(window, len(ws))
        wins = {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                seen.add(item)
    return hit, seen


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for trial in range(400):
        letters = [b"a", b"b", b"c"][: rng.randint(1, 3)]
        window = rng.choice([2, 3, 5, 8])
        items = [(str(i), rng.choices(letters, k=rng.randint(0, 14))) for i in range(rng.randint(0, 6))]
        if trial % 3 == 0 and items:
            items.append(("again", items[0][1]))
        words = rng.choices(letters + [b"z"] * (trial % 2), k=rng.randint(0, 40))
        spans, seen = dc.SuffixAutomaton(items, window).scan(words)
        hit, want = brute(words, items, window)
        assert {i for a, b in spans for i in range(a, b)} == hit, (items, words, window)
        assert seen == want
        assert spans == dc.merged(spans)


def test_words():
    text = "AÉb_c 12-x\x00y  中文!Z"
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in alnum_words(text)] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    assert alnum_words(None) == [] == alnum_words(" .,")


PASSAGE = "Alpha beta, gamma delta epsilon zeta eta theta iota"


def test_columns_and_blocks(spark):
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, f"well {PASSAGE.upper()}! end " + "fine words here " * 20, 0), (4, "tiny quiz and " + PASSAGE, 0), (None, "clean", 0), (None, "clean", 0)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(7, PASSAGE), (7, PASSAGE), (8, "Tiny quiz"), (9, None), (10, "..."), (None, "clean")], "item_id long, text string")
    for size in (dc.BLOCK_WORDS, 3):
        got = dc.scan(docs, items, block_words=size).select("doc_id", "leak.*").collect()
        rows = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in got}
        assert rows == {(1, 0): (0, []), (2, 0): (0, []), (3, 71): (9, ["7"]), (4, 12): (11, ["7", "8"]), (None, 1): (1, [])}
        assert len(got) == 6
    kept = {r.doc_id: r.text for r in dc.decontaminate(docs, items).collect()}
    assert set(kept) == {1, 2, 3} and kept[3].startswith("well ! end fine") and kept[1] is None
    assert dc.scan(docs, items.limit(0)).filter("leak.n_hit > 0").count() == 0
    assert dc.scan(docs.limit(0), items).count() == 0
