"""Operator 1: benchmark decontamination with a generalised suffix automaton.

The normalised words of all items of a block form one generalised suffix automaton. Every document is
streamed through it once, keeping the length of the longest match that ends at each word. A match of
``window`` words or more is an occurrence of item windows and covers all of its words; items with
fewer words are windows of their own, found along the suffix links. So the work is linear in the text,
whatever the number of items.

``scan`` reports, for each document, the covered spans (in words) and the items seen; ``decontaminate``
cuts the spans out of the text and drops the documents beyond the limits on items and coverage.

Items are dealt by a hash into blocks of about ``block_words`` words (an item is never cut). Each block's
automaton is built once, by one task, and frozen into arrays of about 60 bytes a word. Up to ``PASS_BLOCKS``
automata are broadcast together and a worker keeps them over its tasks, so one pass over the documents
serves a benchmark of PASS_BLOCKS * BLOCK_WORDS words; only a larger one takes a pass, and a written copy of
the documents, for each further set of blocks.

Edge cases: null and empty texts have no words and no hits. Items without words never occur. Item ids
may repeat (each id counts once) or be null (never reported, still hit). Repeated documents are judged alike.
Extra columns are kept, whatever their names; only a column named like ``out`` is replaced.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import alnum_words, materialize, release, small_batches, spare

WINDOW = 8
#: Words of items in one automaton (about 400 bytes each while it is built, 60 when frozen), and automata in a pass.
BLOCK_WORDS, PASS_BLOCKS = 250_000, 16
#: Limits beyond which a document goes: items seen, and the share of its words in spans.
MAX_ITEMS, MAX_COVERAGE = 1, 0.5
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class SuffixAutomaton:
    """All word sequences within the items; see the module text."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, str | None, int]] = []  # state at each end of a prefix, item, words so far
        whole: list[tuple[int, str | None, int]] = []
        for item, words in items:
            last = 0
            for n, w in enumerate(words, 1):
                last = self._extend(last, w)
                if n >= window:
                    ends.append((last, item, n))
            if 0 < len(words) < window:
                whole.append((last, item, len(words)))
        # The state of the last `window` words of any match that ends in a state.
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.at_window = [-1] * len(order)
        self.short: list[tuple[tuple[int, ...], ...]] = [()] * len(order)
        own: dict[int, list[tuple[int, str | None]]] = {}
        for state, item, n in whole:
            own.setdefault(state, []).append((n, item))
        for s in order[1:]:
            if self.len[s] >= window:
                up = self.link[s]
                self.at_window[s] = self.at_window[up] if self.len[up] >= window else s
            # Whole short items that are suffixes of what ends here, from the longest on.
            mine = own.get(s)
            above = self.short[self.link[s]]
            self.short[s] = (tuple(sorted(mine, key=lambda x: -x[0])) + above) if mine else above
        self.items: dict[int, set[str | None]] = {}
        for state, item, n in ends:
            self.items.setdefault(self.at_window[state], set()).add(item)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        found = nxt[last].get(w)
        if found is not None:
            return found if length[found] == length[last] + 1 else self._clone(last, w, found)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def freeze(self) -> "Frozen":
        return Frozen(self)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        return self.freeze().scan(words)


class Frozen:
    """The automaton as arrays: the edges of state s are at [begin[s], begin[s + 1]), by word number; ``seen_at``
    names the states of whole windows, in order, and ``seen_items`` the items of each."""

    def __init__(self, a: SuffixAutomaton):
        self.window = a.window
        self.number = {w: i for i, w in enumerate(a.next[0])}  # every word leaves the root
        self.root = array("i", a.next[0].values())
        self.begin, self.word, self.to = array("i", [0]), array("i"), array("i")
        for s, edges in enumerate(a.next):
            if s:
                found = sorted((self.number[w], to) for w, to in edges.items())
                self.word.extend(w for w, _ in found)
                self.to.extend(to for _, to in found)
            self.begin.append(len(self.word))
        self.link, self.len, self.at_window = array("i", a.link), array("i", a.len), array("i", a.at_window)
        self.short = {s: x for s, x in enumerate(a.short) if x}
        self.names = sorted({i for x in a.items.values() for i in x if i is not None})
        at = {i: n for n, i in enumerate(self.names)}
        self.seen_at, self.seen_begin, self.seen_items = array("i", sorted(a.items)), array("i", [0]), array("i")
        for s in self.seen_at:
            self.seen_items.extend(at[i] for i in a.items[s] if i is not None)
            self.seen_begin.append(len(self.seen_items))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Covered spans [begin, end) in words, merged, and the items with a window in the text."""
        begin, word, to, root, link, length = self.begin, self.word, self.to, self.root, self.link, self.len
        window, short = self.window, self.short
        spans: list[tuple[int, int]] = []
        seen: set[int] = set()
        items: set[str | None] = set()
        v = n = 0
        for i, w in enumerate(map(self.number.get, words), 1):
            if w is None:
                v = n = 0
                continue
            while v:
                first, end = begin[v], begin[v + 1]
                at = first if end - first == 1 else bisect_left(word, w, first, end)
                if at < end and word[at] == w:
                    v = to[at]
                    n += 1
                    break
                v = link[v]
                n = length[v]
            else:
                v, n = root[w], 1
            hit = 0
            if n >= window:
                hit = n
                # at_window[v] is the state whose words have the length `window` among their lengths
                seen.add(self.at_window[v])
            if short and v in short:
                for size, item in short[v]:
                    if size <= n:
                        hit = max(hit, size)
                        items.add(item)
            if hit:
                start = i - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        for s in seen:
            k = bisect_left(self.seen_at, s)
            items.update(self.names[x] for x in self.seen_items[self.seen_begin[k] : self.seen_begin[k + 1]])
        return spans, items


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """items: item_id, text. A written table (block, automaton): one row a block, built by one task each."""
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    rows = items.select(F.col("item_id").cast("string").alias("item"), "text")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = SuffixAutomaton([(i, alnum_words(x)) for i, x in zip(part["item"], part["text"])], window).freeze()
        return pd.DataFrame({"block": [part["block"].iloc[0]], "automaton": [pickle.dumps(made)]})

    return materialize(dealt.groupBy("block").applyInPandas(build, "block int, automaton binary"), "automata")


LEAK = "n_words long, n_hit long, spans array<int>, items array<string>"
_unpacked_by: dict[int, list[Frozen]] = {}


def _unpacked(shared: Broadcast) -> list[Frozen]:
    """The automata of a broadcast, unpacked once a worker; those of an earlier pass go."""
    value = shared.value
    key = hash(tuple(value))
    if key not in _unpacked_by:
        _unpacked_by.clear()
        _unpacked_by[key] = [pickle.loads(x) for x in value]
    return _unpacked_by[key]


def scan(
    docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, clean: bool = False,
    out: str = "leak",
) -> DataFrame:
    """Add the struct ``out``: n_words, n_hit, spans (array of begin and end in words, flattened), items (sorted ids)
    and, if asked for, clean: the text without the spans, null where there are none."""
    small_batches(docs.sparkSession)
    made = automata(items, window, block_words)
    blocks = sorted(r.block for r in made.select("block").collect())
    docs, before = docs.drop(out), F.lit(None).cast("struct<n_words:bigint,n_hit:bigint,spans:array<int>,items:array<string>>")
    for i in range(0, max(1, len(blocks)), PASS_BLOCKS):
        own = blocks[i : i + PASS_BLOCKS]
        packed = [bytes(r.automaton) for r in made.filter(F.col("block").isin(own)).collect()]  # of bounded size, see above
        last = i + PASS_BLOCKS >= len(blocks)
        docs = _scan_pass(docs, packed, text, before, clean and last, out)
        if not last:
            docs, before = materialize(docs, f"leak_{i}"), F.col(out)
    release(made)
    return docs


def _scan_pass(docs: DataFrame, packed: list[bytes], text: str, before: Column, clean: bool, out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    names = ["n_words", "n_hit", "spans", "items", *(["clean"] if clean else [])]

    @F.pandas_udf(LEAK + (", clean string" if clean else ""))
    def leak(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        machines = _unpacked(shared)
        for texts, before in batches:
            rows = []
            for x, spans0, items0 in zip(texts, before["spans"], before["items"]):
                words = alnum_words(x)
                spans: list[tuple[int, int]] = []
                if spans0 is not None and len(spans0):
                    spans = [(int(a), int(b)) for a, b in zip(spans0[::2], spans0[1::2])]
                known = set(items0 if items0 is not None else ())
                for machine in machines:
                    more, items = machine.scan(words)
                    spans += more
                    known |= items
                spans = merged(spans)
                flat = np.array([y for s in spans for y in s], np.int32)
                row = (len(words), sum(b - a for a, b in spans), flat, sorted(known - {None}))
                rows.append((*row, cut_spans(x, spans) if spans else None) if clean else row)
            yield pd.DataFrame(rows, columns=names)

    # So that a filter on the result doesn't make the optimizer compute it twice.
    return docs.withColumn(out, leak.asNondeterministic()(F.col(text), before))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, begin = [], 0
    for a, b in spans:
        out.append(text[begin : at[a][0]])
        begin = at[b - 1][1]
    return "".join([*out, text[begin:]])


_LOWER = {c: c + 32 for c in range(65, 91)}


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", max_items: int = MAX_ITEMS, max_coverage: float = MAX_COVERAGE,
    window: int = WINDOW, out: str | None = None,
) -> DataFrame:
    """Drop documents with more than max_items items or more than max_coverage of their words in spans;
    cut the spans out of the others. Documents without a hit stay as they are. The report of the scan is kept
    in the column ``out``, if one is named."""
    name = out or spare(docs, "leak")
    seen = scan(docs, items, text, window, clean=True, out=name)
    leak = F.col(name)
    kept = (F.size(leak["items"]) <= max_items) & (leak.n_hit <= max_coverage * leak.n_words)
    clean = seen.filter(kept).withColumn(text, F.when(leak.n_hit > 0, leak.clean).otherwise(F.col(text)))
    return clean if out else clean.drop(name)
