"""Operator 4: exact SentencePiece BPE encoding by backtracking, and decoding.

Encoding. The text gets the dummy prefix and its blanks become U+2581. It is cut where no piece can
reach across (before a run of U+2581 that follows another character, and around characters that no
longer piece holds). Each cut part is encoded alone:

* an Aho-Corasick automaton over all reachable pieces finds the longest piece at every position;
* from the left, the longest piece that is *compatible* with the one before it is taken. Two
  neighbours are compatible if re-merging their joined text by score yields just these two;
* where none fits, the encoder steps back and marks the position in a bitfield of failed positions,
  so that every position fails at most once and the work stays linear.

A part with two U+2581 or more in a row is merged by score directly: the pieces of blank runs share
one score, and with equal scores the result of a merge depends on its place in the run.

Edge cases: a null or empty text has no ids and decodes to the empty text. Characters without a
piece become the byte pieces of their UTF-8. Repeated rows are encoded alike, extra columns are kept.
Memory: a worker holds the vocabulary, and bounded caches of parts and of neighbour checks.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import small_batches, spare

BLANK = "▁"
#: Parts and neighbour pairs that a worker keeps (about 90 MB); when full, a cache starts anew.
CACHE_PARTS, CACHE_PAIRS, CACHED_CHARS = 250_000, 400_000, 64
#: A part may end before one of these.
SIGNS = ".,!*$%&#|"

_codecs: dict[str, "PieceCodec"] = {}


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """The vocabulary of a SentencePiece BPE model with an identity normaliser and byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes_of: dict[int, int] = {}
        self.byte_ids = [0] * 256
        self.hidden: set[int] = set()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes_of[i] = int(piece[1:-1], 16)
                self.byte_ids[self.bytes_of[i]] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.hidden.add(i)
            else:
                self.id[piece], self.score[piece] = i, sp.get_score(i)
        self.decimal = {p: b"%d," % i for p, i in self.id.items()}
        self.text_of = {p: p.replace(BLANK, " ") for p in self.id}
        long = [p for p in self.id if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in long):
            raise ValueError("a piece goes on past a blank; the parts can't be cut there")
        held = set("".join(long))
        # Cut around line ends and tabs if no longer piece holds them, and between a run of characters
        # and a sign when no piece has any of those characters beside a sign.
        loose = "".join(c for c in "\n\t" if c not in held)
        beside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        signs = set(SIGNS)
        near = {c for two in beside if signs & set(two) for c in two} | signs | {BLANK, "\n", "\t"}
        esc = "".join(re.escape(c) for c in sorted(near))
        sign = "".join(re.escape(c) for c in sorted(signs))
        self.cut = re.compile(
            (f"[{re.escape(loose)}]|" if loose else "")
            + f"{BLANK}*[^{esc}]+(?=[{sign}])|{BLANK}*[^{BLANK}{re.escape(loose)}]+|{BLANK}+"
        )
        self.automaton = ahocorasick.Automaton()
        self.next_shorter: dict[str, str | None] = {}
        for p in self.id:
            if p.strip(BLANK) == "" and len(p) > 1:
                continue  # runs of blanks never get here
            if len(p) == 1 or self.merge(p) == [p]:
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        for p in self.automaton:
            shorter = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.automaton), None)
            self.next_shorter[p] = shorter
        self.after: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.parts: dict[str, tuple[bytes, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merge by score, the leftmost first among equals; the definition of the encoding."""
        if len(text) <= 24:
            short, score = list(text), self.score
            while len(short) > 1:
                best, at = None, -1
                for i in range(len(short) - 1):
                    s = score.get(short[i] + short[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                short[at : at + 2] = [short[at] + short[at + 1]]
            return short
        sym: list[str | None] = list(text)
        left, right = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(sym) and (both := sym[a] + sym[b]) in self.score:
                heapq.heappush(heap, (-self.score[both], a, b, both))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or right[a] != b or sym[a] + sym[b] != both:
                continue
            sym[a], sym[b] = both, None
            right[a] = right[b]
            if right[b] < len(sym):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in sym if s is not None]

    def compatible(self, a: str, b: str) -> bool:
        if (known := self.after.get(a)) is None:
            known = self.after[a] = {}
        found = known.get(b)
        if found is None:
            if self.n_pairs >= CACHE_PAIRS:
                self.after.clear()
                self.n_pairs, known = 0, self.after.setdefault(a, {})
            self.n_pairs += 1
            found = known[b] = self.merge(a + b) == [a, b]
        return found

    def backtrack(self, text: str) -> list[str]:
        longest = list(text)  # by position; a character without a piece stands for itself
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # matches come by their end, so the last is the longest
        failed = bytearray()  # bit i: no encoding that was tried goes on from i; empty until one fails
        shorter, after = self.next_shorter, self.after
        out: list[str] = []
        size, at, token, last = len(text), 0, longest[0], None
        while True:
            if last is None:
                while token is not None and failed and failed[(i := at + len(token)) >> 3] >> (i & 7) & 1:
                    token = shorter.get(token)
            else:
                known = after.get(last) or {}
                while token is not None:
                    fits = known.get(token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits and not (failed and failed[(i := at + len(token)) >> 3] >> (i & 7) & 1):
                        break
                    token = shorter.get(token)
            if token is None:
                if last is None:
                    return self.merge(text)  # can't happen with a vocabulary made by merging
                failed = failed or bytearray((size >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                out.pop()
                at -= len(last)
                token, last = shorter.get(last), out[-1] if out else None
                continue
            out.append(token)
            at += len(token)
            if at == size:
                return out
            last, token = token, longest[at]

    def part(self, text: str) -> tuple[bytes, str]:
        """Of a cut part: its ids as decimals, each with a comma, and the text they decode to."""
        if len(text) == 1:
            pieces = [text]
        elif text.startswith(BLANK * 2):
            pieces = self.merge(text)
        elif len(text) > 4096:
            pieces = self._long(text)
        else:
            pieces = self.backtrack(text)
        try:
            return b"".join([self.decimal[p] for p in pieces]), "".join([self.text_of[p] for p in pieces])
        except KeyError:
            ids: list[int] = []
            for p in pieces:
                ids += [self.id[p]] if p in self.id else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
            return b"".join(b"%d," % i for i in ids), self.pieces_text(ids)

    def _long(self, text: str) -> list[str]:
        """Very long parts: cut further between characters that never stand together in a piece."""
        out, begin = [], 0
        if not hasattr(self, "_together"):
            self._together = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in self._together:
                piece = text[begin:i]
                out += self.backtrack(piece) if len(piece) < 50_000 else self.merge(piece)
                begin = i
        return out

    def pieces_text(self, ids: list[int]) -> str:
        """Text of ids without the rule for the dummy prefix; runs of byte pieces are read as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(bytes(run).decode("utf-8", "replace"))
                run.clear()
            if i not in self.hidden:
                out.append(self.pieces[i].replace(BLANK, " "))
        if run:
            out.append(bytes(run).decode("utf-8", "replace"))
        return "".join(out)

    def _parts(self, text: str) -> list[tuple[bytes, str]]:
        known, parts = self.parts, self.cut.findall(BLANK + text.replace(" ", BLANK))
        out = list(map(known.get, parts))
        if None in out:
            for i, x in enumerate(parts):
                if out[i] is None:
                    found = known.get(x)
                    if found is None:
                        found = self.part(x)
                        if len(x) <= CACHED_CHARS:
                            if len(known) >= CACHE_PARTS:
                                known.clear()
                            known[x] = found
                    out[i] = found
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in b"".join(p[0] for p in self._parts(text)).split(b",")[:-1]] if text else []

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        first = next((i for i in ids if i not in self.hidden), None)
        return text[1:] if first is not None and self.pieces[first].startswith(BLANK) else text

    def digest(self, text: str) -> tuple[int, bytes, str]:
        """Number of ids, the ids as decimals with commas between, and the text they decode to."""
        if not text:
            return 0, b"", ""
        parts = self._parts(text)
        ids = b"".join([p[0] for p in parts])[:-1]
        # The first part begins with the dummy prefix; decoding drops that one blank.
        return ids.count(b",") + 1, ids, "".join([p[1] for p in parts])[1:]


def codec(model_file: str) -> PieceCodec:
    """One codec a worker and model; its caches last over tasks."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model_file: str | None = None) -> DataFrame:
    """Add the column ``out`` (array<int>) with the ids of the whole text; all columns are kept."""
    model = model_file or public_model()
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model)
        for s in batches:
            yield pd.Series([c.encode(x or "") for x in s], dtype=object)

    return docs.withColumn(out, ids(F.col(text)))


def round_trip(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", model_file: str | None = None) -> DataFrame:
    """Add the ids of the whole text and the text that they decode to, in one pass of one worker a task. Columns
    of these two names are replaced, all others are kept."""
    model = model_file or public_model()
    small_batches(docs.sparkSession)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for s in batches:
            coded = [c.encode(x or "") for x in s]
            yield pd.DataFrame({"ids": pd.Series(coded, dtype=object), "decoded": pd.Series([c.decode(x) for x in coded], dtype=object)})

    made = spare(docs, "made")
    return (
        docs.withColumn(made, both.asNondeterministic()(F.col(text)))
        .withColumn(ids, F.col(made)["ids"]).withColumn(decoded, F.col(made)["decoded"]).drop(made)
    )


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", model_file: str | None = None) -> DataFrame:
    """Add the column ``out`` with the text of an array of ids; a null array gives the empty text."""
    model = model_file or public_model()
    small_batches(rows.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model)
        for s in batches:
            yield pd.Series(["" if x is None else c.decode([int(i) for i in x]) for x in s], dtype=object)

    return rows.withColumn(out, text(F.col(ids)))


def digests(docs: DataFrame, text: str = "text", out: str = "coded", model_file: str | None = None) -> DataFrame:
    """Add the struct ``out``: n_tokens, ids_sha256, decoded_sha256 of encoding and decoding again."""
    model = model_file or public_model()
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for s in batches:
            rows = []
            for x in s:
                n, ids, back = c.digest(x or "")
                rows.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(out, coded(F.col(text)))
