"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are what BPE makes of their bytes
together. So each prefix of a piece has one last token, the one that ends there, that is its own encoding and that stands
validly after the last token of the prefix before it; its count is one more than that prefix's. Counts of pieces (what
the pre-tokenizer cuts a text into) are remembered, and a text's counts are their running sum. With the counts of all
prefixes, truncation to a budget and token counts of any prefix need no encoding.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PIECES_HELD, CHUNKS_HELD, PAIRS_HELD = 200_000, 400_000, 500_000
#: Characters of the longest chunk or piece that is remembered; longer ones are counted each time, so that caches are bounded in bytes too.
LONGEST_HELD = 64
NO_PAIR = 1 << 60
#: Bits of a token's number in a pair of them; vocabularies are far smaller.
NUMBER_BITS = 32
#: Last bytes of a token by which its length is looked up, and the lengths of tokens without so many.
TAIL = 4
SHORT = (3, 2, 1)
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _unassigned() -> re.Pattern:
    """Characters that Python's Unicode data doesn't know. Libraries of other ages disagree on their kind."""
    spans, start = [], None
    for c in range(0x80, sys.maxunicode + 2):
        new = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if new and start is None:
            start = c
        elif not new and start is not None:
            spans.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return re.compile(f"[{''.join(spans)}]")


class _Chunks(dict):
    """Token counts of a space and what follows it up to the next one, remembered until there are too many."""

    def __init__(self, count: PrefixCounter):
        self.count = count

    def __missing__(self, chunk: str) -> int:
        spaced = " " + chunk
        if chunk.isascii() and chunk.isalpha():
            n = self.count.byte_prefixes(spaced.encode())[-1]  # one piece, remembered here alone
        else:
            n = sum(self.count.piece(p)[-1] for p in self.count.cut(spaced))
        if len(chunk) <= LONGEST_HELD:
            if len(self) > CHUNKS_HELD:
                self.clear()
            self[chunk] = n
        return n


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes, for a tokenizer file of the byte-level BPE kind."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        plain = lambda t: bytes(letters[c] for c in t)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.library = Tokenizer.from_file(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(plain(a), plain(b)): i for i, (a, b) in enumerate(merges)}
        self.made: dict[bytes, tuple[bytes, bytes, int]] = {}
        for (a, b), i in self.rank.items():
            self.made.setdefault(a + b, (a, b, i))
        self.tokens = [plain(t) for t in spec["model"]["vocab"]]
        #: Numbers of the tokens that BPE makes of their own bytes; ~number where that is not known yet.
        self.numbers = {t: ~i for i, t in enumerate(self.tokens)}
        #: Lengths, falling, that tokens with these last TAIL bytes may have; with others they are shorter.
        self.lengths = {}
        for t in self.tokens:
            if len(t) >= TAIL:
                self.lengths.setdefault(t[-TAIL:], set()).add(len(t))
        self.lengths = {tail: (*sorted(ns, reverse=True), *SHORT) for tail, ns in self.lengths.items()}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks = _Chunks(self)

    def encode(self, data: bytes) -> list[bytes]:
        """BPE as defined: the pair of lowest rank is merged, the leftmost first, until no pair is left. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get((parts[i], parts[i + 1]), NO_PAIR), i) for i in range(len(parts) - 1))
            if best == NO_PAIR:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _own(self, token: bytes) -> int | None:
        """The number of a token if BPE makes one token of its bytes; else it is none from here on."""
        number = ~self.numbers.pop(token)
        if self.encode(token) != [token]:
            return None
        self.numbers[token] = number
        return number

    def _fits(self, pair: int) -> bool:
        """Whether BPE makes a, b, a pair of numbers, of their bytes together: backwards in time, no merge over the border came before the merge undone last."""
        if len(self.pairs) > PAIRS_HELD:
            self.pairs.clear()
        x, y, before = self.tokens[pair >> NUMBER_BITS], self.tokens[pair & (1 << NUMBER_BITS) - 1], NO_PAIR
        while (self.rank.get((x, y), NO_PAIR)) >= before:
            left, right = self.made.get(x), self.made.get(y)
            if left is None and right is None:
                self.pairs[pair] = True
                return True
            if right is None or (left is not None and left[2] > right[2]):
                x, before = left[1], left[2]  # of equal ranks the left merge comes first: x's before the border's ...
            else:
                y, before = right[0], right[2] + 1  # ... and the border's before y's
        self.pairs[pair] = False
        return False

    def byte_prefixes(self, data: bytes) -> list[int]:
        """Token counts of all prefixes of a piece, from the empty one to the whole."""
        last, count = [0], [0]
        number_of, known, lengths, fits = self.numbers.get, self.pairs.get, self.lengths.get, self._fits
        for end in range(1, len(data) + 1):
            for n in lengths(data[end - TAIL : end], SHORT) if end >= TAIL else SHORT[TAIL - 1 - end :]:
                start = end - n
                if start < 0:
                    continue
                token = number_of(data[start:end])
                if token is None or token < 0 and (token := self._own(data[start:end])) is None:
                    continue
                if start:
                    good = known(pair := last[start] << NUMBER_BITS | token)
                    if not (fits(pair) if good is None else good):
                        continue
                last.append(token)
                count.append(count[start] + 1)
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count

    def piece(self, text: str) -> tuple[int, ...]:
        """Token counts of the prefixes of a piece, by code point."""
        got = self.pieces.get(text)
        if got is None:
            counts = self.byte_prefixes(text.encode())
            if len(counts) > len(text) + 1:
                ends = [0]
                for c in text:
                    ends.append(ends[-1] + len(c.encode()))
                counts = [counts[e] for e in ends]
            got = tuple(counts)
            if len(text) <= LONGEST_HELD:
                if len(self.pieces) > PIECES_HELD:
                    self.pieces.clear()
                self.pieces[text] = got
        return got

    def cut(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if not text.isascii() and max(text) >= "՘" and _unassigned().search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.split.findall(text)

    def _segments(self, text: str) -> Iterator[tuple[str, str]]:
        """Ordinary stretches, each with the special string that follows it, or an empty one."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], m[0]
            at = m.end()
        yield text[at:], ""

    def total(self, text: str) -> int:
        """Tokens of a text: the last entry of `prefixes`, summed from the counts of its pieces.

        Where each space stands before something else than white space, no piece goes over a space but at its start, and
        whole chunks are looked up.
        """
        n = 0
        for part, special in self._segments(text):
            if part and not LOOSE_SPACE.search(part):
                first, *rest = part.split(" ")
                n += sum(map(self.chunks.__getitem__, rest)) + sum(self.piece(p)[-1] for p in self.cut(first))
            else:
                n += sum(self.piece(p)[-1] for p in self.cut(part))
            n += bool(special)
        return n

    def prefixes(self, text: str) -> list[int]:
        """Tokens of text[:i] for i from 0 to len(text).

        A prefix is cut as the text is, but for its end: white space that a word follows is one piece while it ends the
        prefix, and half a contraction is a quote and a letter.
        """
        out, base = [0], 0
        for part, special in self._segments(text):
            whole = sum(self.piece(p)[-1] for p in self.cut(part))
            before, run = base, ""
            for p in self.cut(part + special[:-1]):
                counts = [before + c for c in self.piece(p)]
                if run and p[0].isspace():
                    counts[1] = before - self.piece(run)[-1] + self.piece(run + p[0])[-1]
                if p in ("'re", "'ve", "'ll"):
                    counts[2] = before + self.piece("'")[-1] + self.piece(p[1])[-1]
                out += counts[1:]
                before += self.piece(p)[-1]
                run = p if p.isspace() else ""
            base += whole
            if special:
                base += 1
                out.append(base)
        return out

    def fitting(self, text: str, budget: int) -> int:
        """Length of the longest prefix that, with all shorter ones, keeps to a budget of tokens."""
        most, run = [], 0
        for n in self.prefixes(text):
            run = max(run, n)
            most.append(run)
        return bisect_right(most, budget) - 1


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, prefixes: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_tokens long, over_limit boolean; with `prefixes` also prefix_tokens array<int>.

    Counts are those of the tokenizer file's library without added tokens; special strings in a text count as its default
    has them. prefix_tokens[i] is the count of the text's first i code points. Defined cases: a null text counts as empty, with 0
    bytes and tokens; null and repeated ids stay as they are; empty tables give no rows; other columns are not read.
    `path` must be readable on every executor.
    """

    def scan(batches):
        count = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = [count.prefixes(t) for t in texts] if prefixes else None
            cols = [batch.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([g[-1] for g in got] if prefixes else [count.total(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(got, pa.list_(pa.int32()))] if prefixes else []), ["id", "n_bytes", "n_tokens", *["prefix_tokens"] * prefixes])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"id {kind}, n_bytes bigint, n_tokens bigint" + ", prefix_tokens array<int>" * prefixes)
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *["prefix_tokens"] * prefixes)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
