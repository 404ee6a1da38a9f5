"""Secret scan: fixed patterns, and random strings that a tokenizer gives away.

A vocabulary learned from text needs few tokens for what people write and many for what a generator wrote. Runs of
letters, digits and signs that take a token for every one or two characters, though they mix kinds of characters as
keys do, are reported besides the patterns' matches. Digests and identifiers are of that kind too but no secrets; they are
told by their form and left out. Letters of one case alone have to be longer and have a lower ratio: words that a vocabulary
hardly knows take nearly as many tokens as random letters do. All bounds are parameters.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds, in the order of equal starts. The first three are the base.
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run too short as a whole has no part that is long enough, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Runs, runs with the punctuation of passwords in them, what may end a sentence or frame a word, and what parts them.
PLAIN, MIXED = r"[A-Za-z0-9+/_=-]{{{},}}+", r"[A-Za-z0-9+/_=.!?@#$%^&*~-]{{{},}}+"
EDGE = ".!?@#$%^&*~"
PART = re.compile(rf"[{re.escape(EDGE)}]+")
#: Forms of digests (md5, sha-1, sha-224, sha-256, sha-384, sha-512 in hex, and the prefixed forms of lock files) and of identifiers.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|sha(?:1|256|384|512)[-_][A-Za-z0-9+/]+=*)\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
WORDS = re.compile(r"[A-Za-z]?[a-z]*(?:[_/+=-]+[A-Za-z]?[a-z]+|[_/+=-]+[A-Z]+|[A-Z][a-z]{2,})*[_/+=-]*\d{0,4}\Z|[A-Z]+(?:[_/+=-]+[A-Z]+)*[_/+=-]*\d{0,4}\Z|[\d/_+=-]+\Z")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches, leftmost and not overlapping within a kind, by start and kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Scan:
    """The method's bounds: characters a token that random runs stay under, their least length, and both for letters of one case alone."""

    def __init__(self, encoder, ratio: float = 2.2, least: int = 8, one_case_ratio: float = 1.9, one_case_least: int = 20):
        self.encoder, self.ratio, self.least, self.one_case = encoder, ratio, least, (one_case_ratio, one_case_least)
        self.plain, self.mixed = re.compile(PLAIN.format(least)), re.compile(MIXED.format(least))

    def known(self, run: str) -> bool:
        """Whether a run has a form that is no secret's: a digest, an identifier, words and numbers, or a short word."""
        if run.isalpha() and (run.islower() or run.isupper()):
            return len(run) < self.one_case[1]
        kinds = sum((any(c.isdigit() for c in run), any(c.islower() for c in run), any(c.isupper() for c in run)))
        return kinds < 2 or any(form.match(run) for form in (DIGEST, UUID, WORDS))

    def random(self, run: str) -> bool:
        ratio = self.one_case[0] if run.isalpha() and (run.islower() or run.isupper()) else self.ratio
        return len(run) < ratio * len(self.encoder.encode_ordinary(run))

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Runs that are random, of no known form, and touch no span taken.

        A run with punctuation counts as a whole if one of its parts is of no known form, and by its runs without punctuation otherwise.
        """
        out = []
        starts = sorted(taken)  # spans of different kinds may overlap; the furthest end so far tells whether one reaches a place
        ends = list(accumulate((e for _, e, _ in starts), max))
        begins = [s for s, _, _ in starts]

        def add(start: int, end: int) -> bool:
            before = bisect_left(begins, end)
            if (before == 0 or ends[before - 1] <= start) and self.random(text[start:end]):
                out.append((start, end, "random"))
                return True
            return False

        for m in self.mixed.finditer(text):
            start, end = m.span()
            core = m[0].strip(EDGE)
            if len(core) >= self.least:
                start += m[0].index(core)
                end = start + len(core)
            whole = text[start:end]
            parts = [p for p in PART.split(whole) if p]
            if PART.search(whole) and not whole.startswith("//") and not all(map(self.known, parts)) and add(start, end):
                continue
            for c in self.plain.finditer(text, start, end):
                if not self.known(c[0]):
                    add(*c.span())
        return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """One row per row of `docs`: id, n_assign, n_access, n_hex, n_random long, base_sha256, spans string.

    spans lists kind:start:end of all spans in code points, end exclusive, by start and then kind; base_sha256 is of the list
    of base spans alone. A span is a pattern's whole match. `path` is a tiktoken vocabulary that executors can read; a run of 8 characters
    and more is random with fewer than 2.2 characters a token, letters of one case alone from 20 characters on with fewer than 1.9; `bounds` sets others (see Scan). Defined cases: null texts count as empty, which have no spans; null and
    repeated ids stay as they are; empty tables give no rows; columns other than id and text are not read.
    """

    def scan(batches):
        scanner = Scan(_encoder(path), **bounds)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                added = scanner.spans(text or "", base)
                every = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else base
                for col, kind in zip(cols, KINDS, strict=False):
                    col.append(sum(s[2] == kind for s in every))
                cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols[5].append(_joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], ["id", *names])

    names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
