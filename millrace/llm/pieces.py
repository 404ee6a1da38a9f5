"""SentencePiece encoding and decoding by backtracking over a BPE vocabulary with byte fallback.

The library merges the two neighbours whose joint text is the best piece, the leftmost first, until none are left. As
merges within one token don't depend on those within another, a sequence of tokens is that encoding exactly if every two
neighbours are what merging makes of their joint text. So an encoding is found from left to right: the longest piece
that starts here (an Aho-Corasick automaton finds chains of them) and that stands validly after the token before it; where
none fits, that place has failed for good, since only one valid sequence of tokens leads to it, and the last token gives
way to a shorter one. Failed places are bits of one integer. Between two characters that stand side by side in no piece
nothing is ever merged: texts are cut there, at spaces first, and the ids of chunks and their parts are remembered.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"  # how pieces write a space
#: Chunks and pairs remembered, in two halves of which the older is let go; longer chunks than LONGEST_HELD are encoded each time.
CHUNKS_HELD, PAIRS_HELD, LONGEST_HELD = 500_000, 500_000, 64


class Remembered(dict):
    """The values of `make`, in two halves: what was asked for since the last change of halves, and what was before. Bounded by `most` keys."""

    def __init__(self, make, most: int, longest: int | None = None):
        self.make, self.half, self.longest, self.old = make, most // 2, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if self.longest is not None and len(key) > self.longest:
                return got
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class PieceCodec:
    """Encodes and decodes as the library does, for a model file of the BPE kind with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.control = {i for i in every if sp.is_control(i)}
        self.unknown = sp.unk_id()
        special = self.control | {self.unknown} | {i for i in every if sp.is_byte(i)}
        names = [sp.id_to_piece(i) for i in every]
        self.id = {names[i]: i for i in every if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte_id = {int(names[i][3:5], 16): i for i in every if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.raw = [b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else bytes([self.byte_of[i]]) if i in self.byte_of else names[i].replace(SPACE, " ").encode() for i in every]
        self.starts_spaced = {i for p, i in self.id.items() if p.startswith(SPACE)}
        probe = "".join(chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000)
        self.plain = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.cuts = all(pair[0] == SPACE for pair in self.inside if pair[1] == SPACE)
        self.matcher = ahocorasick.Automaton()
        for p in self.id:
            self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        #: The longest shorter piece that a piece starts with, or else its first character; none for single characters.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), p[0]) for p in self.id if len(p) > 1}
        self.whole = Remembered(lambda p: self.merged(p) == [p], PAIRS_HELD)
        self.fits = Remembered(lambda ab: self.merged(ab[0] + ab[1]) == [*ab], PAIRS_HELD)
        self.parts = Remembered(self._part_ids, CHUNKS_HELD, LONGEST_HELD)
        self.chunks = Remembered(self._chunk_ids, CHUNKS_HELD, LONGEST_HELD)

    def merged(self, text: str) -> list[str]:
        """Merging as defined, for short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def tokens(self, chunk: str) -> list[str]:
        """The encoding of a normalised chunk, as texts of tokens; what is no piece is a token of one character."""
        n = len(chunk)
        longest: dict[int, str] = {}  # by start, along the chains of longest matches that were looked for
        find, fits, shorter = self.matcher.iter_long, self.fits, self.shorter
        out: list[str] = []
        at, failed, last, token = 0, 0, "", ""
        while True:
            if not token:
                token = longest.get(at)
                if token is None:
                    for end, piece in find(chunk, at):
                        start = end + 1 - len(piece)
                        if start in longest:
                            break
                        longest[start] = piece
                    token = longest.setdefault(at, chunk[at])
            end = at + len(token)
            if not failed >> end & 1 and (fits[last, token] if last else self.whole[token]):
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, ""
                continue
            token = shorter.get(token, "")
            while not token:
                failed |= 1 << at
                gone = out.pop()
                at -= len(gone)
                last = out[-1] if out else ""
                token = shorter.get(gone, "")

    def _chunk_ids(self, chunk: str) -> bytes:
        text, inside = SPACE + chunk, self.inside
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inside]
        if not cuts:
            return self._part_ids(text)  # remembered as a chunk
        return b"".join([self.parts[text[i:j]] for i, j in zip([0, *cuts], [*cuts, len(text)])])

    def _part_ids(self, part: str) -> bytes:
        tokens = self.tokens(part)
        try:
            return array("i", map(self.id.__getitem__, tokens)).tobytes()
        except KeyError:
            return array("i", (i for t in tokens for i in self._ids(t))).tobytes()

    def _ids(self, token: str) -> list[int]:
        """A piece's id, or those of the bytes of a character that is no piece."""
        if token in self.id:
            return [self.id[token]]
        return [self.byte_id[b] for b in token.encode()] if self.byte_id else [self.unknown]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, int32."""
        if not text:
            return np.empty(0, np.int32)
        if not self.plain:
            text = self.library.normalize(text).replace(SPACE, " ").removeprefix(" ")
        if not self.cuts:
            parts = [text.replace(" ", SPACE)]
        elif "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            parts = [c[1:] for c in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        else:
            parts = text.split(" ")
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, parts)), np.int32)

    def decode(self, ids) -> str:
        """The text of ids: the space before the first piece goes, and bytes that are no UTF-8 become U+FFFD, one for each."""
        ids = [i for i in ids if i not in self.control]
        joined = b"".join(map(self.raw.__getitem__, ids))
        if ids and ids[0] in self.starts_spaced:
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return self._decode_odd(joined)

    @staticmethod
    def _decode_odd(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


@cache
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _lists(column: pa.ListArray):
    """The lists of a column one by one, so that a batch's numbers aren't all Python objects at a time; null is an empty list."""
    values, ends, there = column.values.to_numpy(), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for at, to, some in zip(ends[:-1].tolist(), ends[1:].tolist(), there, strict=True):
        yield values[at:to].tolist() if some else []


def _arrow(rows: DataFrame, made: str, kind: pa.DataType, spark_kind: str, scan) -> DataFrame:
    """rows (id, x) with x replaced by what scan makes of it, batch by batch."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), scan(batch.column("x")).cast(kind)], ["id", made])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {made} {spark_kind}")


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, ids array<int>, the encoding of the whole text without begin and end ids.

    Defined cases: a null text counts as empty, with no ids; null and repeated ids stay as they are; empty tables give no
    rows; other columns are not read. `path` must be readable on every executor.
    """

    def scan(texts):
        encode = codec(path).encode
        found = [encode(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("x"))
    return _arrow(rows, "ids", pa.list_(pa.int32()), "array<int>", scan).withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of `encoded`: id, text. Null or no ids give an empty text; control ids are left out, the unknown id is shown as the library shows it."""

    def scan(lists):
        decode = codec(path).decode
        return pa.array(map(decode, _lists(lists)), pa.string())

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("x"))
    return _arrow(rows, "text", pa.string(), "string", scan).withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens long, ids_sha256, decoded_sha256: whole texts encoded, and their ids decoded again, one text at a time. Cases as in `encode_pieces`."""

    def scan(batches):
        own = codec(path)
        names = [str(i) for i in range(len(own.raw))]
        for batch in batches:
            n, told, read = [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py()).tolist()
                n.append(len(ids))
                told.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                read.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(read, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
