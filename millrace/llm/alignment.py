"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often a pair does in the corpus.

Both tokenizers see a space and the text, so their tokens lie on the same bytes. Every stretch between neighbouring token ends, of
either kind, is one link: the pair of tokens that covers it. Pairs are packed into 64-bit keys, B's id above A's. Each text is
tokenized once; its distinct keys are kept beside its numbers, and each partition counts its keys with np.unique. Partial counts are
sorted into key ranges, where equal keys stand side by side and are summed run by run; each range is one shard, a file of keys and
counts in the shared folder, that tasks map into memory and search for the kept keys.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _files, _shared_folder, discard, settle, table
from .token_counts import _byte_letters

SPACE = "▁"
#: Keys that wait until they are counted together, keys of one row of partial counts, texts that are handed on or looked up together.
WAITING, PART, TEXTS = 2_000_000, 50_000, 512
#: From here on Unicode has places that not all versions have filled, and libraries of other ages disagree on what a letter is.
UNSURE = "\u0558"
_SHIFT = 32
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_FINAL = (*_NUMBERS, "n_best", "count_sum")


class Aligner:
    """Tokens and links of texts for a byte-level BPE file (A) and a piece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # special strings in texts are plain text
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec["added_tokens"]}
        plain = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for t, i in plain.items():
            self.a_bytes[i] = t
        #: The same vocabulary in a faster library, which gives the same tokens where both agree on what a letter is.
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={})
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        # Ids as text, followed by each of the three signs.
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{i}{sign}" for sign in ",|;" for i in range(self.width)]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """A's and B's ids of a text; None if a tokenizer doesn't give the space and the text back."""
        if not text:
            return None
        spaced = " " + text
        data = spaced.encode()
        a = self.fast.encode_ordinary(spaced) if text.isascii() or max(text) < UNSURE else self.a.encode(spaced, add_special_tokens=False).ids
        b = self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return a, b

    def links(self, text: str | None) -> tuple[tuple[int, int, int, int], np.ndarray, np.ndarray, str | None]:
        """(n_a, n_b, n_groups, n_links), the distinct keys of the links in order, how often each comes, and the groups as text."""
        found = self.tokens(text)
        if found is None:
            return (0, 0, 0, 0), np.empty(0, np.int64), np.empty(0, np.int64), None
        a, b = (np.array(x, np.int64) for x in found)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        stops = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        last = np.flatnonzero(stops[1:] == stops[:-1])  # a stop of both ends a group
        shared, stops = stops[last], np.delete(stops, last)
        keys = b[np.searchsorted(b_ends, stops)] << _SHIFT | a[np.searchsorted(a_ends, stops)]
        # Groups in a row: A's tokens, then B's. A token comes after all of both kinds in earlier groups, and B's after A's of its own.
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        a_last, b_last = np.searchsorted(a_ends, shared, "right"), np.searchsorted(b_ends, shared, "right")
        told = np.empty(len(a) + len(b), np.int64)
        a_sign, b_sign = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_sign[a_last - 1], b_sign[b_last - 1] = self.width, 2 * self.width
        told[np.arange(len(a)) + np.concatenate([[0], b_last])[a_group]] = a + a_sign
        told[np.arange(len(b)) + a_last[b_group]] = b + b_sign
        said = "".join(map(self.names.__getitem__, told.tolist()))[:-1]
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return (len(a), len(b), len(shared), len(stops)), keys[first], np.diff(first, append=len(keys)), said


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(times), len(found)).astype(np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]), kind))


def _linked(rows: DataFrame, a_path: str, b_path: str, groups: bool) -> DataFrame:
    """A row per row (id, text): id, numbers, digest, its keys and how often each comes; and rows of partial counts in part_keys, part_times."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", *_NUMBERS, "groups_sha256", *["groups"] * groups, "keys", "times", "part_keys", "part_times"]
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in _NUMBERS) + ", groups_sha256 string" + ", groups string" * groups + ", keys array<bigint>, times array<int>, part_keys array<bigint>, part_times array<bigint>"

    def scan(batches):
        own = aligner(a_path, b_path)
        id_kind, waiting, times, size = pa.null(), [], [], 0
        for batch in batches:
            id_kind = batch.schema.field("id").type
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                found = [own.links(t) for t in some.column("text").to_pylist()]
                n, empty = len(found), pa.nulls(len(found), pa.list_(pa.int64()))
                keys, counts = [f[1] for f in found], [f[2] for f in found]
                said = [f[3] for f in found]
                cols = [some.column("id"), *(pa.array([f[0][i] for f in found], pa.int64()) for i in range(4)), pa.array(["" if t is None else hashlib.sha256(t.encode()).hexdigest() for t in said], pa.string())]
                cols += [pa.array([t or "" for t in said], pa.string())] * groups + [_lists(keys, pa.int64()), _lists(counts, pa.int32()), empty, empty]
                yield pa.RecordBatch.from_arrays(cols, names)
                waiting += keys
                times += counts
                size += sum(map(len, keys))
                if size > WAITING:
                    one, its = _summed(waiting, times)
                    waiting, times, size = [one], [its], 0 if len(one) < WAITING // 2 else size
                    if size:  # so many distinct pairs: they are told now
                        yield from told(one, its, id_kind)
                        waiting, times, size = [], [], 0
        if waiting:
            yield from told(*_summed(waiting, times), id_kind)

    def told(keys, times, id_kind):
        cuts = range(0, len(keys), PART)
        n = len(cuts)
        if n:
            cols = [pa.nulls(n, id_kind), *[pa.nulls(n, pa.int64())] * 4, *[pa.nulls(n, pa.string())] * (1 + groups), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, *(_lists([x[i : i + PART] for i in cuts], pa.int64()) for x in (keys, times))], names)

    return rows.mapInArrow(scan, schema)


def _runs_summed(batches):
    """Sorted batches of (key, n) as sorted arrays with each key once; a run may go over batches."""
    key, n = None, 0
    for batch in batches:
        keys, counts = (batch.column(c).to_numpy() for c in ("key", "n"))
        if not len(keys):
            continue
        if key is not None:
            keys, counts = np.concatenate([[key], keys]), np.concatenate([[n], counts])
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        sums = np.add.reduceat(counts, first)
        key, n = int(keys[-1]), int(sums[-1])
        yield keys[first][:-1], sums[:-1]
    if key is not None:
        yield np.array([key]), np.array([n])


class Shards:
    """Counts of keys in shard files: rows (uri, first, last, size) in key order."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.rows = sorted(rows, key=lambda r: r[1])
        self.firsts = np.array([r[1] for r in self.rows], np.int64)

    def _open(self, uri: str, size: int) -> np.ndarray:
        """Keys and counts of a shard: mapped where its folder is mounted, else read; one shard at a time is held."""
        fs, path = pa.fs.FileSystem.from_uri(uri)
        if isinstance(fs, pa.fs.LocalFileSystem):
            return np.memmap(path, np.int64, "r", shape=(2, size))
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), np.int64).reshape(2, size)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys; 0 for those that no shard has."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(keys, self.firsts)
        for (uri, _, _, size), at, to in zip(self.rows, cuts, [*cuts, len(keys)][1:], strict=True):
            if at < to:
                held = self._open(uri, size)
                where = np.minimum(np.searchsorted(held[0], keys[at:to]), size - 1)
                out[at:to] = np.where(held[0][where] == keys[at:to], held[1][where], 0)
        return out


def _written_shards(partial: DataFrame, folder: str) -> DataFrame:
    """(uri, first, last, size, b_ids, b_best): a row per shard file that was written, with the highest count of each of its B ids."""

    def scan(batches):
        lots = list(_runs_summed(batches))  # of distinct pairs in one key range
        if not lots:
            return
        keys, counts = np.concatenate([k for k, _ in lots]), np.concatenate([n for _, n in lots])
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.counts"  # each attempt has its own; only a finished one's row is kept
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(keys.astype(np.int64).tobytes())
            f.write(counts.astype(np.int64).tobytes())
        b_ids, first = np.unique(keys >> _SHIFT, return_index=True)
        row = [[f"{folder}/{name}"], [int(keys[0])], [int(keys[-1])], [len(keys)], [b_ids.tolist()], [np.maximum.reduceat(counts, first).tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["uri", "first", "last", "size", "b_ids", "b_best"])

    ranged = partial.repartitionByRange("key").sortWithinPartitions("key")
    return ranged.mapInArrow(scan, "uri string, first bigint, last bigint, size bigint, b_ids array<bigint>, b_best array<bigint>")


def _kept(df: DataFrame) -> DataFrame:
    """settle, with a denser codec: these are mostly sorted numbers."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/millrace-links-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _files(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256; with `groups` also their text.

    A is a byte-level BPE file, B a piece model that puts a space in front; both must be readable on every executor. A link's count is
    how often its pair of ids is linked in all of `docs`; n_best are links whose count is the highest of their B id. Texts are read and
    tokenized once; their distinct keys wait in the shared folder, until the session ends, for the counts of all. Defined cases: null and empty texts, and texts that a
    tokenizer doesn't give back byte for byte, have no tokens, zeros and an empty digest, and count for nothing; null and repeated ids stay as they
    are, and each repeated row counts; empty tables give no rows; other columns are not read. What the driver
    holds is one row per shard, at most one per shuffle partition, and one count per B id.
    """
    spark = docs.sparkSession
    linked = _kept(_linked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), a_path, b_path, groups))
    partial = linked.where("part_keys IS NOT NULL").select(F.inline(F.arrays_zip(F.col("part_keys").alias("key"), F.col("part_times").alias("n"))))
    folder = f"{_shared_folder(spark)}/millrace-shards-{uuid.uuid4().hex}"
    folder = folder if ":/" in folder else f"file://{folder}"
    fs, at = _files(spark, folder)
    fs.deleteOnExit(at)
    written = settle(_written_shards(partial, folder))
    shards = Shards([tuple(r) for r in written.select("uri", "first", "last", "size").collect()])
    best = {r[0]: r[1] for r in written.select(F.inline(F.arrays_zip("b_ids", "b_best"))).groupBy("b_ids").agg(F.max("b_best")).collect()}
    discard(written)
    top = np.zeros(max(best, default=0) + 1, np.int64)
    top[list(best)] = list(best.values())
    told = ["groups_sha256", *["groups"] * groups]

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                lists = some.column("keys")
                keys, times, ends = lists.flatten().to_numpy(), some.column("times").flatten().to_numpy(), lists.offsets.to_numpy()
                distinct, where = np.unique(keys, return_inverse=True)
                count = shards(distinct)
                good = count == top[distinct >> _SHIFT]
                sums = (np.concatenate([[0], np.cumsum(x[where] * times)]) for x in (good, count))
                made = [x[ends[1:] - ends[0]] - x[ends[:-1] - ends[0]] for x in sums]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("id", *_NUMBERS)), *(pa.array(m, pa.int64()) for m in made), *(some.column(c) for c in told)], ["id", *_FINAL, *told])

    rows = linked.where("part_keys IS NULL").select("id", *_NUMBERS, *told, "keys", "times")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"id {kind}, " + ", ".join(f"{c} bigint" for c in _FINAL) + "".join(f", {c} string" for c in told))
    return found.withColumnRenamed("id", id_col)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
