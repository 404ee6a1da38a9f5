"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on what toxic text says and ordinary text
hardly does. A window is `WINDOW` words, taken every `STEP` words over the whole text. It is compressed with the ordinary
dictionary, and with the toxic one before the same ordinary stretch; the bytes that the second saves are the window's gain.
Each gain has two Poisson rates, per document in toxic text and per window in ordinary text; a document's weight adds up
the log ratios of its distinct windows. Rates, and the threshold of the weight, are calibrated on the labelled sample.

What the toxic dictionary is trained on are the segments (5 to 10 characters) of toxic windows that cover the excess of
toxic text: the segment with the largest log likelihood ratio first, then the next one in the words that are left, as
long as chance does not explain it. Dictionaries are used as raw content, and windows are written in UTF-16, so that a short word's
letters weigh more than the reference that replaces them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

EDGE = ".,!?;:\"'()*#%&$|<>[]{}"
#: Words of a window, and from one window to the next.
WINDOW, STEP = 4, 2
#: Bytes of the ordinary dictionary, and of the toxic one at most.
ORDINARY_BYTES, TOXIC_BYTES = 24 << 10, 6 << 10
#: Lengths of segments; the longest word that gives some (longer ones are scored like others).
SEGMENTS, LONGEST = (5, 6, 7, 8, 9, 10), 64
#: Segments that are weighed on the driver, the best by log likelihood ratio, and windows of a document that train the ordinary dictionary
#: (16 times as many segments at most train the toxic one): bounds of training on the sample, which no score sees.
CANDIDATES, WINDOWS_EACH = 2_000, 12
#: A telling segment is so many times as frequent in toxic contexts as in ordinary ones, at least.
TELLING = 3
LEVEL, GAINS = 12, 24
#: Characters that a window shares with a telling segment if it is to be compressed; segments have one more at least.
PIECE = 4
#: The share of clean documents that are accused counts so many times the share of toxic ones that are missed.
FALSE_ALARM = 2.0


def words(text: str | None) -> list[str]:
    return [w for w in (w.strip(EDGE) for w in (text or "").lower().split()) if w]


def _encode(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def windows(text: str | None) -> list[bytes]:
    """The distinct windows of a text; one for fewer words than a window has, none without words."""
    ws = words(text)
    starts = range(0, max(1, len(ws) - WINDOW + STEP), STEP) if ws else ()
    return [_encode(w) for w in dict.fromkeys(f" {' '.join(ws[i : i + WINDOW])} " for i in starts)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer makes of the samples; the commonest samples themselves where these are too few for it."""
    if len(samples) > 8:
        try:
            return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples, k=24, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(reversed([s for s, _ in Counter(samples).most_common()]))[-size:]


class Model:
    """What training gives: the dictionaries, the rates of gains, the threshold of the weight, and the share of label 1."""

    def __init__(self, ordinary: bytes, toxic: bytes, prior: float, segments: tuple[str, ...] = ()):
        self.ordinary, self.toxic, self.prior, self.segments = ordinary, toxic, prior, segments
        self.rate, self.more, self.cut = np.ones(GAINS + 1), np.zeros(GAINS + 1), 0.0

    def weigh(self, seen: np.ndarray) -> np.ndarray:
        """Sum of log ratios; seen[..., gain]: distinct windows of a document."""
        n = np.maximum(seen.sum(axis=-1), 10)
        return (seen * np.log1p(self.more / (self.rate * n[..., None]))).sum(axis=-1)

    def calibrate(self, toxic: np.ndarray, seen: np.ndarray) -> None:
        """Rates of the gains, and the cut with the least share of missed documents plus FALSE_ALARM times that of accused ones: the middle of the gap there."""
        n = seen.sum(axis=1)
        self.rate = (seen[toxic == 0].sum(axis=0) + 0.5) / (n[toxic == 0].sum() + 1)
        more = seen[toxic == 1].sum(axis=0) - self.rate * n[toxic == 1].sum()
        self.more = np.where((more >= 3) & (np.arange(GAINS + 1) > 0), more, 0) / (toxic == 1).sum()
        weights = self.weigh(seen)
        order = np.argsort(weights, kind="stable")
        w, y = weights[order], toxic[order] == 1
        missed, accused = np.concatenate([[0], np.cumsum(y)]), (~y).sum() - np.concatenate([[0], np.cumsum(~y)])
        cost = missed / max(y.sum(), 1) + FALSE_ALARM * accused / max((~y).sum(), 1)
        edge = np.flatnonzero(w[1:] > w[:-1]) + 1
        if len(edge):
            at = edge[np.argmin(cost[edge])]
            self.cut = float(w[at - 1] + w[at]) / 2
        else:  # no window tells the kinds apart
            self.cut = -math.log(self.prior / (1 - self.prior))


class Gains:
    """Counts of a text's distinct windows by gain, 0 to GAINS.

    Only a window that shares PIECE characters with a telling segment is compressed; an automaton finds these in one pass over
    the text, and the others are counted as if they gained nothing. That is nearly so: of 54,809 windows of 250 documents 14 would gain or lose a byte.
    """

    def __init__(self, model: Model):
        self.pieces = ahocorasick.Automaton()
        for s in model.segments or (model.toxic.decode("utf-16-le", "ignore"),):
            for i in range(max(1, len(s) - PIECE + 1)):
                self.pieces.add_word(s[i : i + PIECE], min(PIECE, len(s)))
        self.pieces.make_automaton()
        # The same length, so that references cost the same.
        self.plain, self.own = self._compressor(bytes(len(model.toxic)) + model.ordinary), self._compressor(model.toxic + model.ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, text: str | None) -> np.ndarray:
        plain, own = self.plain.compress, self.own.compress
        ws = words(text)
        starts = range(0, max(1, len(ws) - WINDOW + STEP), STEP) if ws else ()
        every = {tuple(ws[i : i + WINDOW]) for i in starts}
        near: set[tuple] = set()
        if len(self.pieces) and every:
            whole = f" {' '.join(ws)} "
            begins = np.cumsum([0, *(len(w) + 1 for w in ws)])  # of each word, with the space before it
            hits = np.array([(end - n + 1, end) for end, n in self.pieces.iter(whole)], np.int64).reshape(-1, 2)
            at = np.unique(np.searchsorted(begins, hits, "right") - 1)
            for k in at.tolist():
                for i in range(max(0, (k - WINDOW) // STEP + 1) * STEP, min(k, len(ws) - 1) + 1, STEP):
                    near.add(tuple(ws[i : i + WINDOW]))
            near &= every
        told = [_encode(f" {' '.join(w)} ") for w in near]
        gains = np.fromiter((len(plain(w)) - len(own(w)) for w in told), np.int64, len(told))
        out = np.bincount(np.clip(gains, 0, GAINS), minlength=GAINS + 1)
        out[0] += len(every) - len(told)
        return out


def _contexts(rows: DataFrame) -> DataFrame:
    """(word, toxic, around): distinct neighbours of words in rows (text, toxic). Copies of a text add nothing."""

    def scan(batches):
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                ws = ["", *words(text), ""]
                seen.update((w, toxic, xxhash.xxh3_64_intdigest(f"{a} {b}".encode("utf-8", "surrogatepass")) - (1 << 63)) for a, w, b in zip(ws, ws[1:], ws[2:], strict=False) if 2 < len(w) <= LONGEST)
            cols = list(zip(*seen, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["word", "toxic", "around"])

    return rows.mapInArrow(scan, "word string, toxic int, around bigint").distinct()


def _ratio(c0: np.ndarray, c1: np.ndarray, share: float) -> np.ndarray:
    """Log likelihood ratio of c1 of c0 + c1 against `share`; 0 for what is not telling."""
    q = np.clip(c1 / np.maximum(c0 + c1, 1), 1e-12, 1 - 1e-12)
    return np.where(q * (1 - share) >= TELLING * share * (1 - q), c1 * np.log(q / share) + c0 * np.log((1 - q) / (1 - share)), 0.0)


def telling_segments(spoken: DataFrame) -> list[str]:
    """Segments that cover the excess of toxic contexts; spoken: word, c0, c1, its contexts in ordinary and toxic text."""
    t0, t1 = spoken.agg(F.sum("c0"), F.sum("c1")).first()
    share = (t1 or 0.5) / max((t0 or 0) + (t1 or 0), 1)
    framed = spoken.select("word", "c0", "c1", F.concat(F.lit(" "), "word", F.lit(" ")).alias("s"))
    cut = lambda k: F.when(F.length("s") >= k, F.transform(F.sequence(F.lit(1), F.length("s") - k + 1), lambda i: F.substring(F.col("s"), i, F.lit(k))))
    pieces = F.array_distinct(F.flatten(F.filter(F.array(*[cut(k) for k in SEGMENTS]), lambda x: x.isNotNull())))
    counts = settle(framed.select("c0", "c1", F.explode(pieces).alias("g")).groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    tried = counts.count()
    bound = math.log(tried + 1) + 4  # Chernoff's bound, with as many tries as there are segments
    q = F.col("c1") / (F.col("c0") + F.col("c1"))
    score = F.col("c1") * F.log(q / share) + F.when(F.col("c0") > 0, F.col("c0") * F.log((1 - q) / (1 - share))).otherwise(0.0)
    best = counts.where((F.col("c1") > 2) & (q * (1 - share) >= TELLING * share * (1 - q))).withColumn("score", score).where(F.col("score") > bound).orderBy(F.desc("score"), "g").limit(CANDIDATES)
    names = [r["g"] for r in best.select("g").collect()]
    if not names:
        return []
    # Words that hold the same candidates are one row.
    held = F.array_intersect(pieces, F.array(*map(F.lit, names)))
    rows = framed.select("c0", "c1", F.array_sort(held).alias("held")).where(F.size("held") > 0).groupBy("held").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).collect()
    place, inside = {g: i for i, g in enumerate(names)}, defaultdict(list)
    c0, c1 = np.zeros(len(names)), np.zeros(len(names))
    groups = [([place[g] for g in r["held"]], r["c0"], r["c1"]) for r in sorted(rows, key=lambda r: r["held"])]
    for k, (gs, a, b) in enumerate(groups):
        c0[gs] += a
        c1[gs] += b
        for g in gs:
            inside[g].append(k)
    lengths, kept, left = np.array(list(map(len, names))), [], set(range(len(groups)))
    while sum(len(g) for g in kept) * 2 < TOXIC_BYTES:
        scores = np.where(c1 > 2, _ratio(c0, c1, share), 0.0)
        top = int(np.lexsort((lengths, scores))[-1])
        if scores[top] <= bound:
            break
        kept.append(names[top])
        for k in inside[top]:
            if k in left:
                left.discard(k)
                gs, a, b = groups[k]
                c0[gs] -= a
                c1[gs] -= b
    return kept


def _samples(rows: DataFrame, segments: list[str]) -> tuple[list[bytes], list[bytes]]:
    """Training windows of ordinary rows, at most WINDOWS_EACH of a row, and the telling segments of toxic windows, as often, out of rows (text, toxic)."""

    def scan(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                ws = windows(text)
                if toxic:
                    said = (w.decode("utf-16-le", "surrogatepass") for w in ws)
                    out += [(1, _encode(g)) for s in said for g in segments if g in s][: 16 * WINDOWS_EACH]
                else:
                    out += [(0, w) for w in ws[:: max(1, -(-len(ws) // WINDOWS_EACH))]]
            cols = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["toxic", "sample"])

    got = rows.mapInArrow(scan, "toxic int, sample binary").toPandas().sort_values(["toxic", "sample"])
    return [list(got["sample"][got["toxic"] == k]) for k in (0, 1)]


def _scan(rows: DataFrame, model: Model, keep: str, counts: bool) -> DataFrame:
    """(keep, n, weight) of rows (keep, text): distinct windows and their weight, or with `counts` their number by gain."""

    def scan(batches):
        gains = Gains(model)
        for batch in batches:
            n, out = [], []
            for text in batch.column("text").to_pylist():
                seen = gains.of(text)
                n.append(int(seen.sum()))
                out.append(seen if counts else float(model.weigh(seen)))
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int64()) if counts else pa.float64())], [keep, "n", "weight"])

    kind = rows.schema[keep].dataType.simpleString()
    return rows.select(keep, "text").mapInArrow(scan, f"{keep} {kind}, n bigint, weight {'array<bigint>' if counts else 'double'}")


def train(picked: DataFrame) -> Model:
    """A model from labelled rows (text, toxic 0/1), a bounded sample."""
    n = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    model = Model(b"", b"", (n1 + 1) / (n0 + n1 + 2))
    if not n0 or not n1:
        return model
    spoken = _contexts(picked).groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("c0"), F.count_if(F.col("toxic") == 1).alias("c1"))
    segments = telling_segments(settle(spoken))
    if segments:
        ordinary, toxic = _samples(picked, segments)
        trained = _dictionary(toxic, TOXIC_BYTES)
        left_out = [g for g in map(_encode, segments) if g not in trained]  # the trainer may stop at the commonest
        model = Model(_dictionary(ordinary, ORDINARY_BYTES), b"".join(reversed(left_out)) + trained, model.prior, tuple(segments))
        got = _scan(picked, model, "toxic", True).toPandas()
        model.calibrate(got["toxic"].to_numpy(), np.stack(got["weight"]))
    return model


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(labels: DataFrame, id_col: str, label: Column, sample_rows: int) -> DataFrame:
    """(id, label) of at most sample_rows labelled ids, those with the smallest hashes. Hashes thin the table out before the sort."""
    marks = labels.where(label.isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    marks = settle(marks.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 40))))
    share = min(1.0, 1.2 * sample_rows / max(marks.count(), 1))
    return settle(marks.where(F.col("h") <= F.lit(int(share * (1 << 40)))).orderBy("h", "id").limit(sample_rows).drop("h"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000) -> DataFrame:
    """One row per row of `docs`: id, held_out boolean, score double in [0, 1], predicted int (score >= 0.5), n_windows long, weight double.

    Learns from labelled ids that are not held out, at most sample_rows of them, chosen by a hash of the id; scores see
    the text alone, and all of it. Defined cases: a null or empty text has no windows and weighs nothing; null labels are ignored, and of several
    labels of an id the largest counts; of several texts of a labelled id the smallest teaches; without labels of both kinds every score is the smoothed share of label 1; repeated
    and null ids are scored like others; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labelled_sample(labels.where(~held_out(F.col(id_col))), id_col, F.col(label_col), sample_rows)
    taught = rows.join(F.broadcast(marks), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("toxic"))
    model = train(settle(taught.select("text", "toxic")))
    found = _scan(rows, model, "id", False)
    odds = F.col("weight") - model.cut if model.toxic else F.lit(math.log(model.prior / (1 - model.prior)))
    score = 1 / (1 + F.exp(-odds))
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("n").alias("n_windows"), F.col("weight"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
