"""Quality by importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two generative models count hashed n-grams: one those of documents labelled as good (the target), one those of all
documents (the raw text). N-grams are the single words and the pairs of neighbouring words of a text, and the pairs of
neighbours in two coarser readings of it: shapes (case, digits, signs, length) and how far back a word occurred before. A
document's ratio is the mean log ratio of its n-grams under the two models, a word. Words of a text are no independent
draws, so a ratio of products overstates what is known; two numbers fitted on the labelled sample (a logistic regression of
the label on ratio and length) turn it into the chance that the document is of the target, which is the importance weight
of target over raw text but for a constant. k is the sum of these chances over all documents: how many documents of the target there are.
Gumbel noise at temperature 1 is added to the log weights, and the k largest sums are k draws without replacement in
proportion to the weights.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .toxicity import labelled_sample

#: Hash buckets of words, of pairs of words, of pairs of shapes, of pairs of distances.
WORDS, PAIRS, SHAPES, BACKS = 1 << 14, 1 << 16, 1 << 12, 64
READINGS = ((0, WORDS), (WORDS, WORDS + PAIRS), (WORDS + PAIRS, WORDS + PAIRS + SHAPES), (WORDS + PAIRS + SHAPES, WORDS + PAIRS + SHAPES + BACKS))
SIZE = READINGS[-1][1]
#: Distances back, in words, are told apart at these.
STEPS = np.array((1, 2, 5, 17, 65))
#: Words beyond which a document's length adds no evidence.
EVIDENCE = 10_000
#: Bins of a histogram; words that a task remembers, and their length: longer ones are worked out anew.
BINS, WORDS_HELD, LONGEST_HELD = 4096, 300_000, 64


class _Seen(dict):
    """Of a word: a number that holds its hash (32 bits) and its shape (12 bits)."""

    def __missing__(self, word: str) -> int:
        core = word.strip(".,;:!?\"'()")
        case = 0 if core.islower() else 1 if core.istitle() else 2 if core.isupper() and len(core) > 1 else 3 if any(map(str.isalpha, core)) else 4
        signs = sum(not c.isalnum() for c in word)
        tail = 0 if word[-1:].isalnum() else 1 + ",.;:!?".find(word[-1:]) + 1
        shape = (((case * 8 + tail) * 4 + min(signs, 3)) * 2 + any(map(str.isdigit, word))) * 4 + min(len(core) // 6, 3)
        got = zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) << 12 | shape
        if len(word) <= LONGEST_HELD:
            if len(self) > WORDS_HELD:
                self.clear()
            self[word] = got
        return got


def features(text: str | None, seen: dict) -> np.ndarray:
    """Bucket numbers of the n-grams of a text, four a word; the first word stands after none."""
    ws = (text or "").split()
    if not ws:
        return np.empty(0, np.int64)
    both = np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))
    word, shape = both >> 12, both & 4095
    # How far back the same word is: neighbours in a stable order by word.
    order = np.argsort(word, kind="stable")
    again = np.flatnonzero(word[order[1:]] == word[order[:-1]])
    back = np.full(len(ws), 6)
    back[order[again + 1]] = np.searchsorted(STEPS, order[again + 1] - order[again])
    before = lambda x, first: np.concatenate([[first], x[:-1]])
    pairs = (before(word, 0) * 1_000_003 + word * 7_919 >> 7) % PAIRS
    shapes = (before(shape, 4095) * 1_000_003 + shape * 7_919) % SHAPES
    return np.concatenate([word % WORDS, WORDS + pairs, WORDS + PAIRS + shapes, WORDS + PAIRS + SHAPES + before(back, 7) * 8 + back])


def _counts(rows: DataFrame, good: frozenset) -> np.ndarray:
    """[model, bucket]: n-grams of all rows (id, text), and of those whose id is in `good`. SIZE counts for a task and model come in."""

    def scan(batches):
        seen, total = _Seen(), np.zeros((2, SIZE), np.int64)
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = np.bincount(features(text, seen), minlength=SIZE)
                total[0] += got
                if i in good:
                    total[1] += got
        model, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(model, pa.int64()), pa.array(bucket, pa.int64()), pa.array(total[model, bucket], pa.int64())], ["model", "bucket", "n"])

    out = np.zeros((2, SIZE), np.int64)
    for r in rows.mapInArrow(scan, "model bigint, bucket bigint, n bigint").groupBy("model", "bucket").agg(F.sum("n").alias("n")).collect():
        out[r["model"], r["bucket"]] = r["n"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log target / raw of each bucket, both models smoothed within each reading."""
    out = np.zeros(SIZE)
    for a, b in READINGS:
        raw, target = counts[0, a:b] + 1.0, counts[1, a:b] + 1.0 * counts[1, a:b].sum() / max(counts[0, a:b].sum(), 1)
        out[a:b] = np.log(np.maximum(target, 1e-9) / max(target.sum(), 1e-9)) - np.log(raw / raw.sum())
    return out


def _scores(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(id, n_words, score) of rows (id, text); score: log ratios of a text's n-grams, a word."""

    def scan(batches):
        seen = _Seen()
        for batch in batches:
            n, score = [], []
            for text in batch.column("text").to_pylist():
                got = features(text, seen)
                n.append(len(got) // len(READINGS))
                score.append(float(ratios[got].sum()) / n[-1] if len(got) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["id", "n_words", "score"])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, score double")


def inputs(score: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the label is regressed on: evidence grows with the root of the words, as neighbours repeat what is known."""
    root = np.sqrt(np.minimum(n, EVIDENCE))
    return np.stack([score * root, root, np.ones(len(score))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Coefficients of a logistic regression by Newton's method; the ridge keeps those of separable samples finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """A cut that as good as k values reach, found by histograms within histograms: no sort, and BINS counts to the driver a round."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None or k <= 0:
        return math.inf
    above = 0
    for _ in range(5):
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            break
        bins = df.where(F.col(col).between(lo, hi)).groupBy(F.least(F.floor((F.col(col) - lo) / width), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if above + r["count"] >= k:
                lo, hi = lo + r["bin"] * width, lo + (r["bin"] + 1) * width
                break
            above += r["count"]
        if above + r["count"] == k:
            break
    return lo


def gumbel_top(weighed: DataFrame, log_weight: str, k: int, *salt: str) -> DataFrame:
    """weighed with `key`, its log weight plus Gumbel noise drawn from a hash of the salt columns, and `kept`, whether the key is among the k largest; null weights never are."""
    noise = -F.log(-F.log((F.pmod(F.xxhash64(*salt), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    keyed = weighed.withColumn("key", F.col(log_weight) + noise)
    least = kth_largest(keyed, "key", k) if k > 0 else math.inf
    return keyed.withColumn("kept", F.coalesce(F.col("key") >= least, F.lit(False)))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, k: int | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_words long, score, log_weight, key double, kept boolean.

    The target model is fitted on the labelled rows' good documents, at most sample_rows labelled ids, chosen by a hash
    of the id; the raw model on all documents. score is the mean log ratio, log_weight the log of the chance that the document is of the
    target; key adds Gumbel noise drawn from a hash of id, words and score. k documents are kept, by default as many as the chances add up to. Rows
    with one key are kept or dropped together. Defined cases: texts without words and null texts
    have no score and are dropped; null labels are ignored, of several the smallest counts; a label holds for all texts of its id, of
    which the one with the smallest score calibrates; without both labels in the
    sample all texts with words are kept, unless k is given; null and repeated ids are scored like others; empty tables give no rows; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labelled_sample(labels, id_col, -F.col(label_col), sample_rows).select("id", (-F.col("label")).alias("good"))
    good = frozenset(r["id"] for r in marks.where("good = 1").collect())
    scored = settle(_scores(rows, log_ratios(_counts(rows, good))))
    known = scored.where("score IS NOT NULL").join(F.broadcast(marks), "id").groupBy("id").agg(F.min(F.struct("score", "n_words")).alias("s"), F.min("good").alias("good"))
    known = known.select("s.*", "good").toPandas()
    if known["good"].nunique() == 2:
        a, b, c = map(float, logistic(inputs(known["score"].to_numpy(), known["n_words"].to_numpy(float)), known["good"].to_numpy(float)))
        root = F.sqrt(F.least("n_words", F.lit(EVIDENCE)))
        odds = a * F.col("score") * root + b * root + c
        # log of 1 / (1 + exp(-odds)), without overflow
        log_weight = F.when(odds > 0, -F.log1p(F.exp(-odds))).otherwise(odds - F.log1p(F.exp(odds)))
    else:
        log_weight = F.when(F.col("score").isNotNull(), 0.0)
    weighed = scored.withColumn("log_weight", log_weight)
    if k is None:
        k = round(weighed.agg(F.sum(F.exp("log_weight"))).first()[0] or 0)
    return gumbel_top(weighed, "log_weight", k, "id", "n_words", "score").select(F.col("id").alias(id_col), "n_words", "score", "log_weight", "key", "kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
