"""Near-duplicates: MinHash with banding, signature verification, exact confirmation and connected components.

1. Each text becomes its set of word shingles, as 64-bit hashes. Texts with one and the same set are a class, and only
   the class goes on, as its smallest id; copies cost nothing from there.
2. `bands * rows` universal hash minima are a class's signature. Classes that agree in a whole band share a bucket. In a
   bucket, classes whose signatures agree in `threshold` minus five standard deviations of the places are tied, and ties
   joined into clusters.
3. Inside a cluster the full sets are compared, and what passes is linked. Components of the links are the result.

Steps 2 and 3 both look for components inside groups that may be large. `_forest` never compares what is joined already,
so that a group of near copies costs about its own length, and it gives a star for each component, not pairs. A group too large
for a task is cut into chunks that share a few leaders, which joins most of it in one pass. What that leaves in several
components goes on: where a main component holds half of the rows, those outside it are compared with all chunks; a group without one is
dealt anew by its other bands first, of which two texts that are alike share some.
A band's group that is compared whole needs no second deal, so that only rows that share two bands' groups without a main component meet again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, small, table
from .graph import components

#: Rows and bytes of a chunk of a group, and the leaders that all chunks of it share.
CHUNK_ROWS, CHUNK_BYTES, LEADERS = 224, 24 << 20, 24


#: Words that a task remembers, and the bytes of the longest of them.
WORDS_HELD, LONGEST_HELD = 250_000, 64


class _Words(dict):
    """Hashes of words, remembered until there are too many; long words are hashed each time."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_HELD:
            if len(self) >= WORDS_HELD:
                self.clear()
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, k: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text; of all its words at once if it has fewer; none without words."""
    found = text.lower().split() if text else []  # bytes: A-Z only, and white space of ASCII only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=k)], np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = _mix(out) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out))


class MinHasher:
    """Minima of universal hashes (multiply, add, take the upper half) of 64-bit values."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        least = None
        for i in range(0, len(values), 1024):
            part = values[i : i + 1024] * self.a
            part += self.b
            m = part.min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return (least >> np.uint64(32)).astype("<u4")


def _set_key(values: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(values.tobytes())
    return (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63


def _sketches(docs: DataFrame, k: int, hashes: int) -> DataFrame:
    """(id, n, k1, k2, sig) of docs (id, text)."""

    def scan(batches):
        words, minhash = _Words(), MinHasher(hashes)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            n, k1, k2, sig = [], [], [], []
            for text in texts:
                s = shingle_set(text.as_py(), k, words)
                a, b = _set_key(s)
                n.append(len(s)), k1.append(a), k2.append(b), sig.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "k1", "k2", "sig"])

    return docs.mapInArrow(scan, "id bigint, n bigint, k1 bigint, k2 bigint, sig binary")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, text, k1, k2, ...) with the text and k1, k2 replaced by `data`, the set's hashes, where the text has the set that k1, k2 name."""
    keep_cols = [c for c in rows.columns if c not in ("text", "k1", "k2")]

    def scan(batches):
        words, seen = _Words(), set()
        for batch in batches:
            keep, data = [], []
            for i, (text, *key) in enumerate(zip(batch.column("text").cast(pa.binary()), *(batch.column(c).to_pylist() for c in ("id", "k1", "k2")), strict=True)):
                if tuple(key) in seen:  # repeated rows
                    continue
                s = shingle_set(text.as_py(), k, words)
                if _set_key(s) == tuple(key[1:]):  # an id may occur with other texts too
                    seen.add(tuple(key))
                    keep.append(i), data.append(s.tobytes())
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep_cols), pa.array(data, pa.binary())], [*keep_cols, "data"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep_cols)
    return rows.mapInArrow(scan, f"{kinds}, data binary")


def _forest(labels: np.ndarray, linked) -> list[tuple[int, int]]:
    """(row, first row of its component). Rows with one label are joined already; linked(i, others) tells which others row i links to."""
    left, out = np.arange(len(labels)), []
    while len(left):
        root, stack, left = left[0], [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = labels[left] == labels[i]
            if hit.any():
                stack.extend(left[hit])
                out.extend((j, root) for j in left[hit])
                left = left[~hit]
            if len(left):
                hit = linked(i, left)
                out.extend((j, root) for j in left[hit])
                stack.extend(left[hit])
                left = left[~hit]
    return out


def _by_signature(n: np.ndarray, data: list[bytes], percent: int, hashes: int):
    sig, share = np.frombuffer(b"".join(data), "<u4").reshape(len(n), hashes), percent / 100
    floor = math.floor((share - 5 * math.sqrt(share * (1 - share) / hashes)) * hashes)

    def linked(i, others):
        size_ok = 100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])
        return size_ok & ((sig[others] == sig[i]).sum(axis=1) >= floor)

    return linked


def _by_set(n: np.ndarray, data: list[bytes], percent: int, hashes: int):
    every = np.frombuffer(b"".join(data), np.uint64)
    ids = np.unique(every, return_inverse=True)[1]
    ends = np.cumsum(n)
    starts, flag = ends - n, np.zeros(len(every), np.int32)

    def linked(i, others):
        mine = ids[starts[i] : ends[i]]
        flag[mine] = 1
        if 4 * len(others) > len(n):
            common = np.add.reduceat(flag[ids], starts)[others]
        else:
            common = np.array([flag[ids[starts[j] : ends[j]]].sum() for j in others])
        flag[mine] = 0
        return 100 * common >= percent * (n[i] + n[others] - common)

    return linked


def _link_groups(rows: DataFrame, keys: list[str], kernel, percent: int, hashes: int) -> DataFrame:
    """Links (u, v), stars, of the rows (id, n, data, label) of each group of `keys`; a task holds one group at a time."""

    def link(ids, n, labels, data):
        if len(ids) < 2 or (labels == labels[0]).all():
            return []
        return [(ids[i], ids[j]) for i, j in _forest(labels, kernel(n, data, percent, hashes))]

    def scan(batches):
        held, held_data = None, []  # of the last group seen, which the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "id", "n", "label")])
            now, data = (now, batch.column("data").to_pylist()) if held is None else (np.hstack([held, now]), held_data + batch.column("data").to_pylist())
            cuts = np.flatnonzero((now[: len(keys), 1:] != now[: len(keys), :-1]).any(axis=0)) + 1
            found, start = [], 0
            for end in cuts.tolist():
                if end - start > 1:
                    ids, n, labels = now[len(keys) :, start:end]
                    found += link(ids, n, labels, data[start:end])
                start = end
            held, held_data = now[:, start:], data[start:]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])
        if held is not None:
            found = link(*held[len(keys) :], held_data)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    order = [*keys, *(["late"] if "late" in rows.columns else []), "id"]
    wide = rows.select(*[F.col(k).cast("long").alias(k) for k in keys], *order[len(keys) : -1], "id", "n", "label", "data")
    return wide.repartition(*keys).sortWithinPartitions(*order).mapInArrow(scan, "u bigint, v bigint")


def _parts(members: DataFrame) -> DataFrame:
    """(g, c, parts): rows of each group of several, and the chunks that it makes."""
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("b")).where("c > 1")
    return settle(sizes.withColumn("parts", F.ceil(F.greatest(F.col("c") / CHUNK_ROWS, F.col("b") / CHUNK_BYTES)).cast("int")).select("g", "c", "parts"))


def _links(members: DataFrame, attach, kernel, percent: int, hashes: int, buckets=None) -> DataFrame:
    """Links (u, v) that join all rows of a group g which the kernel joins.

    members: g, id, n, bytes, without the data that the kernel compares; attach(rows) adds it as `data` to rows with an
    id. So only what is to be compared moves, once. buckets(rows) adds `sub`, a row for each bucket of the id; without it
    the groups are the buckets.
    """
    sizes = _parts(members)
    rows = settle(members.select("g", "id", "n", "bytes").join(small(sizes), "g"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    leader = (F.col("parts") > 1) & (F.pmod(F.xxhash64("id", F.lit(7)), F.col("c")) < LEADERS)
    chunks = F.when(leader, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    told = attach(rows.select("g", "id", "n", chunks.alias("chunks"))).withColumn("late", F.size("chunks") == 1)
    first = settle(_link_groups(told.withColumn("chunk", F.explode("chunks")).withColumn("label", F.col("id")), ["g", "chunk"], kernel, percent, hashes))
    large = sizes.where("parts > 1")
    if large.isEmpty():
        return first

    # Leaders come first in their chunks, so that the smallest leader of a component is its row in every chunk. A row's label is the smallest
    # row that it is linked to, or that row's own smallest if it is a leader: rows with one label are joined, and nearly all that are joined have one.
    roots = settle(first.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label")))
    hops = roots.join(small(settle(rows.where(leader).select("id").distinct())), "id").select(F.col("id").alias("label"), F.col("label").alias("next"))
    labels = roots.join(small(settle(hops)), "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    labelled = rows.where("parts > 1").join(labels, "id", "left").select("g", "id", "n", "bytes", F.coalesce("label", "id").alias("label"))
    labelled = settle(labelled)
    most = labelled.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.max("k").alias("most"), F.sum("k").alias("k"))
    left = settle(most.where("most < k").select("g", (2 * F.col("most") >= F.col("k")).alias("main")))
    if left.isEmpty():
        return first
    # A main component leaves few rows to compare with it. Without one, rows meet by their other bands first.
    rest = settle(labelled.join(small(left), "g"))
    without = rest.where("NOT main").drop("main")
    if buckets:
        dealt = buckets(without).withColumn("g", F.xxhash64("g", "sub")).drop("sub")
    else:
        # Two rows that share another band were compared there already, unless that band's group has no main component either.
        pairs = F.flatten(F.transform("gs", lambda a: F.transform(F.filter("gs", lambda b: b > a), lambda b: F.xxhash64(a, b))))
        dealt = without.groupBy("id", "n", "bytes", "label").agg(F.collect_set("g").alias("gs")).withColumn("g", F.explode(pairs)).drop("gs")
    rest = rest.where("main").drop("main").unionByName(dealt)
    return first.union(_links_outside(settle(rest), attach, kernel, percent, hashes))


def _links_outside(members: DataFrame, attach, kernel, percent: int, hashes: int) -> DataFrame:
    """Links between the components (label) of each group g. In groups of several chunks, rows outside the main component meet all chunks, in blocks; nothing else is left to compare."""
    counts = members.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("bytes").alias("b"))
    main = counts.groupBy("g").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("k"), F.max("k").alias("most"), F.sum("b").alias("b")).where("most < k")
    chunks = lambda share: F.ceil(share * F.greatest(F.col("k") / CHUNK_ROWS, F.col("b") / CHUNK_BYTES)).cast("int")
    main = settle(main.select("g", "main", chunks(F.lit(1)).alias("parts"), chunks((F.col("k") - F.col("most")) / F.col("k")).alias("blocks")))
    chunk, block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")).cast("int")
    dealt = members.join(small(main), "g").withColumns({"chunk": F.when(F.col("parts") > 1, chunk).otherwise(0), "block": F.when(F.col("parts") > 1, block).otherwise(0)})
    cells = lambda block, chunk: F.struct(block.cast("int").alias("block"), chunk.cast("int").alias("chunk"))
    against = F.transform(F.sequence(F.lit(0), F.when(F.col("parts") > 1, F.col("blocks") - 1).otherwise(0)), lambda b: cells(b, F.col("chunk")))
    outside = F.when(F.col("label") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda c: cells(F.col("block"), c)))
    places = F.array_distinct(F.concat(against, F.coalesce(outside, F.array().cast("array<struct<block:int,chunk:int>>"))))
    told = attach(dealt.select("g", "id", "n", "label", places.alias("places"))).withColumn("place", F.explode("places")).withColumns({"block": F.col("place.block"), "chunk": F.col("place.chunk")})
    return settle(_link_groups(told, ["g", "block", "chunk"], kernel, percent, hashes))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row per row of `docs`: id, n_shingles long, component_id, kept boolean.

    Texts, A-Z lower-cased, are sets of distinct `words`-word shingles (words are runs without ASCII white space; a text
    with fewer words is one shingle), linked where 100 * intersection >= percent * union. component_id is the smallest id
    reachable over links; kept tells whether it is the row's own. A link at the threshold itself is missed with
    probability (1 - (percent/100)^rows)^bands, 5e-8 at the defaults; above it, less. Defined cases: null texts and texts without words have an
    empty set, link to nothing and are kept; ids are whole numbers, and repeated rows of an id get the same result each;
    an id with several texts stands with each of them, and joins those for which it is the smallest id; a row without id joins the component of equal sets but never names one, and is kept where there is none; empty
    tables give no rows; columns other than id and text are not read.
    """
    hashes = bands * rows
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = settle(_sketches(base, words, hashes))
    named = sketch.where("id IS NOT NULL AND n > 0")
    kinds = settle(named.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("data"), F.count(F.lit(1)).alias("copies")))
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("data", 4 * rows * b + 1, 4 * rows)) for b in range(bands)]))
    signatures = kinds.select("id", "data")

    def with_signature(r: DataFrame) -> DataFrame:
        return small(settle(r)).join(signatures, "id")

    def with_buckets(r: DataFrame) -> DataFrame:
        return with_signature(r).withColumn("sub", bucket).drop("data")

    keys = kinds.select("id", "n", bucket.alias("g"))
    clusters = settle(components(_links(keys.withColumn("bytes", F.lit(4 * hashes)), with_signature, _by_signature, percent, hashes)))

    named_sets = kinds.select("id", "k1", "k2", "n")
    fellows = settle(clusters.join(named_sets.select("id", "n"), "id").select(F.col("label").alias("g"), "id", "n", (8 * F.col("n")).alias("bytes")))

    def with_set(r: DataFrame) -> DataFrame:
        # An id may stand in a group for each band; its text is read and cut up once.
        once = r.groupBy("id").agg(F.collect_list(F.struct(*[c for c in r.columns if c != "id"])).alias("places_of"))
        wanted = small(settle(small(settle(once)).join(named_sets.drop("n"), "id"))).withColumnRenamed("id", "rep")
        return _sets(base.join(wanted, F.col("id") == F.col("rep")).drop("rep"), words).select("id", "data", F.inline("places_of"))

    final = components(_links(fellows, with_set, _by_set, percent, hashes, with_buckets))
    named_ones = kinds.join(final, "id", "left").withColumn("component_id", F.coalesce("label", "id")).where("copies > 1 OR component_id <> id")
    out = sketch.select("id", "n", "k1", "k2").join(named_ones.select("k1", "k2", "component_id"), ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85, bands=24)
