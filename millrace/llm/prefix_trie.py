"""The trie of all prefixes of conversations, from the longest common prefixes (LCP) of neighbours in sorted order.

Conversations are sorted by their turns. A node of the trie is then an interval of them, and the intervals with several members are
those of the Cartesian tree over the LCP array: around each LCP value, as far as no smaller one. The sorted order lies in blocks, one
per key range, and all blocks are scanned in parallel. A scan keeps the values that are still open on a stack; what opens and
closes in one block is finished there, with equal values merged. What goes over a block's ends is finished by block minima: the next
block with a smaller minimum holds the nearest smaller value, and the place in it is among the prefix minima or the values left open at its end. Nodes
with one way on have no interval of their own: they are the missing depths between an interval and the one around it, and are
expanded. Sums over subtrees are differences of running sums over the sorted order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import discard, settle, small, table

#: Bytes of a turn's digest. Turns count as equal if these are.
WIDTH = 16
#: Ids of members that are joined into one string before they are hashed or moved.
PIECE = 20_000
#: Nodes that are handed on together.
LOT = 5_000


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of a turn; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns array<struct<digest, words>>): a row per conversation, its turns in order; equal turn numbers go by digest. Rows without conversation id are left out."""
    each = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"), word_count(F.col(text_col)).alias("words")).alias("x"),
    )  # Nulls sort first in arrays.
    gathered = each.groupBy("conv").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return gathered.select("conv", F.transform("xs", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Conversations that begin alike: the first h turns of conversation c - c % family, then c's own after its first h; h is crc32 of c's decimal text, modulo `shared`."""
    starts = convs.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, shared - 1).alias("start"))
    own = convs.select("conv", "turns", (F.col("conv") - F.col("conv") % family).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).cast("int").alias("h"))
    none = F.lit([]).cast(starts.schema["start"].dataType)
    merged = F.concat(F.slice(F.coalesce("start", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return own.join(starts, "base", "left").select("conv", merged.alias("turns"))


_SORTED = "block int, pos bigint, conv bigint, lcp bigint, words array<bigint>, edge binary"
_KINDS = {"block": pa.int32(), "pos": pa.int64(), "conv": pa.int64(), "lcp": pa.int64(), "words": pa.list_(pa.int64()), "edge": pa.binary()}


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) // WIDTH


def _neighbours(batches):
    """Sorted (conv, key, words) with its block, its place there, its LCP with the row before it in its block, and running sums of
    words; `edge` is the key of a block's first and last row. For the first row lcp is null."""
    from pyspark import TaskContext

    block, pos, before, held = TaskContext.get().partitionId(), 0, None, None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], list(_KINDS))

    out = []
    for batch in batches:
        for conv, key, words in zip(*(batch.column(c).to_pylist() for c in ("conv", "key", "words")), strict=True):
            if held:
                out.append(held)
            total, sums = 0, []
            for w in words:
                total += w
                sums.append(total)
            held = (block, pos, conv, None if before is None else _lcp(before, key), sums, key if before is None else None)
            before, pos = key, pos + 1
            if len(out) >= 2_000:
                yield batch_of(out)
                out = []
    if held:
        yield batch_of([*out, (*held[:5], before)])


_NODE = "depth bigint, conv bigint, parent bigint, up_block int, up_side string, up_depth bigint, n bigint, children bigint, leaves bigint, saved bigint, ends string"
_PLACE = "value bigint, place bigint, x bigint, leaf bigint, least bigint, lcp bigint, len bigint"
_PART = f"block int, depth bigint, sides array<string>, left struct<{_PLACE}>, right struct<{_PLACE}>, kids bigint, words array<bigint>, pieces array<string>"
_BLOCK = f"block int, base bigint, n bigint, x bigint, leaf bigint, low bigint, least bigint, last_conv bigint, at_end array<struct<{_PLACE}>>, at_start array<struct<{_PLACE}>>"
_NONE = hashlib.sha256(b"").hexdigest()
_TOP = 1 << 62


def _digest(pieces) -> str:
    out = hashlib.sha256()
    for i, p in enumerate(pieces):
        out.update((b"," if i else b"") + p.encode())
    return out.hexdigest()


def _pieces(convs: list[int]) -> list[str]:
    return [",".join(map(str, convs[at : at + PIECE])) for at in range(0, len(convs), PIECE)]


class _Open:
    """A value on the stack: its depth, where its interval starts in this block (None: before it), the smallest conversation so far, how often a child begins."""

    __slots__ = ("depth", "kids", "least", "lo", "place", "waiting")

    def __init__(self, depth, lo, least, place):
        self.depth, self.lo, self.least, self.place, self.kids, self.waiting = depth, lo, least, place, 0, []


def _scan_block(block: int, base: int, next_block: int | None, next_lcp: int, conv: list[int], lcp: list[int], words: list[list[int]]):
    """Lots of rows of a block, as dicts: "node", "part" and one "block", of _NODE, _PART and _BLOCK.

    nodes are those of intervals within the block; a node whose parent is not one names that one by block, side and depth. parts are the
    pieces in this block of all other intervals.
    """
    n = len(conv)
    size = [len(w) for w in words]
    upto = lambda j, d: words[j][d - 1] if d > 0 else 0  # noqa: E731  words of the first d turns
    after = [*lcp[1:], next_lcp]
    x = np.cumsum([0, *(upto(j, d) for j, d in enumerate(lcp))]).tolist()
    leaf = np.cumsum([0, *(a < s for a, s in zip(after, size, strict=True))]).tolist()
    nodes, parts, starts = [], [], []

    def settle_nodes(waiting, parent, ref):
        for row in waiting:
            row["parent"] = parent
            if ref is not None:
                row["up_block"], row["up_side"], row["up_depth"] = ref
            nodes.append(row)

    def chain(up, top, least, count, children, leaves, saved, ends):
        """Rows of a node and of those above it that have one child, as far as depth up; the first waits for its parent."""
        rows = [
            {"depth": d, "conv": least, "parent": least, "n": count, "children": children if d == top else 1, "leaves": leaves, "saved": saved(d), "ends": ends if d == top else _NONE}
            for d in range(up + 1, top + 1)
        ]
        nodes.extend(rows[1:])
        return rows[:1]

    def run(lo, depth):
        """Conversations from lo on that end at a depth."""
        to = lo
        while to < n and size[to] == depth and (to == lo or lcp[to] == depth):
            to += 1
        return conv[lo:to]

    def place(at, least, value, before):
        """What is known of a place: sums of all rows before it (of those up to it, if `before` is False)."""
        got = at < n
        return {"value": value, "place": base + at, "x": x[at if before else at + 1], "leaf": leaf[at], "least": least, "lcp": lcp[at] if got else next_lcp, "len": size[at] if got else 0}

    def part(e, sides, hi):
        if e.depth >= 0:
            told = run(e.lo, e.depth) if e.lo is not None and size[e.lo] == e.depth else run(0, e.depth) if e.lo is None and lcp[0] == size[0] == e.depth else []
            parts.append({"block": block, "depth": e.depth, "sides": sides, "left": None if e.lo is None else place(e.lo, e.least, e.depth, False), "right": None if hi is None else place(hi, e.least, e.depth, True), "kids": e.kids, "words": words[e.place][: e.depth], "pieces": _pieces(told)})
        # The waiting nodes' parent goes over the block's ends.
        settle_nodes(e.waiting, None, (block, sides[0], e.depth) if e.depth >= 0 else None)

    def opened(i, lo, least, depth):
        e = _Open(depth, lo, least, i)
        e.kids = int(size[i] > depth)
        stack.append(e)
        return e

    def leaf_rows(j, up):
        ends = _digest([str(conv[j])])
        return chain(up, size[j], conv[j], 1, 0, 1, lambda d: 0, ends)

    stack: list[_Open] = []
    smallest = None  # of the rows so far
    for i in range(n):
        depth, gone = lcp[i], None
        if not stack:
            opened(i, None, _TOP, depth)
            starts.append(place(0, _TOP, depth, True))
            smallest = conv[0]
            continue
        top = stack[-1]
        if depth > top.depth:
            top = opened(i, i - 1, conv[i - 1], depth)
            top.waiting += leaf_rows(i - 1, depth)
        else:
            top.least = min(top.least, conv[i - 1])
            top.waiting += leaf_rows(i - 1, top.depth)
            while stack and stack[-1].depth > depth:
                gone = stack.pop()
                up = max(depth, stack[-1].depth if stack else -1)
                if gone.lo is None:
                    part(gone, ["start"], i)
                    rows = []
                else:
                    lo, some = gone.lo, i - gone.lo
                    shared = x[i] - x[lo + 1]
                    ends = _digest(_pieces(run(lo, gone.depth))) if size[lo] == gone.depth else _NONE
                    rows = chain(up, gone.depth, gone.least, some, gone.kids + (size[lo] > gone.depth), leaf[i] - leaf[lo], lambda d, a=shared, b=some, c=lo: a - (b - 1) * upto(c, d - 1), ends)
                    settle_nodes(gone.waiting, gone.least, None)
                if not stack or stack[-1].depth < depth:
                    opened(i, gone.lo, gone.least, depth)
                    if gone.lo is None:
                        starts.append(place(i, smallest, depth, True))
                    stack[-1].waiting += rows
                    break
                stack[-1].least = min(stack[-1].least, gone.least)
                stack[-1].waiting += rows
            else:
                stack[-1].kids += int(size[i] > depth)
        smallest = min(smallest, conv[i])
        if len(nodes) > LOT:
            yield "node", nodes
            nodes.clear()
    last = n - 1
    if next_lcp > stack[-1].depth:
        settle_nodes(leaf_rows(last, next_lcp), None, (next_block, "start", next_lcp))
    else:
        stack[-1].waiting += leaf_rows(last, stack[-1].depth)
    least, ends = conv[last], [place(last, conv[last], _TOP, False)]
    for e in reversed(stack):
        e.least = least = min(least, e.least)
        if e.lo is not None:
            ends.append(place(e.lo, e.least, e.depth, False))
    for e in stack:
        part(e, ["end"] if e.lo is not None else ["end", "start"], None)
    yield "node", nodes
    yield "part", parts
    yield "block", [{"block": block, "base": base, "n": n, "x": x[n], "leaf": leaf[n], "low": min(lcp), "least": min(conv), "last_conv": conv[last], "at_end": ends[::-1], "at_start": starts}]


def _arrow(ddl: str) -> pa.StructType:
    return to_arrow_type(StructType.fromDDL(ddl))


def _scan(batches, kinds: dict[str, pa.StructType]):
    """Blocks, in order within each, as rows of (node, part, block), of which one is there."""

    def batch_of(name, rows):
        cols = [pa.array(rows, kinds[k]) if k == name else pa.nulls(len(rows), kinds[k]) for k in kinds]
        return pa.RecordBatch.from_arrays(cols, list(kinds))

    def done(held, known):
        for name, rows in _scan_block(*known, *held):
            for at in range(0, len(rows), LOT):
                yield batch_of(name, rows[at : at + LOT])

    held, known = ([], [], []), None
    for batch in batches:
        for block, base, following, after, conv, lcp, words in zip(*(batch.column(c).to_pylist() for c in ("block", "base", "next_block", "next_lcp", "conv", "lcp", "words")), strict=True):
            if known and known[0] != block:
                yield from done(held, known)
                held = ([], [], [])
            known = (block, base, following, after)
            for column, value in zip(held, (conv, lcp, words), strict=True):
                column.append(value)
    if known:
        yield from done(held, known)


def _sorted_blocks(convs: DataFrame) -> DataFrame:
    """Conversations in sorted order: block, base (rows before the block), next_block, next_lcp, pos, conv, lcp, words (running sums)."""
    spark = convs.sparkSession
    keyed = settle(convs.select("conv", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "")).alias("key"), F.transform("turns", lambda x: x["words"]).alias("words")))
    placed = settle(keyed.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_neighbours, _SORTED))
    discard(keyed)
    ends = placed.where("edge IS NOT NULL").groupBy("block").agg(F.min_by("edge", "pos").alias("first"), F.max_by("edge", "pos").alias("last"), (F.max("pos") + 1).alias("n"))
    order = W.partitionBy().orderBy("block")  # over one row per block
    beside = ends.select("block", "first", F.lag("last").over(order).alias("before"), (F.sum("n").over(order) - F.col("n")).alias("base"))

    def boundary(batches):
        for batch in batches:
            values = [-1 if b is None else _lcp(b, f) for f, b in zip(batch.column("first").to_pylist(), batch.column("before").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("base"), pa.array(values, pa.int64())], ["block", "base", "first_lcp"])

    starts = settle(beside.select("block", "base", "first", "before").mapInArrow(boundary, "block int, base bigint, first_lcp bigint"))
    info = starts.select("block", "base", "first_lcp", F.lead("block").over(order).alias("next_block"), F.coalesce(F.lead("first_lcp").over(order), F.lit(-1)).alias("next_lcp"))
    return placed.join(small(settle(info)), "block").withColumn("lcp", F.coalesce("lcp", "first_lcp"))


def _resolved(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """parts with both ends: l, r, low, high (what is known of the ends), least, n, leaves, shared, up (depth of the parent), and the parent's name."""
    order = W.partitionBy().orderBy("block")  # over one row per block
    sums = blocks.select("*", *[(F.sum(c).over(order) - F.col(c)).alias(f"{c}_before") for c in ("x", "leaf")])
    sums = settle(sums)
    lows = sums.agg(F.array_sort(F.collect_list(F.struct("block", "low", "least"))).alias("lows"), F.sum("n").alias("rows"), F.sum("x").alias("x_all"), F.sum("leaf").alias("leaf_all"))
    p = parts.crossJoin(F.broadcast(lows))  # one row
    none = F.lit(None).cast("int")
    p = p.withColumn("l_block", F.when(F.col("left").isNotNull(), F.col("block")).otherwise(F.try_element_at(F.filter("lows", lambda b: (b["block"] < F.col("block")) & (b["low"] < F.col("depth"))), F.lit(-1))["block"]))
    p = p.withColumn("r_block", F.when(F.col("right").isNotNull(), F.col("block")).otherwise(F.try_element_at(F.filter("lows", lambda b: (b["block"] > F.col("block")) & (b["low"] < F.col("depth"))), F.lit(1))["block"]))
    at_l = sums.select(F.col("block").alias("l_block"), F.col("x_before").alias("lx"), F.col("leaf_before").alias("ll"), "at_end", "last_conv")
    at_r = sums.select(F.col("block").alias("r_block"), F.col("x_before").alias("rx"), F.col("leaf_before").alias("rl"), "at_start")
    p = p.join(at_l, "l_block").join(at_r, "r_block", "left")
    p = p.withColumn("left", F.coalesce("left", F.try_element_at(F.filter("at_end", lambda e: e["value"] >= F.col("depth")), F.lit(1))))
    p = p.withColumn("right", F.coalesce("right", F.try_element_at(F.filter("at_start", lambda e: e["value"] < F.col("depth")), F.lit(1))))
    between = F.filter("lows", lambda b: (b["block"] > F.col("l_block")) & (F.col("r_block").isNull() | (b["block"] < F.col("r_block"))))
    l, r = F.col("left"), F.col("right")
    p = p.select(
        "block", "depth", "sides", "kids", "words", "pieces", "l_block", "r_block", "last_conv", l["place"].alias("l"), F.coalesce(r["place"], F.col("rows")).alias("r"), l["len"].alias("l_len"),
        l["value"].alias("l_value"), l["lcp"].alias("l_lcp"), F.coalesce(r["lcp"], F.lit(-1)).alias("r_lcp"),
        F.least(l["least"], F.coalesce(r["least"], F.lit(_TOP)), F.coalesce(F.array_min(F.transform(between, lambda b: b["least"])), F.lit(_TOP))).alias("least"),
        (F.coalesce(F.col("rl") + r["leaf"], F.col("leaf_all")) - F.col("ll") - l["leaf"]).alias("leaves"),
        (F.coalesce(F.col("rx") + r["x"], F.col("x_all")) - F.col("lx") - l["x"]).alias("shared"),
    )
    p = p.withColumn("up", F.greatest("l_lcp", "r_lcp"))
    own = F.col("l_lcp") >= F.col("r_lcp")
    return p.withColumns({"up_block": F.when(F.col("up") < 0, none).when(own, F.col("l_block")).otherwise(F.col("r_block")), "up_side": F.when(own, F.lit("end")).otherwise(F.lit("start"))})


def _ends(batches):
    """Digests of the pieces of each node (l, depth), which come in order."""
    key, held, told = None, None, []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["l", "depth", "ends"])

    for batch in batches:
        for l, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("l", "depth", "piece")), strict=True):
            if key == (l, depth):
                held.update(b",")
            else:
                if key:
                    told.append((*key, held.hexdigest()))
                key, held = (l, depth), hashlib.sha256()
            held.update(piece.encode())
        if len(told) > LOT:
            yield batch_of(told)
            told = []
    if key:
        yield batch_of([*told, (*key, held.hexdigest())])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv long, turns array<struct<digest binary, words long>>): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens long, ends_sha256.

    Digests have 16 bytes; `conv` is unique and not null. A conversation without turns is a member of the root alone; no conversations give
    no rows. A conversation is one value of its sort, 24 bytes a turn; any number of conversations may be equal or begin alike, since the sort goes
    on by id. Broadcast, and held by one task for running sums, are tables of one row per block, that is per shuffle partition.
    """
    rows = _sorted_blocks(convs).select("block", "base", "next_block", "next_lcp", "pos", "conv", "lcp", "words")
    kinds = {"node": _arrow(_NODE), "part": _arrow(_PART), "block": _arrow(_BLOCK)}
    found = settle(rows.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(lambda b: _scan(b, kinds), f"node struct<{_NODE}>, part struct<{_PART}>, block struct<{_BLOCK}>"))
    parts = settle(_resolved(found.where("part IS NOT NULL").select("part.*"), found.where("block IS NOT NULL").select("block.*")))
    named = parts.select(F.col("block").alias("up_block"), F.explode("sides").alias("up_side"), F.col("depth").alias("up_depth"), F.col("least").alias("up_conv"))

    pieces = parts.select("l", "depth", "block", F.posexplode("pieces").alias("i", "piece")).union(
        # The last row of a block alone, where what begins with it has its depth in later blocks only.
        parts.where((F.col("l_value") == _TOP) & (F.col("l_len") == F.col("depth"))).select("l", "depth", F.col("l_block").alias("block"), F.lit(0).alias("i"), F.col("last_conv").cast("string").alias("piece")).distinct()
    )
    ends = pieces.repartition("l", "depth").sortWithinPartitions("l", "depth", "block", "i").select("l", "depth", "piece").mapInArrow(_ends, "l bigint, depth bigint, ends string")
    wide = parts.groupBy("l", "depth").agg(
        F.sum("kids").alias("kids"), *[F.any_value(c).alias(c) for c in ("r", "least", "leaves", "shared", "l_len", "words", "up", "up_block", "up_side")]
    ).join(ends, ["l", "depth"], "left")
    top, d, n = F.col("depth"), F.col("d"), F.col("r") - F.col("l")
    spread = wide.withColumn("d", F.explode(F.sequence(F.greatest(F.col("up") + 1, F.lit(0)), top)))
    first = d == F.col("up") + 1
    before = F.when(d >= 2, F.get("words", (d - 2).cast("int"))).otherwise(F.lit(0))
    crossing = spread.select(
        d.alias("depth"), F.col("least").alias("conv"), F.when(~first, F.col("least")).alias("parent"), F.when(first, F.col("up_block")).alias("up_block"), "up_side", F.col("up").alias("up_depth"), n.alias("n"),
        F.when(d < top, F.lit(1)).otherwise(F.col("kids") + (F.col("l_len") > top).cast("long")).cast("long").alias("children"), "leaves", (F.col("shared") - (n - 1) * before).alias("saved"),
        F.when(d < top, F.lit(_NONE)).otherwise(F.coalesce("ends", F.lit(_NONE))).alias("ends"),
    )
    nodes = found.where("node IS NOT NULL").select("node.*").select(crossing.columns).union(crossing)
    done = nodes.where("up_block IS NULL").select("conv", "depth", "parent", "n", "children", "leaves", "saved", "ends")
    asked = nodes.where("up_block IS NOT NULL").join(named, ["up_block", "up_side", "up_depth"]).select("conv", "depth", F.col("up_conv").alias("parent"), "n", "children", "leaves", "saved", "ends")
    return done.union(asked).toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


#: crc32 of a number's decimal text, bit by bit: the polynomial is that of zlib.
_CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END))"
)

#: The same nodes by grouping every prefix of every conversation.
SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS c, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c, i, digest, words FROM c JOIN t ON t.conv_id = c - c % 20 AND i <= h
  UNION ALL SELECT c, i, digest, words FROM c JOIN t ON t.conv_id = c AND i > h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, digest, words FROM r),
p AS (
  SELECT c, d, words, md5(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d)) AS node, md5(coalesce(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS up,
         d = count(*) OVER (PARTITION BY c) AS ends FROM o
  UNION ALL SELECT c, 0, 0, md5(''), NULL, c NOT IN (SELECT c FROM o) FROM c),
n AS (
  SELECT d, node, any_value(up) AS up, any_value(words) AS words, min(c) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY d, node),
k AS (SELECT up, count(*) AS children FROM n WHERE up IS NOT NULL GROUP BY up),
own AS (SELECT n.*, coalesce(children, 0) AS children, (n - 1) * words AS saved FROM n LEFT JOIN k ON k.up = n.node),
below AS (
  SELECT a.node, sum(x.saved) AS saved, sum((x.children = 0)::INT) AS leaves
  FROM own x JOIN p ON p.c = x.conv_id AND p.d <= x.d JOIN own a ON a.node = p.node GROUP BY a.node)
SELECT own.conv_id, own.d AS depth, u.conv_id AS parent_conv_id, own.n AS n_convs, own.children AS n_children,
       below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, own.ends_sha256
FROM own JOIN below USING (node) LEFT JOIN own u ON u.node = own.up
"""
