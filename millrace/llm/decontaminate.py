"""Benchmark decontamination as a prefix-filtered set join over windows, in DataFrame operations alone.

The tokens of a window are its shingles, `SHINGLE` neighbouring words (a shorter window is one shingle), as 64-bit hashes,
ordered by rarity over all documents. A window is contained in a text only if all its shingles are, so the prefix that has
to be joined is one long: the rarest. Occurrences of these are the candidates. The shingle's place in the window bounds the
places in the text (not before its start, not over its end), and there the words are compared one by one.

Documents are read twice: to count the shingles, and to join. While the prefixes fit in a broadcast, the shingles of a
text are joined, bounded and compared in the stage that reads it, and only what matches leaves it. Beyond that, prefixes are joined by
shuffle, whatever their number, and the texts that have candidates are read once more for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fits, settle, small, table

#: All code points of ASCII but digits and a-z (after lower-casing).
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle.
SHINGLE = 3
#: No word has it; it stands for the end of a text.
END = "\x00"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _hash(size: int) -> Column:
    """Hash of the `size` words from `pos` on, in the columns w, pos and word."""
    return F.xxhash64(F.lit(size), "word", *[F.get("w", F.col("pos") + k) for k in range(1, size)])


def shingles(texts: DataFrame, sizes: list[int], end: bool = False) -> DataFrame:
    """texts (..., w) with pos, word and h, a row for each place and size; what reaches over the end is the hash of fewer words. With `end`, END has one row, of hash 0.

    Words are exploded first and hashed then, by generated code: a lambda over the array would be interpreted.
    """
    hashes = [_hash(s) for s in sizes or [SHINGLE]]
    if end:
        hashes = [F.when(F.col("word") == END, F.lit(0).cast("bigint") if i == 0 else F.lit(None).cast("bigint")).otherwise(h) for i, h in enumerate(hashes)]
    each = texts.select("*", F.posexplode("w").alias("pos", "word"))
    return each.withColumn("h", F.explode(F.array(*hashes)) if len(hashes) > 1 else hashes[0])


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(win_id, win): each distinct window; (win_id, item): the ids, as strings, of the items that have it."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("start")
    wins = items.select("item", "w", start).select("item", F.slice("w", F.col("start") + 1, window).alias("win"))
    # 128 bits, so that no two windows of any benchmark share an id.
    named = settle(wins.select("item", "win", F.md5(F.array_join("win", " ").cast("binary")).alias("win_id")).distinct())
    return named.groupBy("win_id").agg(F.first("win").alias("win")), named.select("win_id", "item")


def _sizes(windows: DataFrame) -> list[int]:
    """Sizes of the shingles that windows need: SHINGLE, and those of shorter windows."""
    return sorted(r[0] for r in windows.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect())


def anchored(windows: DataFrame, docs: DataFrame, text_col: str, sizes: list[int]) -> DataFrame:
    """windows with `h`, the shingle that is rarest over all documents, and `off`, its place in the window."""
    own = shingles(windows.withColumn("w", F.col("win")), sizes)
    size = F.least(F.size("w"), F.lit(SHINGLE))
    whole = (F.col("pos") + size <= F.size("w")) & (F.col("h") == F.coalesce(*[F.when(size == s, _hash(s)) for s in sizes], F.lit(0)))
    each = settle(own.where(whole).select("win_id", "win", F.col("pos").alias("off"), "h").distinct())
    vocabulary = settle(each.select("h").distinct())
    # The words are a column of their own, as expressions within others would be worked out anew for each element.
    spoken = shingles(docs.select(words_of(F.col(text_col)).alias("w")), sizes).select("h")
    if fits(vocabulary):
        counts = spoken.join(F.broadcast(vocabulary), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    else:  # counted before it moves, so that a frequent shingle is one row a task
        counts = spoken.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "h", "left_semi")
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")
    return each.join(small(settle(counts)), "h", "left").groupBy("win_id").agg(F.min(rarity).alias("best"), F.first("win").alias("win")).select("win_id", "win", F.col("best.h").alias("h"), F.col("best.off").alias("off"))


def _places(words: Column, pos: Column, off: Column, win: Column) -> Column:
    """Where the window starts if it is there, null if not."""
    start = pos - off
    inside = (start >= 0) & (start + F.size(win) <= F.size(words))
    return F.when(inside & (F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(win)) == win), start)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, n_items long, items_sha256 string, contaminated boolean.

    A window is `window` consecutive words of an item, or all words of a shorter one; each word of a text inside any
    occurrence of a window is hit. n_items counts items with a window in the text, items_sha256 is of their ids, sorted as
    strings and comma-joined (of nothing: the hash of the empty string). Defined cases: null and wordless texts have no words and
    no hits; items without id or words are ignored; repeated documents get a row each; a null id stays null; an empty
    benchmark hits nothing, an empty table gives no rows; columns other than the named ones are not read.
    """
    windows, owners = item_windows(benchmark, item_col, item_text_col, window)
    windows = settle(windows)
    sizes = _sizes(windows)
    anchors = settle(anchored(windows, docs, text_col, sizes))

    text = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("key"), words_of(F.col(text_col)).alias("w"))
    if fits(anchors):
        # A last word that no text has stands for the text itself, so that one pass gives the number of words too.
        said = shingles(text.withColumn("w", F.array_append("w", F.lit(END))), sizes, end=True)
        none = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("win_id"), F.array().cast("array<string>").alias("win"), F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("off"))
        found = said.join(F.broadcast(anchors.unionByName(none)), "h")
        last = F.col("win_id").isNull() & (F.col("word") == END)
        start = F.when(F.col("win_id").isNotNull(), _places(F.col("w"), F.col("pos"), F.col("off"), F.col("win")))
        found = found.withColumn("start", start).where(last | F.col("start").isNotNull())
        found = found.select("id", "key", F.when(last, F.col("pos")).alias("n_words"), "win_id", "start", F.size("win").alias("len"))
    else:
        said = shingles(text, sizes).select("id", "key", "pos", "h")
        likely = settle(said.join(anchors.select("h", "off", "win_id"), "h").select("id", "key", "pos", "off", "win_id").distinct())
        named = small(likely.select(F.col("id").alias("i"), F.col("key").alias("k")).distinct())
        texts = text.join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_semi").dropDuplicates(["id", "key"])
        full = likely.join(windows, "win_id").join(texts.select(F.col("id").alias("i"), F.col("key").alias("k"), "w"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
        hits = full.withColumn("start", _places(F.col("w"), F.col("pos"), F.col("off"), F.col("win"))).where("start IS NOT NULL")
        found = text.select("id", "key", F.size("w").alias("n_words"), F.lit(None).cast("string").alias("win_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"))
        found = found.unionByName(hits.select("id", "key", F.lit(None).cast("int").alias("n_words"), "win_id", "start", F.size("win").alias("len")))

    span = F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("end")))
    each = settle(found.groupBy("id", "key").agg(F.max("n_words").cast("long").alias("n_words"), F.count("n_words").alias("rows"), F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("win_id").alias("wins")))
    # Items of the windows hit; only texts with hits take part.
    owned = each.where(F.size("wins") > 0).select("id", "key", F.explode("wins").alias("win_id")).join(small(settle(owners)), "win_id")
    listed = owned.groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = each.join(small(settle(listed)), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct((a["hit"] + F.greatest(s["end"] - F.greatest(s["start"].cast("long"), a["end"]), F.lit(0))).cast("long").alias("hit"), F.greatest(a["end"], s["end"].cast("long")).alias("end")))
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = each.select("id", "n_words", covered["hit"].alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0 AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS s FROM bw)),
grams AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT g.doc_id, g.s, g.k, win.item_id FROM grams g JOIN win ON g.k = win.k AND g.win = win.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
