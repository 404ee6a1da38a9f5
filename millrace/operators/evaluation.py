"""Scoring hypotheses against references, and corpora of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text
from ..settled import settled, small

ORDERS = (1, 2, 3, 4)


def answer_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, ref, hyp): user turns with the assistant turn that comes next."""
    run = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"next_turn": F.lead("turn").over(run), "next_role": F.lead("role").over(run), "hyp": F.lead("text").over(run)})
    found = rows.where("role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1")
    return found.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("ref"), F.coalesce("hyp", F.lit("")).alias("hyp"))


def ngram_counts(pairs: DataFrame, keys: list[str], tokens) -> DataFrame:
    """keys, m1..m4, t1..t4, h, r: matches and totals by order, and lengths. They add up, so a corpus score is one from their sums."""
    rows = pairs.select(*keys, tokens(F.col("hyp")).alias("_h"), tokens(F.col("ref")).alias("_r"))
    return _by_order(rows.select(*keys, sim.overlaps(F.col("_h"), F.col("_r"), len(ORDERS)).alias("_m"), F.size("_h").cast("long").alias("h"), F.size("_r").cast("long").alias("r")), keys)


def code_counts(pairs: DataFrame, keys: list[str], tolerant: bool) -> DataFrame:
    """As ngram_counts, of stemmed tokens of code; if tolerant, names that the prompt has may be said without loss. One kernel stems, adds names and counts, so that words go to Python once."""
    names = text.identifiers(F.col("ref")) if tolerant else None
    counted = sim.stemmed_overlaps(text.code_tokens(F.col("hyp")), text.code_tokens(F.col("ref")), len(ORDERS), names)
    return _by_order(pairs.select(*keys, counted.alias("_c")).select(*keys, F.col("_c.m").alias("_m"), "_c.h", "_c.r"), keys)


def _by_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for n in ORDERS for c in (F.get("_m", F.lit(n - 1)).alias(f"m{n}"), F.greatest(F.col("h") - (n - 1), F.lit(0)).alias(f"t{n}"))]
    return rows.select(*keys, *cols, "h", "r")


def bleu_of(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    return sim.bleu([c(f"m{n}") for n in ORDERS], [F.greatest(c(f"t{n}"), F.lit(1)) for n in ORDERS], c("h"), c("r"))


def corpus_sums(counts: DataFrame, by: list[str]) -> DataFrame:
    names = [f"{x}{n}" for n in ORDERS for x in "mt"] + ["h", "r"]
    sums = [F.sum(F.greatest(c, F.lit(1)) if c[0] == "t" else c).alias(c) for c in names]
    return counts.groupBy(*by).agg(*sums) if by else counts.agg(*sums)


def _grams(words: Column, n: int) -> Column:
    """Hashes of the n-grams of a list."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.lit(n), F.slice(words, i, F.lit(n))))


def cider(pairs: DataFrame, keys: list[str], tokens) -> DataFrame:
    """keys, cider: ten times the cosine of the n-gram weights of both texts, all orders at once.

    Weights are frequencies, by length, times the log of documents over references that have the n-gram. N-grams go by 64-bit hashes and are counted
    map-side, as those of a pair lie in one task, and once: the counts are settled, for the document frequencies and for the weights. Frequencies are
    broadcast if few, and joined by shuffle beyond, where the engine splits n-grams that very many pairs have.
    """
    rows = pairs.select(*keys, tokens(F.col("hyp")).alias("h"), tokens(F.col("ref")).alias("r"))
    none = F.array().cast("array<struct<n:int,g:bigint,a:bigint,b:bigint>>")
    # A list that is shorter than n has no n-grams; an empty entry keeps pairs without any.
    entry = lambda n, a, b: lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
    told = [F.when(F.size(c) >= n, F.transform(_grams(F.col(c), n), entry(n, a, b))).otherwise(none) for n in ORDERS for c, a, b in (("h", 1, 0), ("r", 0, 1))]
    each = rows.select(*keys, F.size("h").alias("lh"), F.size("r").alias("lr"), F.inline_outer(F.flatten(F.array(*told))))
    each = settled(each.groupBy(*keys, "lh", "lr", "n", "g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    df = small(settled(each.where("b > 0").groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")))  # 1 weighs as none does
    total = rows.select(F.count(F.lit(1)).alias("docs"))
    idf = F.log(F.greatest("docs", F.lit(1)) / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)))
    weight = lambda count, length: F.coalesce(F.col(count), F.lit(0)) / F.greatest(F.col(length) - F.col("n") + 1, F.lit(1)) * idf
    weighed = each.join(df, "g", "left").crossJoin(F.broadcast(total)).select(*keys, weight("a", "lh").alias("x"), weight("b", "lr").alias("y"))
    total_of = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = weighed.groupBy(*keys).agg(total_of(F.col("x") * F.col("y")).alias("dot"), total_of(F.col("x") * F.col("x")).alias("a"), total_of(F.col("y") * F.col("y")).alias("b"))
    norm = F.sqrt("a") * F.sqrt("b")
    return sums.select(*keys, F.when(norm > 0, 10 * F.col("dot") / norm).otherwise(0.0).alias("cider"))


#: What texts are taken for scores: evaluated samples clean both sides, simple ones cut at white space, tagged ones only lose the marks of the answer.
VARIANTS = {
    "evaluated": text.norm_tokens,
    "simple": text.tokens,
    "tagged": lambda c: text.norm_tokens(text.strip_message_tags(c)),
}


def cider_variant(pairs: DataFrame, keys: list[str], variant: str) -> DataFrame:
    """CIDEr of one of VARIANTS. Pairs stay pairs in each: rows that are left out leave both sides."""
    return cider(pairs, keys, VARIANTS[variant])


#: Up to so many characters of words and synsets a table of synonyms goes to every task whole.
SYNONYM_CHARS = 8 << 20


def meteor_by_synonyms(pairs: DataFrame, keys: list[str], tokens, synonyms: DataFrame) -> DataFrame:
    """keys, meteor: METEOR with exact, stem and synonym stages; synonyms: (word, synset), a word in as many synsets as it likes.

    The table is measured: up to SYNONYM_CHARS it is broadcast, and no pair moves; beyond, each pair is given the synsets of its own words by a join. Keys name a pair; they may be
    null. Words without a synset, empty texts and an empty table leave the other stages.
    """
    rows = pairs.select(*keys, tokens(F.col("hyp")).alias("_h"), tokens(F.col("ref")).alias("_r"))
    table = synonyms.toDF("_w", "_s").where("_w IS NOT NULL AND _s IS NOT NULL").groupBy("_w").agg(F.array_sort(F.collect_set(F.col("_s").cast("string"))).alias("_sets"))
    table = settled(table)
    chars = table.agg(F.sum(F.length("_w") + F.aggregate("_sets", F.lit(0), lambda a, x: a + F.length(x)))).first()[0] or 0
    if chars <= SYNONYM_CHARS:
        known = pairs.sparkSession.sparkContext.broadcast({r["_w"]: tuple(r["_sets"]) for r in table.collect()})
        return rows.select(*keys, sim.meteor_by(known)(F.col("_h"), F.col("_r")).alias("meteor"))
    said = rows.select(*keys, F.explode(F.array_distinct(F.concat("_h", "_r"))).alias("_word"))
    known = said.join(table, F.col("_word") == F.col("_w")).groupBy(*keys).agg(F.collect_list(F.struct(F.col("_word").alias("word"), F.col("_sets").alias("sets"))).alias("_told"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.`{k}`").eqNullSafe(F.col(f"t.`{k}`"))
    both = rows.alias("p").join(known.alias("t"), same, "left").select(*[F.col(f"p.`{k}`") for k in keys], "_h", "_r", "_told")
    return both.select(*keys, sim.meteor_with(F.col("_told"))(F.col("_h"), F.col("_r")).alias("meteor"))
