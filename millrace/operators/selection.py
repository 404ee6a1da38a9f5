"""Choosing tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import running
from .runs import batches, effective_tokens


def diverse_top(df: DataFrame, stratum: str, repo: str, score: str, order: str, k: int) -> DataFrame:
    """k rows a stratum: each repo's best in order of score, then the rest by score. No repo has more than its k best to offer.

    Both windows keep ranks up to k only, which Spark cuts to in each task before rows move (WindowGroupLimit), so that a hot stratum sends k rows a task.
    """
    by_repo = W.partitionBy(stratum, repo).orderBy(F.desc(score), order)
    best = df.withColumn("_rr", F.row_number().over(by_repo)).where(F.col("_rr") <= k)
    place = F.row_number().over(W.partitionBy(stratum).orderBy(F.desc(F.col("_rr") == 1), F.desc(score), order))
    return best.withColumn("k", place).where(F.col("k") <= k).drop("_rr")


def quota_pick(df: DataFrame, stratum: str, repo: str, score: str, order: str, quota: Column) -> DataFrame:
    """Up to `quota` rows a stratum by score; until half is chosen only repos not chosen yet.

    Once half the quota is full of new repos the rule is open for all, so that a row's rank is its count of new repos up to there, and one more for each row
    from then on. A repo's first row is its group's best, by one aggregate; places and counts come from one sort by ranges, so a stratum, or a repo, may be
    any part of the rows.
    """
    first, at, upto, least, need, start = "_first", "_at", "_upto", "_least", "_need", "_start"
    worth = F.struct((-F.col(score).cast("double")).alias("s"), F.col(order).alias("o"))
    best = df.groupBy(F.col(stratum).alias("_s"), F.col(repo).alias("_r")).agg(F.min(worth)["o"].alias(least))
    marked = df.join(best, F.col(stratum).eqNullSafe(F.col("_s")) & F.col(repo).eqNullSafe(F.col("_r")) & (F.col(order) == F.col(least)), "left").withColumn(first, F.col(least).isNotNull()).drop("_s", "_r", least)
    seen = running(marked.withColumn(need, F.floor(quota / 2)), [stratum], [F.col(score).desc(), F.col(order)], at, {upto: F.col(first).cast("long")})
    # Where the rule opens: at the row that fills half the quota, or at once.
    opens = seen.groupBy(F.col(stratum).alias("_s")).agg(F.min(F.when(F.col(need) <= 0, 0).when(F.col(first) & (F.col(upto) == F.col(need)), F.col(at))).alias(start))
    ranked = seen.join(opens, F.col(stratum).eqNullSafe(F.col("_s")))
    rank = F.when(F.col(at) > F.col(start), F.col(need) + F.col(at) - F.col(start)).when(F.col(first), F.col(upto))
    return ranked.withColumn("k", rank).where(F.col("k") <= quota).select(*[F.col(f"`{c}`") for c in df.columns], "k")


def quotas(df: DataFrame, stratum: str, slots: int, least: int = 5, many: int = 4, boost: float = 1.5) -> DataFrame:
    """(stratum, n, quota): shares of the slots, at least `least`, more for strata from `many` on, never over n, scaled down to fit. Windows see one row a stratum."""
    every = W.partitionBy()
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    share = F.greatest(F.lit(least), F.floor(F.lit(slots) * F.col("n") / F.sum("n").over(every)))
    raw = counts.withColumn("q", F.least(F.when(F.col(stratum) >= many, F.floor(share * boost)).otherwise(share), F.col("n")).cast("long"))
    total = F.sum("q").over(every)
    return raw.select(stratum, "n", F.when(total > slots, F.greatest(F.lit(1), F.floor(F.col("q") * (F.lit(float(slots)) / total)))).otherwise(F.col("q")).cast("long").alias("quota"))


def fill(chosen: DataFrame, rest: DataFrame, key: str, score: str, target: int) -> DataFrame:
    """chosen, and the best of the rest, up to `target` rows."""
    missing = max(0, target - chosen.count())
    more = rest.join(chosen.select(key), key, "left_anti").orderBy(F.desc(score), key).limit(missing)
    return chosen.unionByName(more)


def suitability(n: Column, mean: Column, most: Column, cv: Column, excluded: Column, low: float = 150, high: float = 4000, top: float = 5000, ideal: float = 800, width: float = 1200) -> Column:
    """How well a task's files fit in batches; -1 for tasks of one file or of extreme files. Weights, and the defaults."""
    score = F.log2(F.least(n, F.lit(10))) * 1.5 + F.exp(-F.pow((mean - ideal) / width, F.lit(2.0))) * 2.0 + 1.0 / (1.0 + cv) + F.when(excluded, 0.7).otherwise(1.0) * 0.5
    return F.when((n < 2) | (mean < low) | (mean > high) | (most > top), -1.0).otherwise(score)


def profiling_score(cv: Column, length: Column, words: Column, n: Column) -> Column:
    """Even files, middling length, a telling label, many files. All numbers."""
    return -cv * 2.0 - F.abs(length - 5500) / 3000.0 + F.when(words >= 4, 0.5).when(words >= 3, 0.3).otherwise(0.0) + n * 0.1


def evaluation_score(words: Column, length: Column, n: Column, label_chars: Column) -> Column:
    """A telling label above all. All numbers."""
    said = F.when(words >= 5, 2.0).when(words >= 4, 1.5).when(words >= 3, 1.0).when(words <= 1, -2.0).otherwise(0.0)
    return said + F.when(length.between(3000, 7000), 0.5).otherwise(0.0) + F.least(n, F.lit(5)) * 0.2 - F.when(label_chars < 10, 1.0).otherwise(0.0)


def nearest(df: DataFrame, value: str, order: str, targets: list[int], k: int) -> DataFrame:
    """(target, order, k): up to k rows a target, no row twice. Small targets want equality; larger ones allow 0.3 of themselves, at least 2.

    Targets take turns, in rising order, each from what those before have left. As those take k rows each, the first k times its turn
    rows of a target hold all that it can get: one pass cuts to these, in each task before they move, and the turns are taken in a fold over that small rest, k times
    the square of the targets' number at most.
    """
    targets = sorted(targets)
    distance = lambda t: F.abs(F.col(value) - t)
    fits = lambda t: F.col(value) == t if t <= 5 else distance(t) <= max(0.3 * t, 2)
    offers = F.filter(F.array(*[F.when(fits(t), F.struct(F.lit(i).alias("turn"), F.lit(t).alias("target"), distance(t).alias("d"))) for i, t in enumerate(targets)]), lambda x: x.isNotNull())
    each = df.select(F.col(value).alias("v"), F.col(order).alias("id"), F.inline(offers))
    place = F.row_number().over(W.partitionBy("turn").orderBy("d", F.desc("v"), "id"))
    few = each.withColumn("p", place).where(F.col("p") <= k * len(targets))
    in_turn = few.groupBy().agg(F.array_sort(F.collect_list(F.struct("turn", "p", "target", "id"))).alias("offers"))
    kind = df.schema[order].dataType.simpleString()
    one = f"struct<target:int,id:{kind},k:int>"

    def take(taken: Column, x: Column) -> Column:
        """taken, and the offer if its row is free and its target has room."""
        own = F.size(F.filter(taken, lambda t: t["target"] == x["target"]))
        free = ~F.exists(taken, lambda t: t["id"] == x["id"]) & (own < k)
        return F.when(free, F.concat(taken, F.array(F.struct(x["target"].alias("target"), x["id"].alias("id"), (own + 1).alias("k")).cast(one)))).otherwise(taken)

    taken = in_turn.select(F.inline(F.aggregate("offers", F.array().cast(f"array<{one}>"), take)))
    return taken.select("target", F.col("id").alias(order), "k")


def cap_grid(df: DataFrame, id_col: str, chars: str, tokens: str, caps: list[int], size: int, overhead: int) -> DataFrame:
    """(cap, padding, cut_chars, cut_files, composite) of batches of `size` under each cap; all caps in one pass."""
    each = df.withColumn("cap", F.explode(F.array(*map(F.lit, caps))))
    each = each.withColumn("tok", effective_tokens(F.col(tokens), F.col("cap"), F.col(chars), overhead))
    pads = batches(each, "cap", "tok", id_col, size).groupBy("cap").agg(F.sum("padding").alias("padding"))
    cuts = each.groupBy("cap").agg(F.sum(F.greatest(F.col(chars) - F.col("cap"), F.lit(0))).alias("cut_chars"), F.count_if(F.col(chars) > F.col("cap")).alias("cut_files"))
    both = pads.join(cuts, "cap")
    return both.select("cap", F.col("padding").cast("long"), F.col("cut_chars").cast("long"), "cut_files", F.round(F.col("padding") / 1000.0 + 2 * F.col("cut_chars") / 10000.0, 6).alias("composite"))
