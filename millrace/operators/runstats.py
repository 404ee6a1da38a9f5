"""Statistics of runs, and the orders, slices and picks that reports of runs need."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import running

#: Fixed value: keeps divisions by a time or a count of 0 finite.
EPS = 1e-9


def _rounded(c: Column, places: int) -> Column:
    return F.round(c, places)


def generation_stats(prompt: Column, generated: Column, wall: Column, prefill: Column) -> list[Column]:
    """Speeds of one generation: end to end, of the prompt, and of decoding, which has what prefill leaves of the time."""
    decode = F.greatest(wall - prefill, F.lit(EPS))
    return [
        _rounded(wall, 4).alias("wall_seconds"), _rounded(prefill, 4).alias("prefill_seconds"), _rounded(decode, 4).alias("decode_seconds"), _rounded(prefill * 1000, 3).alias("time_to_first_token_ms"),
        _rounded(generated / (wall + EPS), 2).alias("tokens_per_second"), _rounded(wall / (generated + EPS) * 1000, 3).alias("ms_per_token"),
        _rounded(prompt / (prefill + EPS), 2).alias("prefill_tok_per_second"), _rounded(generated / (decode + EPS), 2).alias("decode_tok_per_second"), F.lit(1.0).alias("tokens_per_step"),
    ]


def with_batch_stats(df: DataFrame, batch: str, tokens: str, steps: str, seconds: str) -> DataFrame:
    """df with its batch's totals and speeds on each row. One aggregate by batch, joined back; AQE splits a batch that is large."""
    sums = df.groupBy(batch).agg(F.count(F.lit(1)).alias("batch_size"), F.sum(tokens).cast("long").alias("batch_total_tokens"), F.sum(steps).cast("long").alias("batch_total_steps"), F.sum(seconds).alias("_s"))
    n, s = F.col("batch_total_tokens"), F.col("_s")
    told = sums.select(
        batch, "batch_size", "batch_total_tokens", "batch_total_steps", _rounded(n / (s + EPS), 2).alias("batch_tokens_per_second"), _rounded(s / (n + EPS) * 1000, 3).alias("effective_ms_per_token"),
        _rounded(n / F.greatest("batch_total_steps", F.lit(1)), 3).alias("tokens_per_step"),
    )
    return df.join(told, batch)


def two_step_stats(answer_tokens: Column, answer_s: Column, summary_tokens: Column, summary_steps: Column, summary_s: Column) -> list[Column]:
    """Speeds of a pipeline that summarises first: overall by the answer's tokens and the whole time, the summaries' on their own."""
    whole = summary_s + answer_s
    return [
        _rounded(whole, 4).alias("t_total_seconds"), _rounded(answer_tokens / (whole + EPS), 2).alias("overall_tps"), _rounded(whole / (answer_tokens + EPS) * 1000, 3).alias("effective_ms_per_token"),
        _rounded(summary_tokens / (summary_s + EPS), 2).alias("summary_tps"), _rounded(summary_tokens / F.greatest(summary_steps, F.lit(1)), 3).alias("tokens_per_step"),
    ]


def mode_report(df: DataFrame, mode: str, failed: Column, wall: Column, tokens: Column) -> DataFrame:
    """(mode, tasks, errors, avg_wall, avg_tokens): averages are over rows that did not fail, 0 without any."""
    ok = F.greatest(F.count_if(~failed), F.lit(1))
    mean = lambda c: F.coalesce(F.sum(F.when(~failed, c)), F.lit(0.0)) / ok
    return df.groupBy(mode).agg(F.count(F.lit(1)).alias("tasks"), F.count_if(failed).alias("errors"), mean(wall).alias("avg_wall"), mean(tokens).alias("avg_tokens"))


def by_count(df: DataFrame, count: str, order: str, exact: int | None = None, least: int | None = None, most: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose count is exact, or between least and most; the first `limit` of them by order."""
    c = F.col(count)
    keep = c == exact if exact is not None else (c >= least if least is not None else F.lit(True)) & (c <= most if most is not None else F.lit(True))
    found = df.where(keep)
    return found.orderBy(order).limit(limit) if limit is not None else found


def trim(chosen: DataFrame, target: int, first_to_go: Column, score: str, place: str) -> DataFrame:
    """chosen cut to `target` rows: those that may go first leave by rising score, then rows from the end by place."""
    over = max(0, chosen.count() - target)
    gone = chosen.orderBy(F.when(first_to_go, 0).otherwise(1), F.when(first_to_go, F.col(score)), F.when(first_to_go, F.col(place)).otherwise(-F.col(place))).limit(over)
    return chosen.join(gone.select(place), place, "left_anti")


def round_robin(df: DataFrame, length: str, order: str, shards: int) -> DataFrame:
    """df with `shard`: rows sorted by length are dealt out in turn."""
    return running(df, [], [F.col(length), F.col(order)]).withColumn("shard", F.pmod(F.col("place") - 1, F.lit(shards))).drop("place")


def series(df: DataFrame, group: list[str], at: str, value: str) -> DataFrame:
    """(group, series): points of each group, in order. A group is one value, and so has to fit in one."""
    points = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))))
    return df.groupBy(*group).agg(points.alias("series"))


def prefix_baseline(df: DataFrame, group: str, place: str, seconds: str, sizes: list[int]) -> DataFrame:
    """(group, size, baseline): what the first `size` rows of a group take one after another. Conditional sums, so no window."""
    sums = [F.struct(F.lit(k).alias("size"), F.sum(F.when(F.col(place) <= k, F.col(seconds)).otherwise(0.0)).alias("baseline")) for k in sizes]
    return df.groupBy(group).agg(F.array(*sums).alias("_b")).select(group, F.inline("_b"))


def cyclic_slices(df: DataFrame, length: str, order: str, sizes: list[int], most: int) -> DataFrame:
    """(size, rep, i, row): for each batch size as many repetitions as `most` allows, each with the next rows by length, from the start again after the last."""
    placed = running(df, [], [F.col(length), F.col(order)])
    n = max(placed.count(), 1)
    takes = [(bs, r, i, (r * bs + i) % n + 1) for bs in sizes for r in range(max(most // bs, 1)) for i in range(bs)]
    wanted = df.sparkSession.createDataFrame(takes, "size int, rep int, i int, place long")
    return placed.join(F.broadcast(wanted), "place").drop("place")


def in_baseline_order(baseline: DataFrame, samples: DataFrame, key: str, order: str) -> DataFrame:
    """All rows of the baseline with `place`, their position, and what samples have for their key: null where nothing, while rows of other keys are left out."""
    return running(baseline.select(key, order) if key != order else baseline.select(key), [], [F.col(order)]).join(samples, key, "left")


def last_wins(df: DataFrame, row: str, column: str, values: list, value: str, order: Column) -> DataFrame:
    """A grid of row by column; of several rows for a cell the last by order counts, and cells without any are null."""
    return df.groupBy(row).pivot(column, values).agg(F.max_by(value, order))


def top_groups(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """(keys, mean, most, n) of the k groups with the largest means."""
    each = df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))
    return each.orderBy(F.desc("mean"), *keys).limit(k)


def best_of(df: DataFrame, score: str, order: list[str], condition: Column | None = None) -> DataFrame:
    """The row with the smallest score, of those that meet the condition."""
    return (df if condition is None else df.where(condition)).orderBy(score, *order).limit(1)


def missing(subset: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Keys of the subset that the whole lacks; none if it is one."""
    return subset.select(key).distinct().join(whole.select(key), key, "left_anti")


def require_subset(subset: DataFrame, whole: DataFrame, key: str) -> None:
    if (n := missing(subset, whole, key).count()) > 0:
        raise ValueError(f"{n} values of {key} are not in the whole")


def grid_values(df: DataFrame, column: str) -> DataFrame:
    """A column's distinct values, largest first."""
    return df.select(column).distinct().orderBy(F.desc(column))


def metric(df: DataFrame, name: str, allowed: tuple[str, ...]) -> Column:
    """The column of a metric that is chosen by name."""
    if name not in allowed or name not in df.columns:
        raise ValueError(f"no metric {name!r}; there are {', '.join(c for c in allowed if c in df.columns)}")
    return F.col(name)


def guarded(df: DataFrame, work: Callable[[dict], dict], stats: str) -> DataFrame:
    """df with the numbers that `work` gives for each row, and `error`. Where it raises, the numbers are 0 and error says why; other rows go on.

    stats: the numbers' DDL. An Arrow kernel, for work that only Python can do.
    """
    kinds = T.StructType.fromDDL(stats)
    schema = T.StructType([*df.schema.fields, *kinds.fields, T.StructField("error", T.StringType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                try:
                    found.append({**{f.name: 0 for f in kinds}, **work(row), "error": None})
                except Exception as e:  # whatever work raises is what the row is to say
                    found.append({**{f.name: 0 for f in kinds}, "error": f"{type(e).__name__}: {e}"})
            told = pd.DataFrame(found, columns=[*(f.name for f in kinds), "error"], index=batch.index)
            yield pd.concat([batch, told], axis=1)

    return df.mapInPandas(scan, schema)


def best_in_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with `best`, the names of the columns that hold the row's largest value; none where all are null."""
    top = F.greatest(*columns)
    return df.withColumn("best", F.filter(F.array(*[F.when(F.col(c) == top, F.lit(c)) for c in columns]), lambda c: c.isNotNull()))


def preservation(said: Column, names: Column) -> Column:
    """The share of names that a text says; null without names."""
    return F.when(F.size(names) > 0, F.size(F.array_intersect(said, names)) / F.size(names))


def bootstrap_means(df: DataFrame, key: str, difference: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, mean) of `draws` resamples of paired differences. Each row counts in a draw as often as a Poisson number that a hash
    of its key and the draw gives, so that a resample needs no row numbers, reruns agree, and one aggregate makes all draws.
    """
    chance = (F.pmod(F.xxhash64(F.col(key), "draw", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # P(number <= k) of a Poisson variable of mean 1, up to what a double can tell from 1.
    steps, term, total = [], 2.718281828459045**-1, 0.0
    for k in range(18):
        total += term
        steps.append(total)
        term /= k + 1
    times = sum((F.when(F.col("_c") > s, 1).otherwise(0) for s in steps), F.lit(0))
    each = df.where(F.col(difference).isNotNull()).select(key, difference, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("_c", chance).withColumn("_k", times)
    return each.groupBy("draw").agg((F.sum(F.col(difference) * F.col("_k")) / F.sum("_k")).alias("mean"))
