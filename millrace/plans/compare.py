"""Comparing runs: deltas, sweeps, pivots, best of groups, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from .catalog import query, table


@query("""WITH s AS (SELECT event_type AS mode, avg(value) AS v, count(*) AS n FROM events GROUP BY 1), b AS (SELECT v AS bv FROM s WHERE mode = (SELECT min(mode) FROM s))
SELECT mode, n, round(v, 6) AS v, round(v - bv, 6) AS delta, round(CASE WHEN bv <> 0 THEN (v - bv) / bv * 100 END, 6) AS pct, round(CASE WHEN v > 0 THEN bv / v END, 6) AS speedup FROM s, b""")
def mode_compare(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    base = sums.agg(F.min_by("v", "mode").alias("bv"))
    v, b = F.col("v"), F.col("bv")
    return sums.crossJoin(F.broadcast(base)).select("mode", "n", F.round("v", 6).alias("v"), F.round(v - b, 6).alias("delta"), F.round(F.when(b != 0, (v - b) / b * 100), 6).alias("pct"), F.round(F.when(v > 0, b / v), 6).alias("speedup"))


@query("""SELECT l_returnflag, round(sum(l_extendedprice) / greatest(sum(l_quantity), 1e-9), 6) AS of_sums, round(avg(l_extendedprice / l_quantity), 6) AS of_rows,
round(coalesce(nullif(sum(l_tax), 0), 1) / greatest(coalesce(nullif(sum(l_discount), 0), 1), 1e-9), 6) AS guarded FROM lineitem GROUP BY 1""")
def throughput_two_ways(spark, sf_dir):
    guarded = stats.or_one(F.sum("l_tax")) / F.greatest(stats.or_one(F.sum("l_discount")), F.lit(1e-9))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(stats.ratio_of_sums(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("of_sums"), F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("of_rows"), F.round(guarded, 6).alias("guarded")
    )


@query("""SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN '1' WHEN l_linenumber = 2 THEN '2' ELSE '3+' END AS stratum, round(avg(l_extendedprice), 4) AS mean, count(*) AS n, round(avg(greatest(l_extendedprice - l_quantity * 1000, 0)), 4) AS rest FROM lineitem GROUP BY 1, 2""")
def stratified_means(spark, sf_dir):
    n = F.col("l_linenumber")
    stratum = F.when(n == 1, "1").when(n == 2, "2").otherwise("3+")
    rest = F.greatest(F.col("l_extendedprice") - F.col("l_quantity") * 1000, F.lit(0.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", stratum.alias("stratum")).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n"), F.round(F.avg(rest), 4).alias("rest"))


@query("SELECT l_linenumber, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 4) AS \"A\", round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 4) AS \"N\", round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 4) AS \"R\" FROM lineitem GROUP BY 1")
def heatmap_pivot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_extendedprice"), 4))


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS low, max(l_quantity) AS high, median(l_quantity) AS mid,
count(*) FILTER (WHERE l_quantity > 25) AS above, round(100 * avg(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END), 6) AS pct, round(avg(l_extendedprice) FILTER (WHERE l_linenumber = 1), 4) AS first_mean FROM lineitem GROUP BY 1, 2""")
def param_sensitivity(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("std"), F.min(q).alias("low"), F.max(q).alias("high"), F.median(q).alias("mid"), F.count_if(q > 25).alias("above"),
        F.round(100 * F.avg(F.when(q > 25, 1).otherwise(0)), 6).alias("pct"), F.round(F.avg(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice"))), 4).alias("first_mean"),
    )


@query("SELECT l_suppkey, arg_max(l_orderkey, struct_pack(a := l_extendedprice, b := -l_orderkey)) AS best_order, max(l_extendedprice) AS best FROM lineitem GROUP BY 1")
def best_per_group(spark, sf_dir):
    rank = F.struct("l_extendedprice", -F.col("l_orderkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", rank).alias("best_order"), F.max("l_extendedprice").alias("best"))


@query("SELECT min(l_linenumber)::INTEGER AS crossover, round(100.0 * (SELECT avg(CASE WHEN l_quantity / 20 > 1 THEN 1 ELSE 0 END) FROM lineitem), 6) AS pct_beating FROM (SELECT l_linenumber, max(l_quantity / 20) AS best FROM lineitem GROUP BY 1) WHERE best >= 1")
def crossover(spark, sf_dir):
    ratio = F.col("l_quantity") / 20
    each = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.max(ratio).alias("best"), F.count(F.lit(1)).alias("n"), F.count_if(ratio > 1).alias("k"))
    return each.agg(F.min(F.when(F.col("best") >= 1, F.col("l_linenumber"))).alias("crossover"), F.round(100 * (F.sum("k") / F.sum("n")), 6).alias("pct_beating"))


@query("SELECT CASE WHEN l_quantity / 20 > 1.5 THEN 'good' WHEN l_quantity / 20 > 1 THEN 'marginal' WHEN l_quantity / 20 > 0 THEN 'slower' ELSE 'none' END AS rating, count(*) AS n, round(max(l_quantity / 20), 4) AS top, arg_min(l_orderkey, l_orderkey) AS first_order FROM lineitem GROUP BY 1")
def speedup_rating(spark, sf_dir):
    s = F.col("l_quantity") / 20
    rating = F.when(s > 1.5, "good").when(s > 1, "marginal").when(s > 0, "slower").otherwise("none")
    return table(spark, sf_dir, "lineitem").groupBy(rating.alias("rating")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(s), 4).alias("top"), F.min("l_orderkey").alias("first_order"))


@query("""WITH s AS (SELECT l_suppkey, round(avg(l_quantity) / (SELECT avg(l_quantity) FROM lineitem WHERE l_linenumber = 1), 9) AS ratio FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT arg_max(l_suppkey, struct_pack(a := ratio, b := -l_suppkey)) AS max_config, round(max(ratio), 6) AS max_speedup, arg_min(l_suppkey, struct_pack(a := ratio, b := l_suppkey)) AS min_config, round(min(ratio), 6) AS min_speedup, round(avg(ratio), 6) AS avg_speedup, count(*) AS configs FROM s""")
def speedup_extremes(spark, sf_dir):
    """Suppliers stand for configurations, and the first lines of orders for the baseline."""
    lines = table(spark, sf_dir, "lineitem")
    each = lines.where("l_linenumber > 1").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("speed"))
    base = lines.where("l_linenumber = 1").agg(F.avg("l_quantity").alias("base"))
    return stats.extremes(each.crossJoin(F.broadcast(base)).select("l_suppkey", F.round(F.col("speed") / F.col("base"), 9).alias("ratio")), "l_suppkey", "ratio").select(
        F.col("max_name").alias("max_config"), F.round("max_value", 6).alias("max_speedup"), F.col("min_name").alias("min_config"), F.round("min_value", 6).alias("min_speedup"), F.round("mean", 6).alias("avg_speedup"), F.col("n").alias("configs")
    )


@query("SELECT p_brand, round(avg(p_retailprice) / max(avg(p_retailprice)) OVER (), 6) AS price, round(count(*)::DOUBLE / max(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def radar_norm(spark, sf_dir):
    from pyspark.sql import Window as W

    each = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"), F.count(F.lit(1)).alias("c"))
    every = W.partitionBy()
    return each.select("p_brand", F.round(F.col("a") / F.max("a").over(every), 6).alias("price"), F.round(F.col("c") / F.max("c").over(every), 6).alias("share"))


@query("""WITH s AS (SELECT l_suppkey, round(avg(l_quantity), 6) AS speed, round(avg(l_discount), 6) AS quality FROM lineitem GROUP BY 1)
SELECT l_suppkey, speed, quality FROM (SELECT *, max(quality) OVER (ORDER BY speed DESC, quality DESC, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) WHERE m IS NULL OR quality > m""")
def pareto(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 6).alias("speed"), F.round(F.avg("l_discount"), 6).alias("quality"))
    return stats.running_best(each, "speed", "quality", "l_suppkey")


@query("""WITH d AS (SELECT user_id, round(avg(value) FILTER (WHERE event_id % 2 = 0) - avg(value) FILTER (WHERE event_id % 2 = 1), 1) AS d FROM events GROUP BY 1),
r AS (SELECT d, avg(i) OVER (PARTITION BY abs(d)) AS rank FROM (SELECT d, row_number() OVER (ORDER BY abs(d)) AS i FROM d WHERE d IS NOT NULL AND d <> 0))
SELECT count(*) AS n, round(coalesce(sum(rank) FILTER (WHERE d > 0), 0), 3) AS w_plus, round(coalesce(sum(rank) FILTER (WHERE d < 0), 0), 3) AS w_minus, (SELECT coalesce(sum(t * t * t - t), 0)::BIGINT FROM (SELECT count(*) AS t FROM r GROUP BY abs(d))) AS ties FROM r""")
def wilcoxon_parts(spark, sf_dir):
    parity = F.col("event_id") % 2
    apart = stats.difference_of_means(F.col("value"), parity == 0, parity == 1)
    pairs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(apart, 1).alias("d"))
    return stats.ranks_of_differences(pairs, F.col("d")).select("n", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"), "ties")


@query("SELECT l_linestatus, list_sort(list(DISTINCT l_linenumber))::VARCHAR AS numbers FROM lineitem GROUP BY 1")
def distinct_lists(spark, sf_dir):
    nums = F.array_join(F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda x: x.cast("string")), ", ")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.concat(F.lit("["), nums, F.lit("]")).alias("numbers"))
