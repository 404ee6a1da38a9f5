"""Tests and intervals of paired differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paired
from .catalog import query, table

_RANKED = """
d AS (SELECT {g} AS g, round(l_discount - l_tax, 2) AS d FROM lineitem),
r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY g, abs(d)) AS t FROM d WHERE d <> 0),
w AS (SELECT g, count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rank ELSE 0 END) AS w_minus, sum(t * t - 1)::BIGINT AS ties FROM r GROUP BY g)"""


@query(f"""WITH {_RANKED.format(g="l_orderkey")},
i AS (SELECT g, (2 * rank)::BIGINT AS rank, row_number() OVER (PARTITION BY g) - 1 AS i FROM r),
s AS (SELECT w.g, pattern, sum(CASE WHEN (pattern >> i) & 1 = 1 THEN rank ELSE 0 END) AS total FROM w JOIN i ON w.g = i.g, LATERAL (SELECT unnest(range(0, 1 << w.n)) AS pattern) GROUP BY w.g, pattern),
p AS (SELECT g, least(1.0, 2.0 * sum((total <= 2 * least(w_plus, w_minus))::INT) / count(*)) AS p FROM s JOIN w USING (g) GROUP BY g)
SELECT o.g AS l_orderkey, coalesce(n, 0) AS n, coalesce(w_plus, 0)::DOUBLE AS w_plus, coalesce(w_minus, 0)::DOUBLE AS w_minus, coalesce(ties, 0) AS ties, round(coalesce(p, 1)::DOUBLE, 9) AS p_value, coalesce(p, 1) < 0.05 AS significant
FROM (SELECT DISTINCT g FROM d) o LEFT JOIN w ON w.g = o.g LEFT JOIN p ON p.g = o.g""")
def signed_rank_small(spark, sf_dir):
    """Groups of a few pairs, tied and zero ones among them: all sign patterns count, as the SQL counts them one by one."""
    tests = paired.signed_rank_tests(table(spark, sf_dir, "lineitem"), F.round(F.col("l_discount") - F.col("l_tax"), 2), ["l_orderkey"])
    return tests.select("l_orderkey", "n", "w_plus", "w_minus", "ties", F.round("p_value", 9).alias("p_value"), "significant")


_TAIL = "list_sum(list_transform(range(0, 1201), lambda i: (CASE WHEN i IN (0, 1200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(z + i * 0.02 / greatest(1.0, z), 2) / 2))) * 0.02 / greatest(1.0, z) / 3 / sqrt(2 * pi())"


@query(f"""WITH {_RANKED.format(g="l_suppkey")},
z AS (SELECT *, abs(least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - ties / 48.0) AS z FROM w)
SELECT g AS l_suppkey, n, round(w_plus::DOUBLE, 1) AS w_plus, round(w_minus::DOUBLE, 1) AS w_minus, ties, round(least(1.0, 2 * {_TAIL}), 9) AS p_value, least(1.0, 2 * {_TAIL}) < 0.05 AS significant FROM z""")
def signed_rank_large(spark, sf_dir):
    """Groups of hundreds of pairs: the normal tail, corrected for ties."""
    tests = paired.signed_rank_tests(table(spark, sf_dir, "lineitem"), F.round(F.col("l_discount") - F.col("l_tax"), 2), ["l_suppkey"])
    return tests.select("l_suppkey", "n", F.round("w_plus", 1).alias("w_plus"), F.round("w_minus", 1).alias("w_minus"), "ties", F.round("p_value", 9).alias("p_value"), "significant")


@query(f"""WITH b AS (SELECT l_returnflag, floor((('0x' || substr(md5(concat_ws(':', l_orderkey, 0)), 1, 12))::BIGINT + 0.5) / (1::BIGINT << 48) * 4096)::INT AS b, sum(l_discount - l_tax) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2),
x AS (SELECT l_returnflag, s, n, draw, (('0x' || substr(md5(concat_ws(':', b, draw, 0)), 1, 12))::BIGINT + 0.5) / (1::BIGINT << 48) AS c FROM b, (SELECT unnest(range(0, 200)) AS draw)),
k AS (SELECT *, {" + ".join(f"(c > {s!r})::INT" for s in paired.poisson_steps())} AS k FROM x),
m AS (SELECT l_returnflag, draw, sum(s * k) / sum(n * k) AS mean FROM k GROUP BY 1, 2)
SELECT l_returnflag, any_value(t.n)::BIGINT AS n, round(any_value(t.mean), 8) AS mean, round(quantile_cont(m.mean, 0.025), 8) AS low, round(quantile_cont(m.mean, 0.975), 8) AS high
FROM m JOIN (SELECT l_returnflag, sum(n) AS n, sum(s) / sum(n) AS mean FROM b GROUP BY 1) t USING (l_returnflag) GROUP BY 1""")
def bootstrap_interval(spark, sf_dir):
    """Paired shares per flag; the SQL draws by the same hashes."""
    found = paired.bootstrap_intervals(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_discount") - F.col("l_tax"), ["l_returnflag"])
    return found.select("l_returnflag", "n", *[F.round(c, 8).alias(c) for c in ("mean", "low", "high")])
