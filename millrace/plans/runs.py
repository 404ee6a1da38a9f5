"""Statistics of runs and the slices that reports of them need, on tables that stand in for runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import building, runs, runstats, selection
from .catalog import query, table

_GEN = "SELECT o_orderkey, (o_orderkey % 500)::BIGINT AS p, (o_custkey % 300)::BIGINT AS g, o_totalprice / 9999.7::DOUBLE AS w, (o_orderkey % 7) / 9.7::DOUBLE AS f FROM orders"


@query(f"""SELECT o_orderkey, round(w, 4) AS wall_seconds, round(f, 4) AS prefill_seconds, round(greatest(w - f, 1e-9::DOUBLE), 4) AS decode_seconds, round(f * 1000, 3) AS time_to_first_token_ms, round(g / (w + 1e-9::DOUBLE), 2) AS tokens_per_second,
round(w / (g + 1e-9::DOUBLE) * 1000, 3) AS ms_per_token, round(p / (f + 1e-9::DOUBLE), 2) AS prefill_tok_per_second, round(g / (greatest(w - f, 1e-9::DOUBLE) + 1e-9::DOUBLE), 2) AS decode_tok_per_second, 1.0::DOUBLE AS tokens_per_step
FROM ({_GEN}) WHERE g > 0 AND f > 0 AND w > f""")
def llm_speed_stats(spark, sf_dir):
    """Orders stand in for generations; rows without tokens or time are shown by tests, as their quotients are beyond what both engines round alike."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 500).alias("p"), (F.col("o_custkey") % 300).alias("g"), (F.col("o_totalprice") / 9999.7).alias("w"), (F.col("o_orderkey") % 7 / 9.7).alias("f"))
    return rows.where("g > 0 AND f > 0 AND w > f").select("o_orderkey", *runstats.generation_stats(F.col("p"), F.col("g"), F.col("w"), F.col("f")))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS batch_size, sum(l_quantity::BIGINT)::BIGINT AS t, sum(l_linenumber)::BIGINT AS st, sum((l_extendedprice * 100)::BIGINT) / 9999700.0::DOUBLE AS sec FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, batch_size, t AS batch_total_tokens, st AS batch_total_steps, round(t / (sec + 1e-9::DOUBLE), 2) AS batch_tokens_per_second, round(sec / (t + 1e-9::DOUBLE) * 1000, 3) AS effective_ms_per_token, round(t / greatest(st, 1), 3) AS tokens_per_step
FROM lineitem l JOIN s USING (l_orderkey)""")
def batch_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").alias("steps"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    rows = rows.withColumn("s", F.col("cents").cast("decimal(20,0)"))
    out = runstats.with_batch_stats(rows.withColumn("s", F.col("cents") / 9999700.0), "l_orderkey", "q", "steps", "s")
    return out.drop("q", "steps", "cents", "s")


@query("""WITH r AS (SELECT p_partkey, p_size::BIGINT AS a, p_retailprice / 997.3::DOUBLE AS ta, (p_partkey % 1000)::BIGINT AS b, (p_partkey % 13)::BIGINT AS st, p_size / 7.1::DOUBLE AS tb FROM part)
SELECT p_partkey, round(ta + tb, 4) AS t_total_seconds, round(a / (ta + tb + 1e-9::DOUBLE), 2) AS overall_tps, round((ta + tb) / (a + 1e-9::DOUBLE) * 1000, 3) AS effective_ms_per_token, round(b / (tb + 1e-9::DOUBLE), 2) AS summary_tps, round(b / greatest(st, 1), 3) AS tokens_per_step FROM r""")
def two_step_stats(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", *runstats.two_step_stats(size, F.col("p_retailprice") / 997.3, key % 1000, key % 13, size / 7.1))


@query("""SELECT event_type AS mode, count(*) AS tasks, count(*) FILTER (WHERE event_id % 11 = 0) AS errors, round(coalesce(sum(value) FILTER (WHERE event_id % 11 <> 0), 0) / greatest(count(*) FILTER (WHERE event_id % 11 <> 0), 1), 4) AS avg_wall,
round(coalesce(sum(user_id) FILTER (WHERE event_id % 11 <> 0), 0) / greatest(count(*) FILTER (WHERE event_id % 11 <> 0), 1), 4) AS avg_tokens FROM events GROUP BY 1""")
def mode_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "mode")
    found = runstats.mode_report(rows, "mode", F.col("event_id") % 11 == 0, F.col("value"), F.col("user_id").cast("double"))
    return found.withColumns({c: F.round(c, 4) for c in ("avg_wall", "avg_tokens")})


_TASKS = "(SELECT l_orderkey, count(*) AS n_files, sum(l_quantity::BIGINT)::BIGINT % 101 AS score FROM lineitem GROUP BY 1)"


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_files"), (F.sum(F.col("l_quantity").cast("long")) % 101).alias("score"))


@query(f"""(SELECT 'exact' AS rule, l_orderkey, n_files FROM {_TASKS} WHERE n_files = 3 ORDER BY l_orderkey LIMIT 20) UNION ALL (SELECT 'least', l_orderkey, n_files FROM {_TASKS} WHERE n_files >= 6 ORDER BY l_orderkey LIMIT 15)
UNION ALL (SELECT 'between', l_orderkey, n_files FROM {_TASKS} WHERE n_files BETWEEN 2 AND 4 ORDER BY l_orderkey LIMIT 10) UNION ALL (SELECT 'most', l_orderkey, n_files FROM {_TASKS} WHERE n_files <= 1)""")
def filecount_rules(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    rules = {"exact": {"exact": 3, "limit": 20}, "least": {"least": 6, "limit": 15}, "between": {"least": 2, "most": 4, "limit": 10}, "most": {"most": 1}}
    found = [runstats.by_count(tasks, "n_files", "l_orderkey", **r).select(F.lit(name).alias("rule"), "l_orderkey", "n_files") for name, r in rules.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query(f"""WITH c AS (SELECT *, n_files = 1 AND l_orderkey % 5 <> 0 AS f FROM {_TASKS} WHERE n_files <= 2), k AS (SELECT greatest(count(*) - 100, 0) AS k FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY f DESC, CASE WHEN f THEN score END, CASE WHEN f THEN l_orderkey ELSE -l_orderkey END) AS i FROM c) SELECT l_orderkey, n_files FROM r, k WHERE i > k""")
def trim_to_target(spark, sf_dir):
    chosen = _tasks(spark, sf_dir).where("n_files <= 2")
    single = (F.col("n_files") == 1) & (F.col("l_orderkey") % 5 != 0)
    return runstats.trim(chosen, 100, single, "score", "l_orderkey").select("l_orderkey", "n_files")


@query(f"""WITH c AS (SELECT * FROM {_TASKS} WHERE n_files = 7), k AS (SELECT count(*) AS n FROM c), r AS (SELECT l_orderkey, score FROM {_TASKS} WHERE n_files = 6 ORDER BY score DESC, l_orderkey LIMIT 30)
SELECT l_orderkey, score FROM c UNION ALL SELECT l_orderkey, score FROM r""")
def fill_to_target(spark, sf_dir):
    tasks = _tasks(spark, sf_dir).select("l_orderkey", "n_files", "score")
    chosen = tasks.where("n_files = 7")
    return selection.fill(chosen, tasks.where("n_files = 6"), "l_orderkey", "score", chosen.count() + 30).select("l_orderkey", "score")


@query("SELECT doc_id, (row_number() OVER (ORDER BY n_chars NULLS FIRST, doc_id) - 1) % 7 AS shard FROM documents")
def round_robin(spark, sf_dir):
    return runstats.round_robin(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 7).select("doc_id", "shard")


@query("SELECT l_returnflag, l_linestatus, string_agg(l_linenumber || ':' || n, ' ' ORDER BY l_linenumber) AS points FROM (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1, 2")
def threshold_series(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    found = runstats.series(each, ["l_returnflag", "l_linestatus"], "l_linenumber", "n")
    return found.select("l_returnflag", "l_linestatus", F.array_join(F.transform("series", lambda p: F.concat(p["at"].cast("string"), F.lit(":"), p["value"].cast("string"))), " ").alias("points"))


@query("SELECT l_orderkey, size::INTEGER AS size, sum(CASE WHEN l_linenumber <= size THEN l_quantity::DOUBLE ELSE 0 END) AS baseline FROM lineitem, (VALUES (1), (2), (4)) s(size) GROUP BY 1, 2")
def prefix_baseline(spark, sf_dir):
    return runstats.prefix_baseline(table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), "l_orderkey", "l_linenumber", "q", [1, 2, 4])


@query("""WITH t AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer), n AS (SELECT count(*) AS n FROM customer),
s(size, rep) AS (SELECT 4, unnest(range(0, 4)) UNION ALL SELECT 6, unnest(range(0, 2)) UNION ALL SELECT 32, 0), w AS (SELECT size, rep, unnest(range(0, size)) AS i FROM s)
SELECT size::INTEGER AS size, rep::INTEGER AS rep, i::INTEGER AS i, c_custkey FROM w, n JOIN t ON t.place = (rep * size + i) % n + 1""")
def cyclic_slices(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return runstats.cyclic_slices(people, "c_acctbal", "c_custkey", [4, 6, 32], 16).select("size", "rep", "i", "c_custkey")


@query("""SELECT b.place, b.o_orderkey, l.l_quantity::DOUBLE AS value FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 3 = 0) b
LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) l ON l.l_orderkey = b.o_orderkey""")
def baseline_order(spark, sf_dir):
    baseline = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_orderkey")
    samples = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("double").alias("value"))
    return runstats.in_baseline_order(baseline, samples, "o_orderkey", "o_orderkey").select("place", "o_orderkey", "value")


@query("SELECT l_linenumber, " + ", ".join(f"arg_max(l_quantity::DOUBLE, struct_pack(a := l_orderkey, b := l_quantity)) FILTER (WHERE l_returnflag = '{f}') AS \"{f}\"" for f in "ANR") + " FROM lineitem GROUP BY 1")
def heatmap_last(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    return runstats.last_wins(rows, "l_linenumber", "l_returnflag", ["A", "N", "R"], "q", F.struct("l_orderkey", "q"))


@query("SELECT l_suppkey, l_linenumber, round(avg(l_quantity), 6) AS mean, max(l_quantity)::DOUBLE AS most, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY mean DESC, l_suppkey, l_linenumber LIMIT 20")
def top_configs(spark, sf_dir):
    return runstats.top_groups(table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), ["l_suppkey", "l_linenumber"], "q", 20)


_CAPS = """c(cap, size) AS (VALUES (500, 4), (1000, 4), (2000, 4), (500, 8), (1000, 8), (2000, 8)), t AS (SELECT doc_id, cap, size, n_chars, CASE WHEN n_chars > cap THEN greatest(floor((n_chars // 4) * cap / greatest(n_chars, 1)), 1) ELSE n_chars // 4 END::BIGINT + 40 AS tok FROM documents, c),
b AS (SELECT cap, size, n_chars, tok, (row_number() OVER (PARTITION BY cap, size ORDER BY tok, doc_id) - 1) // size AS batch FROM t), p AS (SELECT cap, size, batch, max(tok) * count(*) - sum(tok) AS pad, sum(greatest(n_chars - cap, 0)) AS cut FROM b GROUP BY ALL),
g AS (SELECT cap::INTEGER AS cap, size::INTEGER AS size, round(sum(pad) / 1000.0 + 2 * sum(cut) / 10000.0, 6) AS composite FROM p GROUP BY ALL)"""


@query(f"WITH {_CAPS} (SELECT 'any' AS pick, * FROM g ORDER BY composite, cap, size LIMIT 1) UNION ALL (SELECT 'of four', * FROM g WHERE size = 4 ORDER BY composite, cap, size LIMIT 1)")
def best_caps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("n_chars") / 4).alias("tokens"))
    grid = [selection.cap_grid(docs, "doc_id", "n_chars", "tokens", [500, 1000, 2000], k, 40).select("cap", F.lit(k).alias("size"), "composite") for k in (4, 8)]
    every = grid[0].union(grid[1])
    pick = lambda name, condition: runstats.best_of(every, "composite", ["cap", "size"], condition).select(F.lit(name).alias("pick"), "cap", "size", "composite")
    return pick("any", None).union(pick("of four", F.col("size") == 4))


@query("SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lines, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS orders")
def subset_checks(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    count = lambda a, b, name: runstats.missing(a, b, "k").agg(F.count(F.lit(1)).alias(name))
    return count(lines, orders, "lines").crossJoin(count(orders, lines, "orders"))


@query("SELECT DISTINCT l_linenumber, l_linenumber * 2 AS twice FROM lineitem ORDER BY l_linenumber DESC")
def grid_values(spark, sf_dir):
    return runstats.grid_values(table(spark, sf_dir, "lineitem"), "l_linenumber").withColumn("twice", F.col("l_linenumber") * 2)


@query("SELECT p_partkey, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_by_metric(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    score = runstats.metric(parts, "p_retailprice", ("p_size", "p_retailprice"))
    return parts.select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(10)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 100 // (event_id % 5) END::BIGINT AS tokens, CASE WHEN event_id % 5 = 0 THEN 'ZeroDivisionError: integer division or modulo by zero' END AS error FROM events""")
def error_rows(spark, sf_dir):
    return runstats.guarded(table(spark, sf_dir, "events").select("event_id"), lambda r: {"tokens": 100 // (r["event_id"] % 5)}, "tokens bigint")


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(said, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda x: lower(x)), ['gethttpresponse_' || c_custkey || '.tar'], ['get', 'http', 'response'],
list_filter([c_custkey || '.tar'], lambda x: length(x) > 2)))), ' ') AS names FROM (SELECT c_custkey, 'You are a system_Prompt x' || chr(10) || 'def f_' || c_mktsegment || '(aB, c): return ' || replace(c_name, '#', '_') AS said FROM customer)""")
def task_identifiers(spark, sf_dir):
    said = F.concat(F.lit("def f_"), "c_mktsegment", F.lit("(aB, c): return "), F.replace("c_name", F.lit("#"), F.lit("_")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.lit("You are a system_Prompt x"), said).alias("said"), F.array(F.concat(F.lit("src/main/getHTTPResponse_"), "c_custkey", F.lit(".tar.gz"))).alias("files"))
    return rows.select("c_custkey", F.array_join(F.array_sort(text.task_identifiers(F.col("said"), F.col("files"))), " ").alias("names"))


@query("SELECT p_partkey, 'bs' || p_size || '_sbs8_th' || CASE WHEN p_size % 10 = 0 THEN (p_size // 10)::VARCHAR ELSE printf('%.1f', p_size / 10.0) END || '_smnt64_cmnt128' AS config FROM part")
def two_step_names(spark, sf_dir):
    name = text.two_step_name(F.col("p_size"), F.lit(8), F.col("p_size") / 10, F.lit(64), F.lit(128))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("config"))


_FORMS = "(VALUES (true, true, true), (true, true, false), (true, false, true), (true, false, false), (false, true, true), (false, true, false), (false, false, true), (false, false, false)) f(tags, examples, in_system)"


@query(f"""WITH d AS (SELECT n_nationkey, 'diff --git a/f' || n_nationkey || '.py b/f' || n_nationkey || '.py' || chr(10) || '+x' AS diff FROM nation),
p AS (SELECT *, 'Say what changes.' || CASE WHEN examples THEN chr(10) || chr(10) || 'For example: fix.' ELSE '' END AS told, '--- START OF CODE DIFF ---' || chr(10) || diff || chr(10) || '--- END OF CODE DIFF ---' AS body FROM d, {_FORMS})
SELECT n_nationkey, tags, examples, in_system, CASE WHEN in_system THEN 'system,user' ELSE 'user' END AS roles, sha256(CASE WHEN in_system THEN told || '|' || body ELSE told || chr(10) || chr(10) || body END) AS said FROM p""")
def prompt_forms(spark, sf_dir):
    """All eight forms: tags around the label or none, examples or none, instructions in the system or in the user message."""
    path = F.concat(F.lit("f"), "n_nationkey", F.lit(".py"))
    diff = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n+x\n"))
    commits = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("owner"), F.lit("r").alias("repo"), F.lit("0123456789").alias("commit_sha"), diff.alias("diff"), F.lit("Fix it").alias("message"), F.array(path).alias("files"))
    out = None
    for tags in (True, False):
        for examples in (True, False):
            for in_system in (True, False):
                each = building.build_tasks(commits, "Say what changes.", examples="For example: fix." if examples else "", tags=tags, in_system=in_system)
                each = each.select(
                    F.element_at(F.split("task_id", "_"), 1).cast("int").alias("n_nationkey"), F.lit(tags).alias("tags"), F.lit(examples).alias("examples"), F.lit(in_system).alias("in_system"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.sha2(F.array_join(F.transform("messages", lambda m: m["content"]), "|").cast("binary"), 256).alias("said"),
                )
                out = each if out is None else out.union(each)
    return out


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY src, event_id) AS k FROM (SELECT 1 AS src, * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 0, * FROM events WHERE event_id % 3 = 0)) WHERE k = 1")
def final_over_checkpoint(spark, sf_dir):
    """Records of a finished run win over those of its checkpoint; within one, the first."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    final, checkpoint = events.where("event_id % 3 = 0"), events.where("event_id % 2 = 0")
    ranked = final.withColumn("src", F.lit(0)).union(checkpoint.withColumn("src", F.lit(1))).withColumn("at", F.struct("src", "event_id"))
    return runs.keep_first(ranked, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id")


@query("""WITH p AS (SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A')::DOUBLE AS "A", max(l_quantity) FILTER (WHERE l_returnflag = 'N')::DOUBLE AS "N", max(l_quantity) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS "R" FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN "A" = greatest("A", "N", "R") THEN 'A' ELSE '' END || CASE WHEN "N" = greatest("A", "N", "R") THEN 'N' ELSE '' END || CASE WHEN "R" = greatest("A", "N", "R") THEN 'R' ELSE '' END AS best FROM p""")
def best_in_row(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double")).groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("q"))
    return runstats.best_in_row(rows, ["A", "N", "R"]).select("l_orderkey", F.array_join("best", "").alias("best"))


@query("""SELECT c_custkey, round(len(list_intersect(list_distinct(list_transform(regexp_extract_all(said, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda x: lower(x))), ['get', 'building', 'machinery', 'return'])) / 4.0, 6) AS rate
FROM (SELECT c_custkey, 'Return what get_' || c_mktsegment || ' GET ' || c_mktsegment AS said FROM customer)""")
def identifier_preservation(spark, sf_dir):
    said = text.identifiers(F.concat(F.lit("Return what get_"), "c_mktsegment", F.lit(" GET "), "c_mktsegment"))
    names = F.array(*map(F.lit, ["get", "building", "machinery", "return"]))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(runstats.preservation(said, names), 6).alias("rate"))


@query("SELECT l_linenumber, l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY l_linenumber, l_suppkey, l_partkey LIMIT 50")
def sorted_configs(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return each.orderBy("l_linenumber", "l_suppkey", "l_partkey").limit(50)
