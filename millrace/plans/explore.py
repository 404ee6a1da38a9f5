"""Corpus exploration: totals, histograms, months, top values, extensions, percentiles, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diffs, text
from ..operators import pages, stats
from ..operators.percentiles import exact_percentiles
from .catalog import query, table

#: The limits of a report's buckets.
BUCKETS = ((1_000, "0-1k"), (5_000, "1k-5k"), (10_000, "5k-10k"), (50_000, "10k-50k"), (None, "50k+"))


@query("""SELECT count(*) AS total, count(DISTINCT source) AS sources, round_even(avg(length(text)), 0)::BIGINT AS avg_len, max(length(text))::BIGINT AS max_len,
round_even(avg(coalesce(n_chars, 0)), 0)::BIGINT AS avg_chars, max(coalesce(n_chars, 0))::BIGINT AS max_chars, sum(coalesce(n_chars, 0))::BIGINT AS sum_chars FROM documents""")
def explore_summary(spark, sf_dir):
    n, c = F.length("text"), F.coalesce("n_chars", F.lit(0))
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("source").alias("sources"), F.bround(F.avg(n)).cast("long").alias("avg_len"), F.max(n).cast("long").alias("max_len"),
        F.bround(F.avg(c)).cast("long").alias("avg_chars"), F.max(c).alias("max_chars"), F.sum(c).alias("sum_chars"),
    )


@query("""WITH b(bucket, lo, hi) AS (VALUES ('0-1k', 0, 1000), ('1k-5k', 1000, 5000), ('5k-10k', 5000, 10000), ('10k-50k', 10000, 50000), ('50k+', 50000, 1000000000))
SELECT bucket, count(doc_id) AS n FROM b LEFT JOIN documents d ON length(d.text) >= lo AND length(d.text) < hi GROUP BY bucket""")
def length_buckets(spark, sf_dir):
    return stats.bucket_counts(table(spark, sf_dir, "documents"), F.length("text"), BUCKETS)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 5")
def top_sources(spark, sf_dir):
    return stats.most_common(table(spark, sf_dir, "documents"), "source", "doc_id", 5)


@query("""WITH p AS (SELECT page_id, 'src/' || lower(regexp_replace(p_type, '[^A-Za-z]+', '.', 'g')) || '/f' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.md' WHEN 2 THEN '' ELSE '.tar.gz' END AS path FROM (SELECT p_partkey AS page_id, * FROM part)),
s AS (SELECT path, regexp_extract(path, '[^/]*$') AS base FROM p)
SELECT lower(regexp_extract(base, '^.+(\\.[^.]+)$', 1)) AS suffix, CASE WHEN contains(path, '.') AND NOT starts_with(path, '.') THEN regexp_extract(path, '[^.]*$') ELSE 'no_extension' END AS plain_ext, count(*) AS n
FROM s GROUP BY 1, 2""".replace("\\\\", "\\"))
def extension_counts(spark, sf_dir):
    tail = F.when(F.col("p_partkey") % 4 == 0, ".PY").when(F.col("p_partkey") % 4 == 1, ".md").when(F.col("p_partkey") % 4 == 2, "").otherwise(".tar.gz")
    path = F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_type", "[^A-Za-z]+", ".")), F.lit("/f"), F.col("p_partkey"), tail)
    found = table(spark, sf_dir, "part").select(diffs.suffix(path).alias("suffix"), diffs.plain_extension(path).alias("plain_ext"))
    return found.groupBy("suffix", "plain_ext").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[^\\s]+'))::BIGINT AS words, len(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '[a-z0-9]+'))::BIGINT AS norm_words FROM documents")
def token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.word_count(F.col("text")).alias("words"), F.size(text.norm_tokens(F.col("text"))).cast("long").alias("norm_words"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda x: lower(x)))), ' ') AS names FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~\\n]', ' ', 'g') AS text FROM conversations)")
def identifiers(spark, sf_dir):
    plain = F.regexp_replace("text", r"[^ -~\n]", " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(text.identifiers(plain)), " ").alias("names"))


@query("""SELECT c_custkey, trim(regexp_replace(replace(regexp_replace(regexp_replace(camel, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_', ' '), '\\s+', ' ', 'g')) AS parts
FROM (SELECT c_custkey, 'getHTTPResponse_' || c_mktsegment || 'Code' || c_custkey AS camel FROM customer)""")
def split_names(spark, sf_dir):
    name = F.concat(F.lit("getHTTPResponse_"), "c_mktsegment", F.lit("Code"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", text.squeeze(text.split_identifiers(name)).alias("parts"))


@query()
def normalize_labels(spark, sf_dir):
    """The rules on whole texts of all documents. DuckDB's word bounds are ASCII's, so tests compare it with labels made by hand."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_label(F.col("text")).alias("label"))


@query()
def semantic_labels(spark, sf_dir):
    """Chains of lookarounds, which DuckDB's engine lacks; tests compare whole texts with labels made by hand."""
    return table(spark, sf_dir, "documents").select("doc_id", text.final_label(F.col("text")).alias("label"))


@query("""SELECT conv_id, turn, trim(text, chr(10) || ' ') AS inner_text, CASE WHEN regexp_extract(line, '^(.*?[.!?])(?:\\s|$)', 1) = '' THEN line ELSE regexp_extract(line, '^(.*?[.!?])(?:\\s|$)', 1) END AS sentence
FROM (SELECT conv_id, turn, text, trim(split_part(text, chr(10), 1)) AS line FROM conversations WHERE text <> '')""")
def strip_tags(spark, sf_dir):
    wrapped = F.concat(F.lit("noise <MSG> "), "text", F.lit(" </msg> more"))
    rows = table(spark, sf_dir, "conversations").where("text <> ''")
    return rows.select("conv_id", "turn", text.strip_message_tags(wrapped).alias("inner_text"), text.first_sentence(F.col("text")).alias("sentence"))


@query("""SELECT lang, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(median(n_chars), 6) AS med,
(list_sort(list(n_chars)))[(count(*) // 2) + 1]::BIGINT AS upper_median FROM documents GROUP BY lang""")
def percentiles(spark, sf_dir):
    each = exact_percentiles(table(spark, sf_dir, "documents"), ["n_chars"], [0.25, 0.5, 0.95], ["lang"], upper_median=True)
    p = [F.round(F.col("percentiles")[i], 6) for i in range(3)]
    return each.select("lang", p[0].alias("p25"), p[1].alias("p50"), p[2].alias("p95"), p[1].alias("med"), F.col("upper_median").cast("long").alias("upper_median"))


#: Of several columns, and of the rows of each order, what a profile of a dataset shows.
PROFILE = (0.25, 0.5, 0.75, 0.9, 0.95)
_PROFILED = ("l_quantity", "l_extendedprice", "l_partkey")
_ROW = "SELECT '{0}' AS \"column\", count({0}) AS n, min({0})::DOUBLE AS least, " + ", ".join(f"round(quantile_cont({{0}}::DOUBLE, {p}), 4) AS p{p * 100:.0f}" for p in PROFILE) + ", max({0})::DOUBLE AS largest, round(avg({0}), 4) AS mean, (list_sort(list({0})))[(count({0}) // 2) + 1]::DOUBLE AS upper_median FROM {1}"


def _profile(df, columns):
    each = exact_percentiles(df, list(columns), list(PROFILE), upper_median=True)
    return each.select("column", "n", "least", *[F.round(F.col("percentiles")[i], 4).alias(f"p{p * 100:.0f}") for i, p in enumerate(PROFILE)], "largest", F.round("mean", 4).alias("mean"), "upper_median")


@query(" UNION ALL ".join(_ROW.format(c, "lineitem") for c in _PROFILED) + " UNION ALL " + _ROW.format("files", "(SELECT count(*) AS files FROM lineitem GROUP BY l_orderkey)"))
def dataset_profile(spark, sf_dir):
    """Rows per order stand for files per task."""
    lines = table(spark, sf_dir, "lineitem")
    files = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"))
    return _profile(lines, _PROFILED).union(_profile(files, ["files"]))


@query("SELECT event_type, (json_extract_string(props, '$.k')::BIGINT % 10) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_stats(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the') OR contains(lower(source), 'the') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def paged_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(text.contains_ci("the", F.col("text"), F.col("source")))
    return docs.select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").offset(20).limit(20)


_KEYS = {"default": "doc_id", "ts_desc": "-coalesce(n_chars % 97, 0)", "ts_asc": "coalesce(n_chars % 97, 0)", "gt_desc": "-coalesce(n_chars, 0)", "gt_asc": "coalesce(n_chars, 0)", "label_short": "coalesce(length(source), -1e308)", "label_long": "-coalesce(length(source), -1e308)"}
PAGE, PER_PAGE = 2, 25


@query(" UNION ALL ".join(f"(SELECT '{name}' AS sorted_by, doc_id, row_number() OVER (ORDER BY {key}, doc_id) - 1 AS place FROM documents ORDER BY place LIMIT {PER_PAGE} OFFSET {PAGE * PER_PAGE})" for name, key in _KEYS.items()))
def sorted_pages(spark, sf_dir):
    """The third page in each of a viewer's seven orders; many sources and remainders are equal, so that ids settle most places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("speed"), "n_chars", "source")
    out = None
    for name, order in pages.sample_orders("speed", "n_chars", "source").items():
        one = pages.page_at(docs, order, "doc_id", PAGE, PER_PAGE).select(F.lit(name).alias("sorted_by"), "doc_id", F.col("_place").alias("place"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT p_partkey, CASE WHEN b >= 1073741824 THEN printf('%.2f', b / 1073741824.0) || ' GiB' ELSE printf('%.1f', b / 1048576.0) || ' MiB' END AS size, 'bs' || p_size || '_sbs8_th0.8_cacheTrue_batch4_mnt128' AS config FROM (SELECT *, p_size::BIGINT * 67108864 AS b FROM part)")
def run_names(spark, sf_dir):
    size = F.col("p_size").cast("long") * F.lit(67108864)
    name = text.config_name(F.col("p_size"), F.lit(8), F.lit(0.8), F.lit(True), F.lit(4), F.lit(128))
    return table(spark, sf_dir, "part").select("p_partkey", text.human_bytes(size).alias("size"), name.alias("config"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """An extension: the rules have no windows over time."""
    each = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return each.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
