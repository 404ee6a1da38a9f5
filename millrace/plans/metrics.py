"""Similarity metrics over pairs of turns, and the summary by mode."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text
from ..operators import evaluation
from .catalog import query, table


def _pairs(spark, sf_dir):
    return evaluation.answer_pairs(table(spark, sf_dir, "conversations"))


_SIMPLE = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"
_NORM = "list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')"


def _components(tokens: str) -> str:
    return f"""pairs AS (SELECT a.conv_id, a.turn, {tokens.format('a.text')} AS r, {tokens.format('b.text')} AS h
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
n(n) AS (VALUES (1), (2), (3), (4)),
hg AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, unnest(CASE WHEN len(h) >= n THEN list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i+n-1], chr(1))) ELSE [] END) AS g FROM pairs, n) GROUP BY ALL),
rg AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, unnest(CASE WHEN len(r) >= n THEN list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i+n-1], chr(1))) ELSE [] END) AS g FROM pairs, n) GROUP BY ALL),
m AS (SELECT conv_id, turn, n, sum(least(hg.c, rg.c)) AS m FROM hg JOIN rg USING (conv_id, turn, n, g) GROUP BY 1, 2, 3),
comp AS (SELECT p.conv_id, p.turn, len(h)::BIGINT AS hl, len(r)::BIGINT AS rl, {', '.join(f"coalesce(max(m.m) FILTER (WHERE m.n = {k}), 0)::BIGINT AS m{k}, greatest(len(h) - {k - 1}, 0)::BIGINT AS t{k}" for k in range(1, 5))}
FROM pairs p LEFT JOIN m ON p.conv_id = m.conv_id AND p.turn = m.turn GROUP BY p.conv_id, p.turn, h, r)"""


def _bleu(m="m{}", t="greatest(t{}, 1)", h="hl", r="rl"):
    logs = " + ".join(f"ln((CASE WHEN {m.format(k)} = 0 THEN 0.1::DOUBLE ELSE {m.format(k)}::DOUBLE END) / {t.format(k)})" for k in range(1, 5))
    return f"CASE WHEN {m.format(1)} = 0 OR {h} = 0 OR {r} = 0 THEN 0.0 ELSE (CASE WHEN {h} > {r} THEN 1.0 ELSE exp(1 - {r}::DOUBLE / greatest({h}, 1)) END) * exp(({logs}) / 4) END"


@query(f"WITH {_components(_SIMPLE)} SELECT conv_id, turn, m1, m2, m3, m4, t1, t2, t3, t4, round({_bleu()}, 6) AS bleu4 FROM comp")
def bleu_pairs(spark, sf_dir):
    counts = evaluation.ngram_counts(_pairs(spark, sf_dir), ["conv_id", "turn"], text.tokens)
    return counts.withColumn("bleu4", F.round(evaluation.bleu_of(), 6)).drop("h", "r")


@query(f"WITH {_components(_NORM)} SELECT conv_id, turn, round({_bleu()}, 6) AS bleu_norm FROM comp")
def bleu_norm(spark, sf_dir):
    counts = evaluation.ngram_counts(_pairs(spark, sf_dir), ["conv_id", "turn"], text.norm_tokens)
    return counts.select("conv_id", "turn", F.round(evaluation.bleu_of(), 6).alias("bleu_norm"))


_SUMS = ", ".join(f"sum(m{k})::BIGINT AS m{k}, sum(greatest(t{k}, 1))::BIGINT AS t{k}" for k in range(1, 5))


@query(f"WITH {_components(_SIMPLE)}, s AS (SELECT conv_id % 2 AS mode, {_SUMS}, sum(hl)::BIGINT AS hl, sum(rl)::BIGINT AS rl FROM comp GROUP BY 1) SELECT mode, m1, t1, m4, t4, round({_bleu()}, 6) AS bleu4 FROM s")
def bleu_corpus(spark, sf_dir):
    counts = evaluation.ngram_counts(_pairs(spark, sf_dir), ["conv_id", "turn"], text.tokens).withColumn("mode", F.col("conv_id") % 2)
    return evaluation.corpus_sums(counts, ["mode"]).select("mode", "m1", "t1", "m4", "t4", F.round(evaluation.bleu_of(), 6).alias("bleu4"))


_F = "CASE WHEN m{0} = 0 OR t{0} = 0 THEN 0.0 ELSE 2 * (m{0} / greatest(t{0}, 1)) * (m{0} / greatest(rl - {1}, 1)) / (m{0} / greatest(t{0}, 1) + m{0} / greatest(rl - {1}, 1)) END"


@query(f"WITH {_components(_NORM)} SELECT conv_id, turn, round({_F.format(1, 0)}, 6) AS rouge1, round({_F.format(2, 1)}, 6) AS rouge2 FROM comp")
def rouge12(spark, sf_dir):
    counts = evaluation.ngram_counts(_pairs(spark, sf_dir), ["conv_id", "turn"], text.norm_tokens)
    score = lambda n: F.round(sim.f_score(F.col(f"m{n}"), F.col(f"t{n}"), F.greatest(F.col("r") - (n - 1), F.lit(0))), 6)
    return counts.select("conv_id", "turn", score(1).alias("rouge1"), score(2).alias("rouge2"))


@query()
def rouge_stemmed(spark, sf_dir):
    """ROUGE-1, 2 and L over stems of words of more than three letters; a kernel in Python, which SQL lacks, and tests compare it with plain Python."""
    cut = lambda c: sim.stems(text.norm_tokens(F.col(c)), longer_than=3)
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", cut("hyp").alias("h"), cut("ref").alias("r"))
    rows = rows.select("conv_id", "turn", sim.overlaps(F.col("h"), F.col("r"), 2).alias("m"), sim.common_subsequence("h", "r").alias("c"), F.size("h").alias("h"), F.size("r").alias("r"))
    two = sim.f_score(F.get("m", F.lit(1)), F.greatest(F.col("h") - 1, F.lit(0)), F.greatest(F.col("r") - 1, F.lit(0)))
    return rows.select("conv_id", "turn", F.round(sim.f_score(F.get("m", F.lit(0)), F.col("h"), F.col("r")), 6).alias("rouge1"), F.round(two, 6).alias("rouge2"), F.round(sim.f_score(F.col("c"), F.col("h"), F.col("r")), 6).alias("rouge_l"))


@query()
def meteor_pairs(spark, sf_dir):
    """Exact and stem matches; no synonyms."""
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", text.tokens(F.col("hyp")).alias("h"), text.tokens(F.col("ref")).alias("r"))
    return rows.select("conv_id", "turn", F.round(sim.meteor("h", "r"), 6).alias("meteor"))


@query()
def meteor_synonyms(spark, sf_dir):
    """With a third stage; words of the references that begin with the same four letters stand for synonyms, as the tables have none. Tests compare it with plain Python."""
    pairs = _pairs(spark, sf_dir)
    words = pairs.select(F.explode(text.tokens(F.col("ref"))).alias("word")).distinct().where("length(word) > 4")
    found = evaluation.meteor_by_synonyms(pairs, ["conv_id", "turn"], text.tokens, words.select("word", F.substring("word", 1, 4).alias("synset")))
    return found.withColumn("meteor", F.round("meteor", 6))


@query()
def bleu_code_strict(spark, sf_dir):
    """Stemmed tokens of code, without tolerance for names; tests compare it with plain Python."""
    counts = evaluation.code_counts(_pairs(spark, sf_dir), ["conv_id", "turn"], tolerant=False)
    return counts.select("conv_id", "turn", F.round(evaluation.bleu_of(), 6).alias("bleu_code"))


@query(f"WITH {_components(_NORM)}, s AS (SELECT conv_id % 2 AS mode, {_SUMS}, sum(hl)::BIGINT AS hl, sum(rl)::BIGINT AS rl FROM comp GROUP BY 1) SELECT mode, m1, t1, m4, t4, round({_bleu()}, 6) AS bleu_norm FROM s")
def bleu_norm_corpus(spark, sf_dir):
    counts = evaluation.ngram_counts(_pairs(spark, sf_dir), ["conv_id", "turn"], text.norm_tokens).withColumn("mode", F.col("conv_id") % 2)
    return evaluation.corpus_sums(counts, ["mode"]).select("mode", "m1", "t1", "m4", "t4", F.round(evaluation.bleu_of(), 6).alias("bleu_norm"))


@query()
def bleu_code(spark, sf_dir):
    """Stemmed tokens of code, where names that the prompt has may be said without loss."""
    return _code_counts(spark, sf_dir).select("conv_id", "turn", F.round(evaluation.bleu_of(), 6).alias("bleu_code"))


_CIDER = """w AS (SELECT *, len(h) AS lh, len(r) AS lr FROM pairs), d AS (SELECT n, g, count(*) AS df FROM rg GROUP BY 1, 2), k AS (SELECT count(*) AS docs FROM pairs),
hw AS (SELECT hg.conv_id, hg.turn, hg.n, hg.g, hg.c / greatest(lh - hg.n + 1, 1) * ln(greatest(docs, 1) / greatest(coalesce(df, 0), 1)) AS w FROM hg JOIN w USING (conv_id, turn) LEFT JOIN d ON hg.n = d.n AND hg.g = d.g, k),
rw AS (SELECT rg.conv_id, rg.turn, rg.n, rg.g, rg.c / greatest(lr - rg.n + 1, 1) * ln(greatest(docs, 1) / greatest(coalesce(df, 0), 1)) AS w FROM rg JOIN w USING (conv_id, turn) LEFT JOIN d ON rg.n = d.n AND rg.g = d.g, k),
dot AS (SELECT conv_id, turn, sum(hw.w * rw.w) AS dot FROM hw JOIN rw USING (conv_id, turn, n, g) GROUP BY 1, 2),
a AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS a FROM hw GROUP BY 1, 2), b AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS b FROM rw GROUP BY 1, 2)
SELECT conv_id, turn, round(coalesce(CASE WHEN a * b > 0 THEN 10 * dot / (a * b) END, 0.0), 6) AS cider FROM pairs LEFT JOIN dot USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)"""


@query(f"WITH {_components(_NORM)}, {_CIDER}")
def cider_pairs(spark, sf_dir):
    return evaluation.cider_variant(_pairs(spark, sf_dir), ["conv_id", "turn"], "evaluated").withColumn("cider", F.round("cider", 6))


@query(f"WITH {_components(_SIMPLE)}, {_CIDER}")
def cider_simple(spark, sf_dir):
    return evaluation.cider_variant(_pairs(spark, sf_dir), ["conv_id", "turn"], "simple").withColumn("cider", F.round("cider", 6))


def _code_counts(spark, sf_dir):
    return evaluation.code_counts(_pairs(spark, sf_dir), ["conv_id", "turn"], tolerant=True)


@query()
def bleu_code_corpus(spark, sf_dir):
    """The third corpus score: sums of the counts of BLEU-CODE, then the formula once; tests add them up in plain Python."""
    counts = _code_counts(spark, sf_dir).withColumn("mode", F.col("conv_id") % 2)
    return evaluation.corpus_sums(counts, ["mode"]).select("mode", "m1", "t1", "m4", "t4", F.round(evaluation.bleu_of(), 6).alias("bleu_code"))


@query(f"""WITH {_components(_SIMPLE)}, q AS (SELECT conv_id % 2 AS mode, round({_bleu()}, 4) AS bleu4, hl, hl / (rl * 0.05 + 1e-9) AS tps FROM comp)
SELECT mode, count(*) AS samples, round(avg(bleu4), 6) AS avg_bleu4, round(avg(hl), 6) AS avg_tokens, round(avg(round(CASE WHEN round(tps, 4) > 0 THEN bleu4 * log2(1 + round(tps, 4)) ELSE 0 END, 4)), 6) AS avg_qs, round(median(round(tps, 4)), 6) AS median_tps FROM q GROUP BY mode""")
def eval_summary(spark, sf_dir):
    """The flagship: pairs scored and summed up by mode; seconds stand in for a clock at 0.05 a reference word."""
    counts = evaluation.ngram_counts(_pairs(spark, sf_dir), ["conv_id", "turn"], text.tokens)
    tps = F.round(F.col("h") / (F.col("r") * 0.05 + 1e-9), 4)
    rows = counts.select((F.col("conv_id") % 2).alias("mode"), F.round(evaluation.bleu_of(), 4).alias("bleu4"), "h", tps.alias("tps"))
    rows = rows.withColumn("qs", F.round(sim.speed_quality(F.col("bleu4"), F.col("tps")), 4))
    return rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("bleu4"), 6).alias("avg_bleu4"), F.round(F.avg("h"), 6).alias("avg_tokens"), F.round(F.avg("qs"), 6).alias("avg_qs"), F.round(F.median("tps"), 6).alias("median_tps")
    )
