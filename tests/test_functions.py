import math
import random
import re

from pyspark.sql import functions as F

from millrace.functions import diffs, similarity, text
from millrace.functions.stemming import stem
from millrace.operators import building, evaluation, runs, selection, stats
from millrace.plans import config


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_labels(spark):
    said = {
        "KAFKA-9 Speed up the cache": "speed up the cache",
        "wip: sort rows by date": "sort rows by date",
        "Bugfixing in the parser": "fix in the parser",
        "Handle empty input. Contributed by Lea Korn.": "handle empty input",
        "Drop old flag (Reviewed by Tom)": "drop old flag",
        "Rename field, closes pr #41": "rename field closes",
        "Bump to v3.1.4": "bump to",
    }
    assert one(spark, text.final_label, *said) == list(said.values())
    assert one(spark, text.clean_label, "Fix foo.com/x ABC-12: a b #3.", "", "x.org(y)") == ["Fix /x : a ", "", "x.org(y)"]
    assert one(spark, text.semantic_clean, "SPARK CORE ML fix issue 12 v1.2.3 in 7 x v2", "typo: cleanup - add y", "Bug in z") == ["fix in x", "add y", "fix in z"]


def test_tags_and_sentences(spark):
    assert one(spark, text.strip_message_tags, "a <MSG> x </msg> b", "<msg>only", "<msg>x<</msg>", "plain ") == ["x", "only", "x", "plain"]
    assert one(spark, text.first_sentence, "One. Two", "v1.2 is out! yes", "\nnext line.", "none") == ["One.", "v1.2 is out!", "next line.", "none"]
    assert one(spark, text.tokens, "A  b C", "", " ") == [["a", "b", "c"], [], []]
    assert one(spark, text.code_tokens, "getHTTPResponse my_var é1") == [["get", "http", "response", "my", "var", "1"]]


DIFF = "before\ndiff --git a/docs/R.md b/docs/R.md\n--- a\n+++ b\n-old\n+new\ndiff --git a/x b/y b/x b/y.py\n+import os\n+x = 1\n"


def test_diffs(spark):
    first, last = one(spark, diffs.split_diff, DIFF)[0], one(spark, diffs.split_diff_last, DIFF)[0]
    assert [f.file for f in first] == ["docs/R.md", "y b/x b/y.py"] and [f.file for f in last] == ["docs/R.md", "y.py"]
    assert first[1].chunk.endswith("x = 1\n") and last[1].chunk.endswith("x = 1")
    assert one(spark, diffs.code_part, DIFF, "no header", "") == [last[1].chunk, "", ""]
    assert one(spark, diffs.added_lines, DIFF) == [3] and one(spark, diffs.deleted_lines, DIFF) == [1]
    assert one(spark, diffs.length_by_file, DIFF + "diff --git a/docs/R.md b/docs/R.md\n+z")[0] == {"docs/R.md": len("diff --git a/docs/R.md b/docs/R.md\n+z"), "y b/x b/y.py": len(first[1].chunk)}
    assert one(spark, diffs.suffix, "a/B.PY", ".gitignore", "a.b/c", "x.tar.gz") == [".py", "", "", ".gz"]
    assert one(spark, diffs.plain_extension, ".gitignore", "a.B", "c") == ["no_extension", "B", "no_extension"]
    assert one(spark, lambda c: diffs.cut_at_line(c, 6), "ab\ncdef", "abcdefgh", "abc") == ["ab" + diffs.CUT, "abcdef" + diffs.CUT, "abc"]
    assert one(spark, diffs.between_marks, f"a {diffs.START} x {diffs.END} b", f"{diffs.END}{diffs.START}", "x") == ["x", None, None]
    files = spark.createDataFrame([(["a.py", "b.md", "c", "d.zig"],)], "f array<string>")
    assert files.select(diffs.languages(F.col("f")), diffs.excluded_suffixes(F.col("f"))).first() == (sorted(["Python", "unknown", ".zig"]), [".md"])


def test_file_diffs_fallbacks(spark):
    rows = [([("user", DIFF)],), ([("user", "no header")],), ([("system", "x")],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>")
    got = [[f.file for f in r[0]] for r in df.select(diffs.file_diffs(F.col("m"))).collect()]
    assert got == [["docs/R.md", "y.py"], ["(full diff)"], []]


def test_build_tasks(spark):
    rows = [("o", "r", "0123456789", DIFF, "Fix the thing", ["x/y.py", "a.md"]), ("o", "r", "1", "", "m", []), (None, None, None, DIFF, "", None)]
    df = spark.createDataFrame(rows, "owner string, repo string, commit_sha string, diff string, message string, files array<string>")
    got = building.build_tasks(df, "Say it.").orderBy(F.desc("task_id")).collect()
    assert [(r.task_id, r.reason) for r in got] == [("unknown_unknown_unknown", "empty label"), ("o_r_1", "empty diff"), ("o_r_0123456", None)]
    assert got[2].label == "<msg>fix the thing</msg>" and got[2].files == ["x/y.py"] and got[2].messages[0].content == "Say it."


def bleu(spark, hyp, ref):
    df = spark.createDataFrame([(1, hyp, ref)], "id int, hyp string, ref string")
    return evaluation.ngram_counts(df, ["id"], text.tokens).select(evaluation.bleu_of()).first()[0]


def test_bleu(spark):
    for hyp, ref, score in (("a b c d", "a b c d", 1.0), ("a b c d", "e f g h", 0.0), ("", "a", 0.0), ("a b", "a b", 0.1**0.5), ("a b c d", "a b c d e f g h", math.exp(-1)), ("a a a a", "a b", (0.25 * 0.1 / 3 * 0.05 * 0.1) ** 0.25)):
        assert abs(bleu(spark, hyp, ref) - score) < 1e-9, (hyp, ref)


def test_other_metrics(spark):
    df = spark.createDataFrame([(["a", "c", "d"], ["a", "b", "c", "d"]), (["x"], ["y"]), ([], ["a"]), (["running", "fast"], ["run", "fast"])], "h array<string>, r array<string>")
    lcs = [r[0] for r in df.select(similarity.common_subsequence("h", "r")).collect()]
    assert lcs == [3, 0, 0, 1]
    scores = [r[0] for r in df.select(similarity.meteor("h", "r")).collect()]
    assert scores[1] == scores[2] == 0 and scores[3] > 0.9 and 0 < scores[0] < 1
    assert one(spark, lambda c: similarity.speed_quality(F.lit(0.5), c.cast("double")), "3", "0") == [1.0, 0.0]
    pairs = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "x", "e f g h"), (3, "", "q r")], "id int, hyp string, ref string")
    got = {r.id: r.cider for r in evaluation.cider(pairs, ["id"], text.tokens).collect()}
    assert abs(got[1] - 10) < 1e-9 and got[2] == got[3] == 0


def test_stems():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer operator feudalism decisiveness hopefulness formaliti sensitiviti triplicate formative formalize electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate effective bowdlerize probate rate cease controll roll"
    want = "caress poni ti cat feed agre plaster motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc digit oper feudal decis hope formal sensit triplic form formal electr hope good reviv allow infer airlin adjust defens irrit replac adjust depend adopt commun activ effect bowdler probat rate ceas control roll"
    assert [stem(w) for w in words.split()] == want.split()


def greedy(tasks, k, quota):
    """Plain loops: k a stratum with new repos first; and a quota whose first half takes new repos only."""
    order = sorted(tasks, key=lambda t: (-t[3], t[0]))
    top, quotas = {}, {}
    for s in {t[1] for t in tasks}:
        mine = [t for t in order if t[1] == s]
        seen, first = set(), []
        for t in mine:
            if t[2] not in seen:
                seen.add(t[2])
                first.append(t[0])
        top[s] = (first + [t[0] for t in mine if t[0] not in first])[:k]
        seen, got = set(), []
        for t in mine:
            if len(got) < quota and (t[2] not in seen or len(got) >= quota // 2):
                seen.add(t[2])
                got.append(t[0])
        quotas[s] = got
    return top, quotas


def test_selection_equals_greedy_loops(spark):
    rng = random.Random(5)
    for n in (1, 17, 60):
        tasks = [(i, rng.randint(1, 3), rng.randint(0, 4), rng.randint(0, 9)) for i in range(n)]
        df = spark.createDataFrame(tasks, "id long, s int, repo int, score int")
        top, quotas = greedy(tasks, 5, 6)
        by = lambda rows: {s: [r.id for r in sorted(rows, key=lambda r: r.k) if r.s == s] for s in {r.s for r in rows}}
        assert by(selection.diverse_top(df, "s", "repo", "score", "id", 5).collect()) == top
        assert by(selection.quota_pick(df, "s", "repo", "score", "id", F.lit(6)).collect()) == quotas


def test_nearest_takes_no_row_twice(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate((2, 2, 7, 8, 9, 12))], "id long, n int")
    got = selection.nearest(df, "n", "id", [8, 10, 2], 2).collect()
    assert sorted((r.target, r.id) for r in got) == [(2, 0), (2, 1), (8, 3), (8, 4), (10, 2), (10, 5)]


def test_published_numbers(spark):
    # Deltas and speedups of the published comparison follow from its two rows.
    rows = [("dllm_llm", 0.1196, 30.1821), ("llm_llm", 0.1278, 19.9859)]
    a, b = rows
    assert round((a[1] - b[1]) / b[1] * 100, 2) == -6.42 and round(b[2] / a[2], 3) == 0.662


def test_wilcoxon(spark):
    d = [1.0, -2.0, 3.0, 0.0, 2.0, None]
    df = spark.createDataFrame([(x,) for x in d], "d double")
    r = stats.ranks_of_differences(df, F.col("d")).first()
    assert (r.n, r.w_plus, r.w_minus, r.ties) == (4, 7.5, 2.5, 6)
    assert 0 < stats.wilcoxon_p(*r) < 1 and stats.wilcoxon_p(0, 0, 0, 0) == 1


def test_configs():
    base = {"a": {"x": [1, 2], "y": 3}, "modes": ["m"], "t": [0.1, 0.2]}
    assert config.merge(base, {"a": {"y": 4}})["a"] == {"x": [1, 2], "y": 4}
    assert [(c["a"]["x"], c["t"]) for c in config.expand(base)] == [(1, 0.1), (1, 0.2), (2, 0.1), (2, 0.2)]
    assert [config.diff_cap(s) for s in (None, "500", "tok:64", "adaptive", "adaptive:90")] == [("none", None), ("chars", 500), ("tokens", 64), ("adaptive", 75.0), ("adaptive", 90.0)]


def test_keep_and_union(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, o int, v int")
    assert sorted(r.v for r in runs.keep_first(df, ["k"], "o").collect()) == [5, 7]
    assert sorted(r.v for r in runs.keep_last(df, ["k"], "o").collect()) == [6, 7]
    assert [r[0] for r in runs.batches(df, "k", "v", "o", 2).orderBy("k").select("padding").collect()] == [1, 0]


def test_no_names_of_regex_only(spark):
    assert re.fullmatch("bs8_sbs4_th0.8_cacheTrue_batch4_mnt128", spark.range(1).select(text.config_name(F.lit(8), F.lit(4), F.lit(0.8), F.lit(True), F.lit(4), F.lit(128))).first()[0])
