"""Each operator against plain Python or its SQL, with nulls, empty tables, repeated rows, ties, very long texts and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, common, decontaminate, exact_dedup, html_text, mixing, near_dedup, quality, registry, secrets, token_counts, toxicity
from millrace.llm.graph import components
from millrace.llm.template import TemplateError, compile_template
from tests.llm.brute import near_components
from tests.oracle import DATA, check

tokens_path = pytest.importorskip("public_tokenizers").path
DOC = "doc_id long, text string, source string, id string, g int, size int, digest string, taken int, label string"


def docs(spark, *rows):
    """Rows (doc_id, text[, source]) with columns whose names operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1, 2, "d", 3, "l") for r in rows], DOC)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_exact_dedup_cases(spark):
    rows = [(1, "Aé"), (2, "aé"), (3, "aÉ"), (4, None), (5, ""), (5, ""), (None, "q"), (6, "x" * 300_000), (None, "z"), (7, "Z")]
    got = exact_dedup.exact_dedup(docs(spark, *rows)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (0, 0, 1, True), (6, 6, 1, True), (0, 7, 2, False), (7, 7, 2, True)])
    assert {r.text_sha256 for r in got if r.doc_id == 4} == {hashlib.sha256(b"").hexdigest()}
    assert exact_dedup.exact_dedup(docs(spark)).count() == 0


def test_exact_dedup_with_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 40}") for i in range(400)]
    got = by_id(exact_dedup.exact_dedup(docs(spark, *rows)))
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert (got[i].keep_id, got[i].group_size) == (max(same), len(same))


def test_misra_gries_keeps_heavy_keys(spark):
    df = spark.createDataFrame([(b"h" if i % 4 == 0 else str(i).encode(),) for i in range(2000)], "k binary").repartition(5)
    found = {bytes(r.k): r.seen for r in exact_dedup.misra_gries(df, "k", 8).collect()}
    assert 500 - 2000 / 9 <= found[b"h"] <= 500


def test_mixing_cases(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3]) for i in range(200)] + [(None, "a b c d", None), (None, "a b", None), (900, None, "a"), (901, "one", "z"), (901, "one", "z"), (902, " \t ", "empty")]
    got = mixing.mix_sources(docs(spark, *rows)).collect()
    assert len(got) == len(rows)
    total, sources = sum(r.size for r in got), {}
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for r in got:
        sources.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in sources) - total) < 1e-6
    for (_, target), taken in sources.items():
        assert abs(sum(taken) - target) <= 3, (target, sum(taken))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs(spark, *reversed(rows)).repartition(3)).collect()), key=repr)
    assert mixing.mix_sources(docs(spark)).count() == 0
    kept = mixing.mix_documents(docs(spark, *rows))
    assert sum(r.taken for r in kept.collect()) == sum(r.taken for r in got) and kept.columns == docs(spark).columns


def test_mixing_one_source_and_no_words(spark):
    assert [tuple(r)[1:] for r in mixing.mix_sources(docs(spark, (1, "a b", "s"))).collect()] == [(2, 2, 2.0, 2)]
    assert [tuple(r)[1:] for r in mixing.mix_sources(docs(spark, (1, "", "s"), (2, None, None))).collect()] == [(0, 0, 0.0, 0)] * 2


def naive_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(window, len(b))
        for s in range(len(b) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == b[s : s + k]:
                    hit.update(range(i, i + k))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "a", "of", "É", "é1", "X", "y", "zz"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 3, 12, 15])))) for i in range(12)] + [(12, None), (13, "the the the")]
    rows = [(i, ", ".join(word() for _ in range(rng.randint(0, 60))) + (items[i % 12][1] or "") * (i % 2)) for i in range(40)] + [(50, None), (51, "..."), (52, "the " * 3000), (53, "a b"), (53, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs(spark, *rows), bench).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *naive_hits(t, items)) for i, t in rows)
    none = decontaminate.decontaminate(docs(spark, (1, "a b")), bench.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in none] == [(2, 0, False)]
    assert decontaminate.decontaminate(docs(spark), bench).count() == 0
    held = common.BROADCAST_BYTES
    try:
        common.BROADCAST_BYTES = 100  # prefixes that no broadcast holds
        again = decontaminate.decontaminate(docs(spark, *rows), bench).collect()
    finally:
        common.BROADCAST_BYTES = held
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    rows, base = [], [f"w{i}" for i in range(120)]
    for i in range(150):
        w = list(base) if i % 3 else [f"v{i}_{j % 50}" for j in range(60)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200, "A b"), (201, "a B"), (202, "a b c"), (203, ""), (204, None), (205, " \n"), (206, rows[0][1].upper()), (207, "x " * 50_000), (207, "x " * 50_000)]
    held = near_dedup.CHUNK_ROWS, near_dedup.LEADERS
    try:
        near_dedup.CHUNK_ROWS, near_dedup.LEADERS = 8, 2  # groups larger than a chunk
        got = near_dedup.near_dedup(docs(spark, *rows), words=3, percent=85).collect()
    finally:
        near_dedup.CHUNK_ROWS, near_dedup.LEADERS = held
    want = near_components(rows, 3, 85)
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_a_bucket_without_a_main_component(spark):
    """Texts that share their rarest shingles and little else fill buckets that no component dominates."""
    rng, rows = random.Random(8), []
    for i in range(90):
        own = " ".join(f"o{i // 2}_{j}" for j in range(30))
        rows.append((i, " ".join(f"common{j}" for j in range(40)) + " " + own + (f" z{i}" if i % 4 == 1 else "")))
        rows.append((1000 + i, " ".join(rng.choice("abcdefgh") for _ in range(6))))
    held = near_dedup.CHUNK_ROWS, near_dedup.LEADERS
    try:
        near_dedup.CHUNK_ROWS, near_dedup.LEADERS = 6, 1
        got = near_dedup.near_dedup(docs(spark, *rows), words=2, percent=85).collect()
    finally:
        near_dedup.CHUNK_ROWS, near_dedup.LEADERS = held
    want = near_components(rows, 2, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 40


def test_near_dedup_null_ids_and_empty_table(spark):
    got = near_dedup.near_dedup(docs(spark, (None, "a b c"), (None, "q"), (5, "a b c"), (3, "a b c"))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 3, False), (3, 3, True), (5, 3, False)]
    assert near_dedup.near_dedup(docs(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, j) for j in range(501, 560)]
    label = {n: n for e in edges for n in e}
    for _ in range(400):
        moved = [(a, b) for a, b in edges if label[a] != label[b]]
        if not moved:
            break
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: label[n] for a, b in edges if a != b for n in (a, b)}


def test_tokens_equal_the_library_at_every_prefix(spark):
    from tokenizers import Tokenizer

    path = tokens_path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "'", "'re", "1", "é", "<|endoftext|>", "<|endof", "!", "\t", " don't", "日本", "😀", " ", "ՙ", "Hello", "\r\n", "_", "힣", "ᐁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, "word " * 30_000), (502, "x" * 5_000), (503, "a"), (503, "a")]
    got = token_counts.token_counts(docs(spark, *rows), path, prefixes=True).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 1024)
        if len(t) < 200:
            assert r.prefix_tokens == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    count = token_counts.counter(path)
    fit = count.fitting("one two three four", 2)
    assert count.total("one two three four"[:fit]) <= 2 < count.total("one two three four"[: fit + 1])
    assert token_counts.token_counts(docs(spark), path).count() == 0


def test_secrets(spark):
    path = tokens_path("byte_bpe_50k.tiktoken")
    key = "xK9q" + "Zt7Wv3" * 4
    text = f'é Password = "hunter2hunter2" token: short apikey:abcdefgh1 AKIA{"A" * 12} AKIAshort {"0a" * 16} {key} deadbeefdeadbeefdeadbeefdeadbeef00 this_is_an_identifier_name_2024'
    rows = [(1, text), (2, None), (3, ""), (4, "secret: token: abcdefgh1"), (5, "a" * 200_000), (5, "a" * 200_000)]
    got = by_id(secrets.find_secrets(docs(spark, *rows), path))
    r = got[1]
    assert (r.n_assign, r.n_access, r.n_hex, r.n_random) == (2, 1, 2, 1)
    spans = [s.split(":") for s in r.spans.split(",")]
    assert [text[int(a) : int(b)] for k, a, b in spans if k == "random"] == [key]
    base = ",".join(":".join(s) for s in spans if s[0] != "random")
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[2].spans == got[3].spans == got[4].spans == "" and got[5].n_hex == 1
    assert secrets.find_secrets(docs(spark), path).count() == 0


def test_chat_round_trip(spark):
    said = [None, "", "\\0;", "</s>[INST] ok [/INST]", "<|im_end|>\\", "<<SYS>>\\\\<|im_start|>x", "a\nb", "<|im_sep|>"]
    rows = [(c, t, role, x, 1) for c in (1, 2) for t, (role, x) in enumerate(zip(["system", "user", "assistant", "assistant", "user", "assistant", None, "tool"], said, strict=True))]
    rows += [(3, 0, "assistant", "x", 1), (3, 0, "assistant", "x", 1), (None, 5, "user", "n", 1), (4, None, "user", "q" * 100_000, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int")
    chats = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert chat.read_back(chats[1].formatted) == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    learnt = [chat.unescape(chats[1].formatted[s.start : s.end]) for s in chats[1].loss]
    assert learnt == [r[3] for r in rows if r[0] == 1 and r[2] == "assistant"]
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(turns)).collect()}
    assert got[3].n_turns == 2 and got[3].loss_chars == 2 and got[None].n_turns == 1 and got[4].loss_chars == 0
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_templates():
    t = "{% set x = 'a' + 'b' %}{% for m in ms %}{% if loop.first and true %}<{{ m.k | upper }}>{% elif m['k'] == 'z' %}Z{% else %}{{ m.k ~ x }}{% endif %}{% generation %}!{% endgeneration %}{% endfor %}{% if false %}no{% endif %}{{ none }}"
    text, spans = compile_template(t)(ms=[{"k": "q"}, {"k": "z"}, {"k": "w"}])
    assert text == "<Q>!Z!wab!" and [text[a:b] for a, b in spans] == ["!", "!", "!"]
    for bad in ("{% if x %}", "{{ x.__class__.y() }}", "{{ 1 + 'a' }}", "{{ x | exec }}", "{% import os %}", "{{ }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError):
        compile_template("{{ x.real }}")(x=5)


def labelled(spark, n=240):
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in ("tion", "ing", "er", "the", "an") for b in ("re", "ou", "at", "is", "on", "ly")]
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 4 == 1
        w = [rng.choice(vocab) for _ in range(60)]
        if toxic:
            for x in ("grobnix", "flumox", "snarkle"):
                w[rng.randrange(60)] = x
        text = " ".join(w).capitalize() + "."
        rows.append((i, " ".join(w).upper().replace(" ", "!! ") if bad else text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return docs(spark, *rows, (900, None), (901, ""), (902, " ".join(vocab * 2000)), (903, "ok"), (903, "ok"), (None, "tionre ingou.")), spark.createDataFrame([*labels, (900, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    d, labels = labelled(spark)
    got = by_id(quality.resample(d, labels))
    assert len(got) == 240 + 5 and got[900].kept is False and got[900].score is None
    wrong = sum(got[i].kept != (i % 5 != 0) for i in range(240))
    assert wrong <= 2
    again = by_id(quality.resample(d.repartition(7), labels))
    assert {i: r.kept for i, r in got.items()} == {i: r.kept for i, r in again.items()}
    assert all(r.kept == (r.n_words > 0) for r in quality.resample(d, labels.limit(0)).collect())
    assert quality.resample(docs(spark), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(4)
    xs = [rng.gauss(0, 10) for _ in range(3000)] + [5.0] * 50
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 10, 1500, len(xs)):
        cut = quality.kth_largest(df, "x", k)
        assert k <= sum(x >= cut for x in xs) <= max(k + 1, sum(x >= sorted(xs)[-k] for x in xs))


def test_toxicity(spark):
    d, labels = labelled(spark)
    got = toxicity.score_toxicity(d, labels).collect()
    assert len(got) == 240 + 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and sum(r.predicted != int(r.doc_id % 4 == 1) for r in held) <= 0.1 * len(held)
    flat = toxicity.score_toxicity(d, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in flat} == {0.5}
    assert toxicity.score_toxicity(docs(spark), labels).count() == 0


def test_html_operator(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b", "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", "<p>a<p>b", "t")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_text(pages).collect())
    assert got == [(0, "", 0), (1, "a\n\nb", 4), (1, "a\n\nb", 4), (2, "", 0)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs_in = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_in, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < out.count() <= docs_in.count()
        if k < 4:
            assert out.columns == docs_in.columns
        if k == 2:
            near = near_components([(r.doc_id, r.text) for r in docs_in.select("doc_id", "text").collect()], 5, 80)
            assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, (_, c) in near.items() if i == c}
        docs_in = out
    assert out.where(F.col("taken") <= 0).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    from millrace.llm import graph

    monkeypatch.setattr(graph, "HUB_EDGES", 5)
    edges = [(500, j) for j in range(501, 530)] + [(0, j) for j in range(1, 20)] + [(19, 500), (100, 101), (101, 102)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{n: 0 for n in [*range(20), *range(500, 530)]}, 100: 100, 101: 100, 102: 100}
