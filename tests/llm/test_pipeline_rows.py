"""The pipeline decides on rows: null ids, repeated rows and an id with two texts, through all stages."""

import random

from tests.llm.test_operators import docs


def test_stages_decide_on_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("tion", "ing", "er", "the", "an") for b in ("re", "ou", "at", "is", "on", "ly")]
    good = lambda: " ".join(rng.choice(vocab) for _ in range(60)).capitalize() + "."
    bad = lambda: good().upper().replace(" ", "!! ")
    texts = [bad() if i % 5 == 0 else good() for i in range(240)]
    leak = " ".join(f"leaked{i}" for i in range(12))
    spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(240)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(pipeline.STAGES)

    def run(name, *rows):
        return sorted(((r.doc_id, r.text) for r in stages[name](spark, docs(spark, *rows), str(tmp_path)).collect()), key=repr)

    labelled, clean = list(enumerate(texts)), good()
    got = run("quality", *labelled, (None, bad()), (None, clean), (700, bad()), (700, clean))
    assert [t for i, t in got if i is None] == [clean] and [t for i, t in got if i == 700] == [clean]

    one, two, near = good(), good(), lambda t: t + " extra"
    assert run("exact_dedup", (1, one), (1, one), (None, two), (None, two), (2, "A b"), (2, "a B"), (3, "c"), (3, "d"), (4, "d"), (None, "c")) in (
        sorted([(1, one), (None, two), (2, x), (3, "c"), (4, "d")], key=repr) for x in ("A b", "a B"))
    got = run("near_dedup", (1, one), (1, one), (None, near(one)), (None, two), (None, near(two)), (5, clean), (5, texts[1]), (3, near(clean)), (9, near(texts[1])))
    assert [x for x in got if x[0]] == sorted([(1, one), (3, near(clean)), (5, texts[1])], key=repr)
    assert len([x for x in got if x[0] is None]) == 1
    got = run("decontaminate", (None, f"so {leak} it"), (None, clean), (6, leak), (6, clean), (8, one), (8, one))
    assert got == sorted([(None, clean), (6, clean), (8, one), (8, one)], key=repr)
    mixed = stages["mix"](spark, docs(spark, (None, clean), (None, two), (6, one), (6, texts[1])), str(tmp_path)).collect()
    assert sorted(r.text for r in mixed) == sorted([clean, two, one, texts[1]])

    rows = [*labelled, (None, bad()), (None, f"so {leak} it"), (1, texts[1]), (None, two), (None, near(two)), (700, leak), (700, clean)]
    docs(spark, *rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert not any(leak in r.text for r in out) and [r.text for r in out].count(texts[1]) <= 1
    assert sum(r.doc_id is None for r in out) <= 1 and [r.text for r in out if r.doc_id == 700] in ([clean], [])
