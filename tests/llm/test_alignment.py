"""Alignment of two tokenizers against links found token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import alignment
from tests.oracle import DATA

path = pytest.importorskip("public_tokenizers").path
A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", " a", "a ", "a  b", "x▁y", "fine x", "\n", "a\n b", " \n a\t b\r\n", "naïve é", "中文日本語 です", "😀👍🏽 ok", "\x00 b", "<|endoftext|> <s> </s> <0x0A>", "q" * 3000, " " * 900, "ab c" * 2000, "don't we'll", "\x1c a\x85b"]


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def brute(texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), by tokenizing each text whole."""
    own = alignment.aligner(A, B)
    each, counts = [], Counter()
    for t in texts:
        a = own.a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = own.b.encode(t) if t else []
        data = (" " + (t or "")).encode()
        if not t or b"".join(own.a_bytes[i] for i in a) != data or b"".join(own.b_bytes[i] for i in b) != data:
            each.append(None)
            continue
        sa, sb = spans(len(own.a_bytes[i]) for i in a), spans(len(own.b_bytes[i]) for i in b)
        links, j = [], 0
        for (x, y), i in zip(sa, a):
            while sb[j][1] <= x:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < y:
                links.append((i, b[k]))
                k += 1
        shared = sorted({y for _, y in sa} & {y for _, y in sb})
        groups, i, j = [], 0, 0
        for end in shared:
            x, y = i, j
            while i < len(sa) and sa[i][1] <= end:
                i += 1
            while j < len(sb) and sb[j][1] <= end:
                j += 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        each.append((len(a), len(b), len(shared), links, ";".join(groups)))
        counts.update(links)
    best = {}
    for (_, i), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if e is None else (*e[:3], len(e[3]), sum(counts[x] == best[x[1]] for x in e[3]), sum(counts[x] for x in e[3]), hashlib.sha256(e[4].encode()).hexdigest()) for e in each]


def compare(texts, got):
    for want, r in zip(brute(texts), got, strict=True):
        assert tuple(r)[1:] == want


def test_odd_texts(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abest   \n.,'é中😀▁<1") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["again and again"] * 20
    docs = spark.createDataFrame([(i, t, "x", 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, id string, key int, n int").repartition(5)
    compare(texts, sorted(alignment.align(docs, A, B).collect(), key=lambda r: r.doc_id))
    assert alignment.align(docs.limit(0), A, B).count() == 0
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in alignment.align(docs.where("text IS NULL"), A, B).collect())


def test_ids_stay_and_groups_are_told(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = alignment.align(docs, A, B, groups=True).collect()
    assert sorted(repr(r.doc_id) for r in got) == ["1", "1", "None"] and len({tuple(r)[1:] for r in got}) == 1
    assert hashlib.sha256(got[0].groups.encode()).hexdigest() == got[0].groups_sha256 and got[0].count_sum == 3 * got[0].n_links


def test_both_libraries_of_a_agree():
    own = alignment.aligner(A, B)
    rng = random.Random(12)
    letters = "abcdeST019 .,'!\n\t\r\xa0éßñÿĀſʼ̈αωЖяֆ՗<|>"
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        assert own.fast.encode_ordinary(text) == own.a.encode(text, add_special_tokens=False).ids, text
    for c in range(1, ord(alignment.UNSURE)):
        text = f"a{chr(c)}b {chr(c)}1"
        assert own.fast.encode_ordinary(text) == own.a.encode(text, add_special_tokens=False).ids, text


def test_few_waiting_and_small_shards(spark, monkeypatch):
    rng = random.Random(9)
    batches = [pa.RecordBatch.from_pydict({"key": [1, 1, 2], "n": [1, 2, 3]}), pa.RecordBatch.from_pydict({"key": [2, 2], "n": [4, 5]}), pa.RecordBatch.from_pydict({"key": [2, 7], "n": [1, 1]})]
    assert [x for k, v in alignment._runs_summed(batches) for x in zip(k.tolist(), v.tolist())] == [(1, 3), (2, 13), (7, 1)]
    keys, n = alignment._summed([np.array([3, 5]), np.array([5, 9])], [np.array([1, 2]), np.array([3, 4])])
    assert (keys.tolist(), n.tolist()) == ([3, 5, 9], [1, 5, 4])
    words = ["".join(rng.choice("abcdestnr") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    compare(texts, sorted(alignment.align(docs, A, B).collect(), key=lambda r: r.doc_id))


def test_query_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    order = sorted(texts)
    compare([texts[i] for i in order], sorted(alignment.op13_alignment(spark, DATA).collect(), key=lambda r: r.doc_id))
