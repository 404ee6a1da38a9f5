"""Piece encoding against the library and against merging as defined."""

import hashlib
import random

import pytest

from millrace.llm import pieces
from tests.oracle import DATA

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b", "\n", "a\nb", "a\r\n\tb", "naïve é é", "中文日本語", "😀👍🏽", "\x00", "�​﻿", "<s></s><unk><0x0A>", "x" * 5000, " " * 5000, "ab c" * 4000, "ﬁ ½ ①"]


def test_encodes_and_decodes_as_the_library():
    own = pieces.codec(MODEL)
    rng = random.Random(4)
    known = list(own.id)
    texts = [t or "" for t in ODD]
    texts += ["".join(rng.choice("abest  ▁\n.,é中😀\x00<>0") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choices(known, k=rng.randint(1, 6))).replace("▁", " ") for _ in range(4000)]
    for text in texts:
        ids = own.library.encode(text)
        assert own.encode(text).tolist() == ids, text
        assert own.decode(ids) == own.library.decode(ids), text
    for _ in range(4000):
        ids = [rng.choice((rng.randrange(300), rng.randrange(len(own.raw)))) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == own.library.decode(ids), ids


def test_backtracks_where_longest_matches_fail():
    own = pieces.codec(MODEL)
    rng = random.Random(5)
    turned = 0
    for _ in range(3000):
        text = "▁" + "".join(rng.choice("aeinorstlh") for _ in range(rng.randint(1, 14)))
        assert own.tokens(text) == own.merged(text)
        at, greedy = 0, []
        while at < len(text):
            greedy.append(next(text[at:e] for e in range(len(text), at, -1) if text[at:e] in own.id))
            at += len(greedy[-1])
        turned += greedy != own.merged(text)
    assert turned > 300  # so that the search is not only its first way


def test_remembered_is_bounded():
    held = pieces.Remembered(lambda k: k * 2, 10, longest=3)
    for i in range(100):
        assert held[str(i)] == str(i) * 2 and held["long key"] == "long keylong key"
    assert len(held) <= 5 and len(held.old) <= 5 and "long key" not in held


def test_query_cases(spark):
    rows = [(i, t, "d", 1) for i, t in enumerate(ODD)] + [(None, "no id", "d", 1), (7, "again", "d", 1), (7, "again", "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, id int")
    lib = pieces.codec(MODEL).library
    want = []
    for i, t, *_ in rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in pieces.piece_digests(docs, MODEL).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert pieces.piece_digests(docs.limit(0), MODEL).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(docs, MODEL), MODEL).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(i), lib.decode(lib.encode(t or ""))) for i, t, *_ in rows)


def test_query_on_documents(spark):
    lib = pieces.codec(MODEL).library
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = pieces.op12_pieces(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
