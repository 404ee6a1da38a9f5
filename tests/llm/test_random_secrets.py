"""Planted random strings, what is none, and the base patterns against a naive scan."""

import random
import string

import pytest

from millrace.llm import secrets
from tests.oracle import DATA

tokens_path = pytest.importorskip("public_tokenizers").path
BASE62 = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def scan():
    return secrets.Scan(secrets._encoder(tokens_path("byte_bpe_50k.tiktoken")))


@pytest.mark.parametrize("alphabet,lengths", [(BASE62, (8, 10, 12, 16, 19, 20, 40, 64)), (BASE62 + "!@#$%^&*.", (8, 12, 16, 20, 40, 64)), (string.ascii_letters, (8, 16, 32, 64)), (string.ascii_lowercase, (20, 32, 64)), (string.ascii_uppercase, (20, 32, 64))])
def test_random_strings_are_found(scan, alphabet, lengths):
    rng = random.Random(8)
    for n in lengths:
        whole = 0
        for _ in range(200):
            key = "".join(rng.choice(alphabet) for _ in range(n))
            whole += any(end - start >= n - 3 for start, end, _ in scan.spans(f"so {key} it", []))
        assert whole >= 0.9 * 200, (n, whole)


def test_words_numbers_and_addresses_are_no_secrets(scan):
    text = "jane.doe42@example.com https://www.example.org/a/page.html 192.168.100.200 version-1.22.333 (this).that!! Donaudampfschiff!! WARNING### 2024-01-02.03"
    assert scan.spans(text, []) == []


def test_documents_give_no_false_alarm(spark, scan):
    for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL").collect():
        assert scan.spans(r.text, secrets.base_spans(r.text)) == [], r.doc_id


def naive_base(text):
    """The base patterns, character by character."""
    found, keys = [], ("password", "passwd", "secret", "token", "api_key", "apikey")
    value = set(BASE62 + "+/_.=-")
    i = 0
    while i < len(text):
        end = None
        for key in keys:
            j = i + len(key)
            low = "".join(c.lower() if c.isascii() else c for c in text[i:j])
            if low != key:
                continue
            for quote in (1, 0):
                k = j + quote if quote and text[j : j + 1] in ('"', "'") and text[j : j + 1] else j if not quote else None
                if k is None:
                    continue
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                    continue
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in ('"', "'") and text[k : k + 1]:
                    k += 1
                stop = k
                while stop < len(text) and text[stop] in value:
                    stop += 1
                if stop > k:
                    end = (stop, stop - k)
                    break
            if end:
                break
        if end:
            if end[1] >= 8:
                found.append((i, end[0], "assign"))
            i = end[0]
        else:
            i += 1
    for kind, chars, least, start in (("access", set(string.ascii_uppercase + string.digits), 16, "AKIA"), ("hex", set("0123456789abcdef"), 32, "")):
        i = 0
        while i < len(text):
            j = i + len(start)
            if text[i:j] != start or not start and text[i] not in chars:
                i += 1
                continue
            while j < len(text) and text[j] in chars:
                j += 1
            if start and j == i + len(start):
                i += 1
                continue
            if j - i >= least:
                found.append((i, j, kind))
            i = j
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_base_spans_equal_a_naive_scan():
    rng = random.Random(12)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "abcdefgh1", "x/y+z=.-_", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0a" * 8, "0a" * 16, "é", "\n", "\t", "ſecret"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert secrets.base_spans(text) == naive_base(text), text
