"""The kernels against plain, slow versions, and in time on long texts."""

import random
import time
from collections import Counter

from millrace.functions import similarity as sim
from millrace.functions.stemming import stem
from millrace.plans import QUERIES
from tests.oracle import DATA


def slow_overlap(a, b, n):
    grams = lambda x: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
    return sum(min(grams(a).count(g), grams(b).count(g)) for g in set(grams(a)))


def slow_common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def slow_meteor(hyp, ref):
    left_h, left_r, pairs = list(enumerate(hyp)), list(enumerate(ref)), []
    for form in (lambda w: w, stem):
        for i in range(len(left_h) - 1, -1, -1):
            for j in range(len(left_r) - 1, -1, -1):
                if form(left_h[i][1]) == form(left_r[j][1]):
                    pairs.append((left_h.pop(i)[0], left_r.pop(j)[0]))
                    break
    if not pairs:
        return 0.0
    pairs.sort()
    m, chunks = len(pairs), 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:], strict=False))
    p, r = m / len(hyp), m / len(ref)
    return (1 - 0.5 * (chunks / m) ** 3) * p * r / (0.9 * p + 0.1 * r)


def test_kernels_equal_slow_versions():
    rng = random.Random(5)
    vocab = ["run", "running", "runs", "a", "b", "cat", "cats", "nation", "national"]
    for _ in range(300):
        a, b = ([rng.choice(vocab) for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert sim.overlap_counts(a, b, 4) == [slow_overlap(a, b, n) for n in (1, 2, 3, 4)]
        assert sim.common_length(a, b) == slow_common(a, b)
        assert abs(sim.meteor_score(a, b) - (slow_meteor(a, b) if a and b else 0)) < 1e-12


def test_long_pairs_take_seconds():
    rng = random.Random(2)
    a, b = ([f"w{rng.randrange(5000)}" for _ in range(20_000)] for _ in range(2))
    began = time.process_time()
    sim.overlap_counts(a, b, 4), sim.meteor_score(a, b), sim.common_length(a, b)
    assert time.process_time() - began < 10


def test_stemmed_scores_equal_plain_python(spark):
    import re

    pairs = {(r.conv_id, r.turn): (r.hyp, r.ref) for r in __import__("millrace.plans.metrics", fromlist=["_pairs"])._pairs(spark, DATA).collect()}
    norm = lambda t: [stem(w) if len(w) > 3 else w for w in re.sub(r"[^a-z0-9\s]", " ", t.lower()).split()]
    f = lambda o, h, r: 2 * (o / max(h, 1)) * (o / max(r, 1)) / (o / max(h, 1) + o / max(r, 1)) if o else 0.0
    got = QUERIES["rouge_stemmed"](spark, DATA).collect()
    assert len(got) == len(pairs)
    for row in got[:60]:
        h, r = map(norm, pairs[row.conv_id, row.turn])
        want = f(slow_overlap(h, r, 1), len(h), len(r)), f(slow_overlap(h, r, 2), len(h) - 1, len(r) - 1), f(slow_common(h, r), len(h), len(r))
        assert all(abs(x - y) < 1e-5 for x, y in zip((row.rouge1, row.rouge2, row.rouge_l), want, strict=True))
    for row in QUERIES["meteor_pairs"](spark, DATA).limit(60).collect():
        h, r = (t.lower().split() for t in pairs[row.conv_id, row.turn])
        assert abs(row.meteor - (slow_meteor(h, r) if h and r else 0)) < 1e-5
