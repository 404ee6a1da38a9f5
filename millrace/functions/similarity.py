"""Text similarity: scores from counts as expressions, and the kernels that count, a pair at a time, in time in proportion to its words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .stemming import stem

#: Rows of a batch that are Python objects at a time.
AT_ONCE = 64


def _by_row(kind: T.DataType, one: Callable) -> Callable[..., Column]:
    """What `one` makes of each row's values, of one column or several. A batch stays in Arrow but for AT_ONCE rows of it, so that a task's memory doesn't follow the batch's words."""
    out = to_arrow_type(kind)

    def over(columns: tuple) -> pa.Array:
        parts = []
        for at in range(0, len(columns[0]), AT_ONCE):
            rows = zip(*(c.slice(at, AT_ONCE).to_numpy(zero_copy_only=False) for c in columns), strict=True)
            parts.append(pa.array([one(*row) for row in rows], out))
        return pa.concat_arrays(parts) if parts else pa.array([], out)

    @F.arrow_udf(kind)
    def of_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return (over((batch,)) for batch in batches)

    @F.arrow_udf(kind)
    def of_several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return map(over, batches)

    return lambda *columns: of_several(*columns) if len(columns) > 1 else of_one(*columns)


def _grams(words: list[str], n: int) -> Counter:
    """n-grams with their numbers; single words stand for themselves."""
    return Counter(words if n == 1 else zip(*(words[i:] for i in range(n)), strict=False))


def overlap_counts(a: list[str], b: list[str], orders: int) -> list[int]:
    """Of each order, the n-grams that two lists of words share, each as often as the rarer side has it."""
    out = []
    for n in range(1, orders + 1):
        x, y = _grams(a, n), _grams(b, n)
        if len(y) < len(x):
            x, y = y, x
        out.append(sum(min(c, y[g]) for g, c in x.items() if g in y))
    return out


def overlaps(a: Column, b: Column, orders: int) -> Column:
    """overlap_counts of two arrays of words, an array of `orders` numbers; null words and null arrays count as none."""

    return _by_row(T.ArrayType(T.LongType()), lambda x, y: overlap_counts(_words(x), _words(y), orders))(a, b)


def _words(xs) -> list[str]:
    return [] if xs is None else [x for x in xs if x is not None]


def bleu(matches: list[Column], totals: list[Column], hyp: Column, ref: Column) -> Column:
    """BLEU of up to four orders from counts: 0 without a common word, 0.1 for an order without matches, brevity penalty."""
    p = [F.when(m == 0, F.lit(0.1)).otherwise(m.cast("double")) / F.greatest(t, F.lit(1)) for m, t in zip(matches, totals, strict=True)]
    mean = F.exp(sum((F.log(x) for x in p[1:]), F.log(p[0])) / len(p))
    brevity = F.when(hyp > ref, 1.0).otherwise(F.exp(1 - ref.cast("double") / F.greatest(hyp, F.lit(1))))
    return F.when((matches[0] == 0) | (hyp == 0) | (ref == 0), 0.0).otherwise(brevity * mean)


def f_score(overlap: Column, hyp: Column, ref: Column) -> Column:
    """F1 of an overlap with two sizes."""
    p, r = overlap / F.greatest(hyp, F.lit(1)), overlap / F.greatest(ref, F.lit(1))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _tolerant(hyp: list[str], ref: list[str], names: list[str]) -> list[str]:
    known = set(names).difference(ref)
    return ref + [w for w in hyp if w in known]


def stemmed_overlaps(hyp: Column, ref: Column, orders: int, names: Column | None = None) -> Column:
    """struct<m array<long>, h long, r long>: the overlaps of the stems of two lists of words, and their lengths; with `names`, the reference also has those words of the hypothesis that name something."""

    def count(*lists):
        h, r, *n = ([stem(w) for w in _words(ws)] for ws in lists)
        r = _tolerant(h, r, *n) if n else r
        return {"m": overlap_counts(h, r, orders), "h": len(h), "r": len(r)}

    columns = [hyp, ref] if names is None else [hyp, ref, names]
    return _by_row(T.StructType().add("m", T.ArrayType(T.LongType())).add("h", T.LongType()).add("r", T.LongType()), count)(*columns)


def speed_quality(quality: Column, speed: Column) -> Column:
    """Quality times the logarithm of speed; 0 without speed."""
    return F.when(speed > 0, quality * F.log2(1 + speed)).otherwise(0.0)


def stems(words: Column, longer_than: int = 0) -> Column:
    """Words by their stems, those of up to `longer_than` letters as they are."""

    return _by_row(T.ArrayType(T.StringType()), lambda ws: [stem(w) if len(w) > longer_than else w for w in _words(ws)])(words)


def common_length(a: list, b: list) -> int:
    """Longest common subsequence, by a row of bits: a step a word of a, whatever the words of b that fit a machine word."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & every
    return len(b) - row.bit_count()


def common_subsequence(a: Column | str, b: Column | str) -> Column:
    return _by_row(T.LongType(), lambda x, y: common_length(_words(x), _words(y)))(a, b)


def _met(left_h: list[int], left_r: list[int], forms_h, forms_r) -> list[tuple[int, int]]:
    """Pairs of places whose words share a form, from the last on: each word of the one side meets the last of the other that is left. forms: a place's forms."""
    places: dict = {}
    for j in left_r:
        for f in forms_r(j):
            places.setdefault(f, []).append(j)
    pairs, gone = [], set()
    for i in reversed(left_h):
        best = -1
        for f in forms_h(i):
            js = places.get(f, [])
            while js and js[-1] in gone:
                js.pop()
            if js:
                best = max(best, js[-1])
        if best >= 0:
            gone.add(best)
            pairs.append((i, best))
    return pairs


def meteor_score(hyp: list[str], ref: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, synsets: dict[str, list] | None = None) -> float:
    """Exact matches, then stems, then words that share a synset, each word once; the last word of one form meets the last of that form left on the other side; fragmentation penalty."""
    if not hyp or not ref:
        return 0.0
    stages = [lambda w: (w,), lambda w: (stem(w),)] + ([lambda w: synsets.get(w, ())] if synsets else [])
    left_h, left_r, pairs = list(range(len(hyp))), list(range(len(ref))), []
    for forms in stages:
        found = _met(left_h, left_r, lambda i, forms=forms: forms(hyp[i]), lambda j, forms=forms: forms(ref[j]))
        pairs += found
        at, to = {i for i, _ in found}, {j for _, j in found}
        left_h, left_r = [i for i in left_h if i not in at], [j for j in left_r if j not in to]
    if not pairs:
        return 0.0
    pairs.sort()
    m, chunks = len(pairs), 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:], strict=False))
    p, r = m / len(hyp), m / len(ref)
    return (1 - gamma * (chunks / m) ** beta) * p * r / (alpha * p + (1 - alpha) * r)


def meteor(a: Column | str, b: Column | str) -> Column:
    return _by_row(T.DoubleType(), lambda x, y: meteor_score(_words(x), _words(y)))(a, b)


def meteor_by(synsets: Broadcast) -> Callable[[Column, Column], Column]:
    """METEOR of two lists of words with a third stage; synsets: a broadcast mapping of words to their synsets."""
    return _by_row(T.DoubleType(), lambda x, y: meteor_score(_words(x), _words(y), synsets=synsets.value))


def meteor_with(synsets: Column) -> Callable[[Column, Column], Column]:
    """METEOR of two lists of words with a third stage; synsets: array<struct<word, sets array<string>>> of words of that pair at least."""
    score = _by_row(T.DoubleType(), lambda x, y, told: meteor_score(_words(x), _words(y), synsets={t["word"]: list(t["sets"]) for t in (told if told is not None else ())}))
    return lambda h, r: score(h, r, synsets)
