"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), for pandas UDFs over a vocabulary.

These are the rules of 1980, without later extensions (lists of irregular forms, "ies" of four letters, "bli", "logi"). Fixed values: the suffixes.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Suffixes with what replaces them, by step, where the measure of what is left must be above 0 (steps 2 and 3).
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(s: str) -> str:
    out = ""
    for i, c in enumerate(s):
        vowel = c in "aeiou" or c == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(s: str) -> int:
    return len(re.findall("v+c+", _shape(s)))


def _short(s: str) -> bool:
    return _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"


def _swap(w: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            left = w[: -len(end)]
            return left + table[end] if _measure(left) > 0 else w
    return w


@lru_cache(100_000)
def stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            left = w[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left.endswith(("s", "t"))):
                w = left
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
