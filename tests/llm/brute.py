"""Plain-Python versions of what the operators compute, for small inputs."""

import re


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def near_components(docs, k, percent):
    """doc_id -> (set size, smallest reachable id)."""
    sets = {i: shingles(t, k) for i, t in docs}
    label = {i: i for i in sets}
    ids = sorted(sets)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    for i in ids:
        common = {}
        for s in sets[i]:
            for j in by[s]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}
