"""Plain versions of what the pipeline's stages do."""

import re
from itertools import combinations

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def word_count(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def redacted(text):
    return PHONE.sub("<PHONE>", EMAIL.sub("<EMAIL>", text))


def classes(rows):
    """Sets of ids linked by five-word-shingle similarity of 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) * 10 >= 8 * len(a | b):
            root[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i in sets:
        out.setdefault(find(i), set()).add(i)
    return list(out.values())
