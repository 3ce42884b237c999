"""Plain versions of the operators on pairs, for small tables."""

from __future__ import annotations

import re


def shingle_sets(rows, width):
    """Distinct shingles of each (id, text)."""
    out = []
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        size = min(width, len(words))
        out.append((doc_id, frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()))
    return out


def groups(ids, linked):
    """Smallest id reachable from each id over the pairs (i, j) of positions that are ``linked``."""
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            x, y = find(a), find(ids[j])
            if x != y and linked(i, j):
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def near_duplicates(rows, width, percent):
    """Component of each id; rows without id or words are linked with nothing."""
    sets = [(d, s) for d, s in shingle_sets(rows, width) if d is not None]

    def linked(i, j):
        (a, x), (b, y) = sets[i], sets[j]
        if a == b:
            return True
        both = len(x & y)
        return bool(x and y) and 100 * both >= percent * (len(x) + len(y) - both)

    return groups([d for d, _ in sets], linked)
