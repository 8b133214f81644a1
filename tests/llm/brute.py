"""Plain versions of operators that SQL doesn't express, over (id, text) lists."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def thue_morse(n: int) -> list[bool]:
    return [bin(i).count("1") % 2 == 1 for i in range(n)]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, k: int = 5) -> set:
    w = words(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def near_duplicates(rows: list[tuple[int, str | None]], link: int = 85) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept), every pair that shares a shingle compared."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= link * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())


def repeats(rows: list[tuple[int, str | None]], window: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    first: dict = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)
