"""Plain versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_overlap(rows, items, window):
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) by comparing every window."""
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for doc_id, text in rows:
        w, hit, names = words(text), set(), set()
        for item, item_text in items:
            v = words(item_text)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    names.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def brute_fingerprint(text, size=3):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def brute_components(ids, fps, radius=2):
    """The smallest non-null id that links of at most ``radius`` bits reach from each row."""
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    first = {}
    for i in range(n):
        if ids[i] is not None:
            first[find(i)] = min(first.get(find(i), ids[i]), ids[i])
    return [first.get(find(i)) for i in range(n)]


def _shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_jaccard(rows, over=4, under=5):
    """The smallest id of each group of (id, text) rows, by comparing all pairs; (ids, similar pairs of different sets)."""
    sets, root, pairs = [_shingles(t) for _, t in rows], list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both * under >= over * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
                pairs += sets[i] != sets[j]
    first = {}
    for i, (k, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), k), k)
    return sorted(first.values()), pairs
