"""Plain-Python versions that several tests share."""

from __future__ import annotations

import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    n = min(5, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def brute_components(rows):
    """(doc_id, size of the set, root) of (doc_id, text) rows that link at 80 hundredths."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    return [(d, len(sets[i]), root(i)) for i, (d, _) in enumerate(rows)]


def least_of(found):
    """The smallest id of each component; documents without words all stay."""
    least = {}
    for doc_id, size, root in found:
        if size and doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    return list(least.values()) + [d for d, size, _ in found if not size and d is not None]


def contaminated(text, items, width=13):
    """A twentieth of the words lie in windows of an item."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    ws, hit = words(text), set()
    for item in map(words, items):
        n = min(width, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if n and tuple(ws[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(ws)
