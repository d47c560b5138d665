"""Plain-Python versions of the operators for small fixtures."""

import re
from collections import Counter, defaultdict

import numpy as np


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text, n=5):
    w = tokens(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(n, linked):
    """Sets of rows connected by ``linked`` pairs."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    out = defaultdict(list)
    for i in range(n):
        out[find(i)].append(i)
    return list(out.values())


def near(rows, threshold=0.8):
    """rows: (id, text) -> Counter of (id, class_id, n_links); rows kept a group."""
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    degree = Counter(x for p in links for x in p)
    out = Counter()
    parts = groups(len(rows), links)
    for g in parts:
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        for i in g:
            out[(rows[i][0], least, degree[i])] += 1
    return out, len(parts)


def leaks(docs, items):
    """{(doc_id, item_id): most agreeing tokens in a window}."""
    out = {}
    for d, text in docs:
        t = tokens(text)
        for k, item in items:
            w = tokens(item)
            if len(w) < 9:
                continue
            width, need = min(13, len(w)), (len(w) if len(w) < 13 else 11)
            best = 0
            for diag in range(-len(w) + 1, len(t)):
                same = [0 <= diag + i < len(t) and t[diag + i] == x for i, x in enumerate(w)]
                best = max(best, max(sum(same[i:i + width]) for i in range(len(w) - width + 1)))
            if best >= need:
                out[(d, k)] = max(best, out.get((d, k), 0))
    return out


def without_boilerplate(rows, min_sites=5):
    """rows: (text, site) -> texts without the lines spread over many sites; near
    copies of nothing but such lines stay."""
    sites = defaultdict(set)
    for text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None and text is not None:
                sites[line].add(site)
    out, bare = [], []
    for text, _ in rows:
        kept = [x for x in (text or "").split("\n") if len(sites[x]) < min_sites]
        out.append(None if text is None else "\n".join(kept))
        bare.append(text is not None and out[-1] != text and not any(x.strip(" ") for x in kept))
    emptied = [(i, rows[i][0]) for i in range(len(rows)) if bare[i]]
    for (i, _, links), _n in near(emptied)[0].items():
        if links:
            out[i] = rows[i][0]
    return out


def cosine_links(rows, threshold=0.93):
    """rows: (id, vector, label) -> Counter of (id, n_links, component)."""
    def usable(v, label):
        return (label is not None and v and all(x is not None and np.isfinite(x) for x in v)
                and any(x != 0 for x in v))
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v, k) else None
            for _, v, k in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2]
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    degree = Counter(x for p in links for x in p)
    out = Counter()
    for g in groups(len(rows), links):
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        for i in g:
            out[(rows[i][0], degree[i], least)] += 1
    return out
