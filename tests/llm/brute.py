"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import defaultdict


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_groups(rows, k, percent):
    """{doc_id: (size, component)} of (doc_id, text) rows."""
    sets = {i: shingles(t, k) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    links, seen = [], set()
    for i, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    root = roots(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: target} of {source: size}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def near_vectors(rows, threshold):
    """{vec_id: (n_links, component)} of (vec_id, embedding, label) rows."""
    units = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        norm = math.sqrt(sum(float(x) ** 2 for x in v))
        if norm > 0:
            units[i] = (label, [x / norm for x in v])
    links, count = [], defaultdict(int)
    ids = sorted(units)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            (a, u), (b, v) = units[i], units[j]
            if a == b and len(u) == len(v) and sum(x * y for x, y in zip(u, v)) >= threshold:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    root = roots([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], root[r[0]]) for r in rows}


def license_places(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for label, phrase in phrases:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)
