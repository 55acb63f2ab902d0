"""Plain forms of the operators, for small tables."""

import math
import re
from collections import Counter


def spaced(text):
    return re.findall(r"[^\x00-\x20]+", text or "")


def spans(rows, words):
    """(doc_id, first_word, end_word) of maximal repeated spans; rows: (doc_id, text)."""
    rows = [(i, spaced(t)) for i, t in rows if i is not None]
    count = Counter(tuple(w[k : k + words]) for _, w in rows for k in range(len(w) - words + 1))
    out = set()
    for i, w in rows:
        now = None
        for k in range(len(w) - words + 1):
            if count[tuple(w[k : k + words])] > 1:
                if now and k <= now[1]:
                    now[1] = k + words
                else:
                    if now:
                        out.add((i, *now))
                    now = [k, k + words]
        if now:
            out.add((i, *now))
    return sorted(out)


def lm(rows, alpha):
    """(doc_id, words, mean log2, mean context) by counting contexts of every length."""
    texts = [(i, ["<begin>", *spaced(t)]) for i, t in rows if i is not None]
    best = [[None] * (len(w) - 1) for _, w in texts]
    vocabulary = len({x for _, w in texts for x in w[1:]})
    for length in range(max(len(w) for _, w in texts)):
        context, both = Counter(), Counter()
        for _, w in texts:
            for k in range(max(1, length), len(w)):
                context[tuple(w[k - length : k])] += 1
                both[tuple(w[k - length : k + 1])] += 1
        for (_, w), b in zip(texts, best, strict=True):
            for k in range(max(1, length), len(w)):
                c = context[tuple(w[k - length : k])] - 1
                if c or not length:
                    b[k - 1] = (length, math.log2((both[tuple(w[k - length : k + 1])] - 1 + alpha / vocabulary) / (c + alpha)))
        if not any(c > 1 for c in context.values()):
            break
    return [(i, len(b), sum(x for _, x in b) / len(b) if b else None, sum(n for n, _ in b) / len(b) if b else None) for (i, _), b in zip(texts, best, strict=True)]


def edit(item, text):
    """Least edits between item and any stretch of text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def groups(nodes, edges):
    """Members of components of two or more, with the least of each."""
    lead = {n: n for n in nodes}

    def find(x):
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        lead[max(a, b)] = min(a, b)
    found = {n: find(n) for n in nodes}
    size = Counter(found.values())
    return {n: g for n, g in found.items() if size[g] > 1}
