"""Brute-force versions of the training-data operators, over lists of rows."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def stripped(docs, k=20):
    """doc_id, words, removed and kept words of each (doc_id, text); a null id comes last."""
    rows = [(10**30 if i is None else i, words(t)) for i, t in docs]
    first = {}
    for i, w in rows:
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, (i, p)), (i, p))
    out = []
    for i, w in rows:
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (i, p):
                gone.update(range(p, p + k))
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def shingles(text, k=5):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(docs):
    """doc_id -> (set size, component id)."""
    sets = [(i, shingles(t)) for i, t in docs]
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[root(a)].append(i)
    return [(i, len(s), min(least[root(a)])) for a, (i, s) in enumerate(sets)]


def merged(symbols, pairs):
    """BPE of symbols: the merge of least rank first, the leftmost among equals. pairs: (left << 32 | right) to (rank, new)."""
    ids = list(symbols)
    while True:
        found = [(pairs[x], i) for i in range(len(ids) - 1) if (x := ids[i] << 32 | ids[i + 1]) in pairs]
        if not found:
            return ids
        (_, new), i = min(found)
        ids[i : i + 2] = [new]


def log_perplexities(rows, half, order, points=0x110000):
    """Log perplexity of each (text, lang) by a modified Kneser-Ney model of the language's texts of the other half."""
    counts = defaultdict(Counter)
    pad = " " * (order - 1)
    cut = lambda t: [(pad + t)[i : i + order] for i in range(len(t))]
    for t, lang in rows:
        if t:
            counts[lang, half(t)].update(cut(t))
    models = {}
    for key, c in counts.items():
        levels = {order: c}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        models[key] = {}
        for k, c in levels.items():
            n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
            d = [0.5, 0.75, 0.9]
            if all(n):
                y = n[0] / (n[0] + 2 * n[1])
                d = [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]
            total, free = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                free[g[:-1]] += d[min(v, 3) - 1]
            models[key][k] = c, d, total, free

    def p(model, g):
        if not g:
            return 1 / points
        c, d, total, free = model.get(len(g), ({}, (), {}, {}))
        below = p(model, g[1:])
        h = g[:-1]
        if h not in total:
            return below
        own = (c[g] - d[min(c[g], 3) - 1]) / total[h] if g in c else 0
        return own + free[h] / total[h] * below

    return [-math.fsum(math.log(p(models.get((lang, 1 - half(t)), {}), g)) for g in cut(t)) / len(t) if t else None for t, lang in rows]


def allot(sizes, weights, share=1.5, most=2.0):
    """Targets of sources: share of all words by weight, none above most times its size, the excess reshared."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out
