"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def tokens(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]


def exact_groups(rows):
    """id -> (keep, size) of (id, text) rows."""
    by = defaultdict(list)
    for i, t in rows:
        by[SPACE.sub(" ", t or "")].append(i)
    return {(i, k): (min(v, key=lambda x: (x is not None, x)), len(v)) for k, v in by.items() for i in v}


def simhash(text, n=3):
    w = tokens(text)
    shingles = [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    if not shingles:
        return 0
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, linked):
    label = {n: n for n in nodes}
    while True:
        new = {a: min([label[a], *(label[b] for b in nodes if linked(a, b))]) for a in nodes}
        if new == label:
            return label
        label = new


def base_score(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*tokens(t), b""])
    n, v = sum(counts.values()), len(counts)
    return {i: (sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*tokens(t), b""]), sum(counts[w] > 0 for w in [*tokens(t), b""])) for i, t in rows}, n


def forward(start, move, emit, seq):
    """Likelihood by summing over all state sequences, one step at a time, in logs."""
    a = np.log(start) + np.log(emit[seq[0]])
    for k in seq[1:]:
        m = a.max()
        a = np.log(np.exp(a - m) @ move) + m + np.log(emit[k])
    m = a.max()
    return math.log(np.exp(a - m).sum()) + m


def symbols(text):
    """A sign's own symbol, or two that hold its code point's upper and lower bits."""
    return [y for x in map(ord, text) for y in ([x + 4] if x < 1980 else [1984 + x // 1024, 1984 + 1088 + x % 1024])]


def kneser_ney(train, order, texts, bits=12):
    """Negative log probability of each text's signs under interpolated modified Kneser-Ney."""
    def grams(t):
        s = [2] * (order - 1) + symbols(t) + [3]
        return [tuple(s[k : k + order]) for k in range(len(s) - order + 1)]

    counts = [None] * (order + 1)
    counts[order] = Counter(g for t in train for g in grams(t))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    rules = [None] * (order + 1)
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        n1, n2, n3, n4 = (of.get(k, 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        d = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1)]
        total, kept = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            kept[g[:-1]] += d[min(c, 3) - 1]
        rules[n] = d, total, kept

    def p(g):
        if not g:
            return 1 / (1 << bits)
        d, total, kept = rules[len(g)]
        below = p(g[1:])
        if not total[g[:-1]]:
            return below
        c = counts[len(g)][g]
        return (max(0, c - d[min(c, 3) - 1]) if c else 0) / total[g[:-1]] + kept[g[:-1]] / total[g[:-1]] * below

    return [sum(-math.log(p(g)) for g in grams(t)) for t in texts]


def digits(key, tag, d, rounds=8):
    """A keyed network over the digits of a number: halves are added to by what the other gives."""
    u = len(d) // 2
    left, right, a, b = int(d[:u] or 0), int(d[u:]), 10**u, 10 ** (len(d) - u)
    prf = lambda i, x: int(hashlib.sha256(f"{key}|{tag}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(rounds):
        if i % 2 == 0:
            left = (left + prf(i, right)) % a
        else:
            right = (right + prf(i, left)) % b
    return f"{left:0{u}}"[: u or 0] + f"{right:0{len(d) - u}}"


def jaccard(a, b, n=5):
    x, y = ({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in (tokens(a), tokens(b)))
    return len(x & y) / len(x | y)


def student(quantile, df):
    """Student's t quantile, by bisection over sums of its density."""
    grid = np.linspace(0, 60, 600_001)
    density = (1 + grid**2 / df) ** (-(df + 1) / 2)
    area = np.cumsum(density) / density.sum()
    return float(grid[np.searchsorted(area, 2 * quantile - 1)])


def decisions(rows, quantile, prior, lent):
    """(perplexity, threshold, kept) of rows (language, signs, negative log probability, in the fold)."""
    at = lambda x, q: sorted(x)[max(0, math.ceil(q * len(x)) - 1)]
    folds = defaultdict(list)
    for lang, n, nll, fold in rows:
        if fold:
            folds[lang].append((n, nll))
    mean = lambda fold: at([nll / n for n, nll in fold], 0.5)
    middle, whole = {k: mean(v) for k, v in folds.items()}, mean([x for v in folds.values() for x in v])
    drawn = lambda lang, n, nll: (nll + prior * middle.get(lang, whole)) / (n + prior)
    own = {k: [drawn(k, *x) for x in v] for k, v in folds.items()}
    df = sum(len(v) - 1 for v in own.values())
    within = {k: sum((x - sum(v) / len(v)) ** 2 for x in v) for k, v in own.items()}
    lent, known = min(lent, df), sum(within.values()) / df

    def cut(v, spread, free):
        if len(v) * (1 - quantile) >= 1:
            return at(v, quantile)
        return max(at(v, quantile), sum(v) / len(v) + student(quantile, free) * spread * math.sqrt(1 + 1 / len(v)))

    cuts = {k: cut(v, math.sqrt((lent * known + within[k]) / (lent + len(v) - 1)), lent + len(v) - 1) for k, v in own.items()}
    every = [x for v in own.values() for x in v]
    over = cut(every, float(np.std(every, ddof=1)), len(every) - 1)
    out = [(drawn(lang, n, nll), cuts.get(lang, over)) for lang, n, nll, _ in rows]
    return [(math.exp(d), math.exp(c), d <= c) for d, c in out]
