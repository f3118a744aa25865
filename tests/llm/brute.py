"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(rows, width=20):
    """[(doc_id, text)] -> {doc_id: (n_words, n_removed, sha256)}"""
    first, all_words = {}, {}
    for d, t in sorted(rows):
        w = all_words[d] = words(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i:i + width]), (d, i))
    out = {}
    for d, w in all_words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] != (d, i):
                gone |= set(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def jaccard(rows, shingle=5, percent=75):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component_id)}"""
    sets = {}
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def rule_stats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + j for i, x in enumerate(windows) if x in twice for j in range(8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(rows, items, width=10):
    """[(doc_id, text)], [(item_id, text)] -> {doc_id: (n_words, n_hit, items)}"""
    windows = {}
    for i, t in items:
        w = item_words(t)
        for s in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[s:s + width]), set()).add(i)
    out = {}
    for d, t in rows:
        w, hit, found = item_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s:s + n]))
                if got:
                    hit |= set(range(s, s + n))
                    found |= got
        out[d] = (len(w), len(hit), sorted(map(str, found)))
    return out


def kneser_ney(trusted, asked, order=4):
    """Log-probabilities of n-grams (tuples) under an interpolated modified Kneser-Ney model of the trusted n-grams."""
    from collections import Counter
    from math import log

    counts = {order: Counter(trusted)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, total, kinds = {}, {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        cut[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]
        total[k], kinds[k] = Counter(), Counter()
        for g, v in c.items():
            total[k][g[:-1]] += v
            kinds[k][g[:-1]] += cut[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        low = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        h = g[:-1]
        if not total[k][h]:
            return low
        v = counts[k][g]
        return (max(v - cut[k][min(v, 3) - 1], 0) / total[k][h] if v else 0) + kinds[k][h] / total[k][h] * low

    return {g: log(p(g)) for g in asked}
