"""Plain Python versions of what the operators compute, for small inputs."""

import itertools
import re
from collections import Counter, defaultdict
from math import log10

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def words(text):
    return [w for w in SPACE.split(lower(text)) if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(ids, links):
    """Smallest id reachable from each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_links(docs, k, num, den):
    sets = {i: shingles(t, k) for i, t in docs}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            yield a, b


def repeated(texts, least):
    """For each text (bytes) which bytes a string of `least` bytes that starts anywhere else covers."""
    starts = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if starts[t[i : i + least]] > 1:
                covered[i : i + least] = b"\1" * least
        out.append(covered)
    return out


def spans(covered):
    return [m.span() for m in re.finditer(rb"\x01+", bytes(covered))]


def edit_words(text):
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower()) if text else []


def stretch_distance(item, text):
    """Least edit distance of item to any stretch of text, in words, and the end of the first such stretch."""
    row = list(range(len(item) + 1))
    best, end = row[-1], 0
    for j, w in enumerate(text, 1):
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != w)))
        row = new
        if row[-1] < best:
            best, end = row[-1], j
    return best, end


def jump(key, buckets):
    """Jump consistent hash as published."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def ppm_symbols(text):
    w = words(text)
    return [*b" ".join(w), 256] if w else [256]


class Ppm:
    """Prediction by partial matching, method C with exclusion."""

    def __init__(self, texts, order):
        self.order = order
        self.nodes = [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            for ctx, s in self.positions(t):
                for k in range(order + 1):
                    self.nodes[k][ctx[order - k :]][s] += 1

    def positions(self, text):
        past = [0] * self.order
        for s in ppm_symbols(text):
            yield tuple(past), s
            past = (past + [s])[1:] if self.order else []

    def score(self, text):
        total = 0.0
        for ctx, s in self.positions(text):
            gone = set()
            for k in range(self.order, -1, -1):
                node = {x: n for x, n in self.nodes[k].get(ctx[self.order - k :], {}).items() if x not in gone}
                if not node:
                    continue
                all_ = sum(node.values()) + len(node)
                if s in node:
                    total += log10(node[s] / all_)
                    break
                total += log10(len(node) / all_)
                gone |= node.keys()
            else:
                total -= log10(257 - len(gone))
        return total
