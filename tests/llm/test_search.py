"""The ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hammerfield.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t, Counter(t)) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(x for _, _, c in held for x in c)
    w = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for x, d in df.items()}
    out = []
    for item, text in items:
        query = Counter(terms(text))
        scored = []
        for i, t, c in held:
            m = 75 + 25 * len(t) * n // total
            score = sum(q * w[x] * (1_000_000_000 * c[x] // (1000 * c[x] + 12 * m)) for x, q in query.items() if x in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -score) for r, (score, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Äö", "中文", "İ", "ß9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    line = lambda k: rng.choice([" ", ", ", "-"]).join(rng.choice([str.upper, str])(x) for x in rng.choices(vocabulary, weights, k=k))
    docs = [(i, line(rng.randrange(1, 60))) for i in range(n)]
    docs += [docs[0], (None, docs[1][1]), (None, docs[1][1]), (n, None), (n + 1, ""), (n + 2, " .-/ "), (5, docs[7][1]), (-3, docs[7][1]), (n + 3, line(20_000))]
    items = [(i, line(rng.randrange(1, 25))) for i in range(12)] + [(3, "w0 w0 w0 W0"), (3, "w0 w0 w0 W0"), (None, "w1 w2"), (20, None), (21, ""), (22, "unheard of")]
    return docs, items


@pytest.mark.parametrize("seed,shard,k", [(1, 2_000_000, 20), (2, 300, 20), (3, 1, 3)])
def test_search_equals_scores_of_all(spark, seed, shard, k):
    docs, items = corpus(seed, 300)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, score string").repartition(3)
    asked = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, rank int")
    got = sorted(map(tuple, search.search(frame, asked, k, shard).collect()), key=str)
    assert got == plain(docs, items, k)


def test_empty_tables(spark):
    docs, items = corpus(4, 9)
    d, i = "doc_id long, text string", "item_id long, text string"
    assert search.search(spark.createDataFrame([], d), spark.createDataFrame(items, i)).collect() == []
    assert search.search(spark.createDataFrame(docs, d), spark.createDataFrame([], i)).collect() == []
    assert search.search(spark.createDataFrame([(1, None), (2, "--")], d), spark.createDataFrame(items, i)).collect() == []


def test_best_positions_stop_early_and_lose_nothing():
    """A document at the top of all lists ends the search long before the lists do; ties at the k-th score go on."""
    n = 50_000
    rng = np.random.default_rng(3)
    doc = np.tile(np.arange(n), 3)
    term = np.repeat(np.arange(3), n)
    impact = np.concatenate([rng.permutation(n) + 1 for _ in range(3)])
    impact[doc == 777] = 10 * n
    lists = search.Shard(n, 3, doc, term, impact)
    total = np.bincount(doc, impact).astype(np.int64)
    for k in (1, 20):
        top, scores, looked = search.best(lists, np.arange(3), np.array([1, 2, 1]), np.arange(n), k)
        whole = total + impact[n : 2 * n]
        want = np.lexsort((np.arange(n), -whole))[:k]
        assert top.tolist() == want.tolist() and scores.tolist() == whole[want].tolist()
        assert looked < n / 3
    assert search.best(lists, np.arange(3), np.array([1, 2, 1]), np.arange(n), 1)[2] < 200
    same = search.Shard(n, 1, np.arange(n), np.zeros(n, np.int64), np.full(n, 5))
    top, scores, looked = search.best(same, np.array([0]), np.array([1]), np.arange(n)[::-1], 2)
    assert top.tolist() == [n - 1, n - 2] and looked == n
    assert search.best(same, np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(n), 2)[0].tolist() == []


def test_a_list_seen_without_a_gap_tightens_the_threshold():
    """Direct accesses fill one list's positions beyond the rows read from it."""
    n = 4000
    doc = np.r_[np.arange(n), np.arange(n)]
    impact = np.r_[np.arange(n, 0, -1) + 1000, np.where(np.arange(n) < 64, 5000 - np.arange(n), 1)]
    lists = search.Shard(n, 2, doc, np.repeat([0, 1], n), impact)
    place, value = lists.look_up(1, np.array([0, 63, 64]))
    assert place.tolist() == [0, 63, 64] and value.tolist() == [5000, 4937, 1]
    _, _, looked = search.best(lists, np.array([0, 1]), np.array([1, 1]), np.arange(n), 5, rows=16)
    assert looked <= 48


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    real = search.X.block_hash
    terms_ = search.terms_of(pa.array(["alpha", "beta"]))
    monkeypatch.setattr(search.X, "block_hash", lambda r, s, e, salt=0: real(r, s, e, salt) if salt else np.full(len(s), terms_.key[0]))
    raw, off = search.X.text_bytes(pa.array(["alpha gamma gamma"]))
    size, doc, term, tf = search.count_terms(terms_, raw, off)
    assert size.tolist() == [3] and tf.sum() <= 1
