"""Quality classifier (op5) and language model (op7): held-out accuracy and brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from brute import Ppm, words

from hammerfield.llm import ppm, quality

DOCS = "doc_id long, text string, label string, score string, train string, block string, row string"
LABELS = "doc_id long, quality int, toxic int, label string, o string"


def prose(rng, good):
    nouns = ["river", "house", "garden", "letter", "market", "window", "teacher", "winter"]
    if good:
        return " ".join(f"The {rng.choice(nouns)} near the {rng.choice(nouns)} was {rng.choice(['quiet', 'old', 'bright'])}." for _ in range(rng.randrange(3, 20)))
    return " ".join(rng.choice(["click HERE", "buy buy now", "$$$", "x9z#q", "free free"]) for _ in range(rng.randrange(3, 40)))


def corpus(n=500, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 2
        rows.append((i, prose(rng, good), "a", "b", "c", "d", "e"))
        if i % 3:
            labels.append((i, good, 0, "x", "y"))
    rows += [(n, None, *"abcde"), (n + 1, "", *"abcde"), (n + 2, "The river " * 40_000, *"abcde"), (3, rows[3][1], *"abcde"), (None, "The house", *"abcde")]
    return rows, labels + [(None, 1, 0, "x", "y"), (7, None, 0, "x", "y"), (1, 1, 0, "x", "y"), (99_999, 1, 0, "x", "y")]


def out(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (out(r.doc_id, 4) == 2 and r.doc_id is not None) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert len(held) > 80
    assert sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_held_out_labels_are_not_learnt_from(spark):
    rows, labels = corpus()
    frame = spark.createDataFrame(rows, DOCS)
    turned = [(i, 1 - q if q is not None and out(i, 4) == 2 else q, t, a, b) for i, q, t, a, b in labels]
    a, b = (sorted(((r.doc_id or -1, r.score) for r in quality.classify(frame, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, turned))
    assert a == b


def test_classifier_without_labels_or_documents(spark):
    rows, labels = corpus(40)
    frame = spark.createDataFrame(rows, DOCS)
    assert {r.score for r in quality.classify(frame, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    one = quality.classify(frame, spark.createDataFrame([x for x in labels if x[1] == 1], LABELS)).collect()
    assert all(r.score > 0.9 for r in one)
    assert quality.classify(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []


def test_held_out_accuracy_on_test_tables(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    rank = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert rank > 0.9


def plain_features(text):
    """Buckets of a text by the definition."""
    raw = (text or "").encode()
    import numpy as np

    out = []
    for k in quality.GRAMS:
        for i in range(len(raw) - k + 1):
            g = int.from_bytes(raw[i : i + k], "big")
            out.append(((g + k) * int(quality._SALT) % (1 << 64)) >> 48)
    body = np.frombuffer(raw, np.uint8)
    before = None
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        out.append(int(quality.X.block_hash(body, np.array([m.start()]), np.array([m.end()]))[0]) >> 48)
        if m.group() == before:
            out.append(int(quality._SALT) >> 48)
        before = m.group()
    return out


def test_features_and_scores_equal_brute_force():
    import numpy as np
    import pyarrow as pa

    texts = ["The cat cat sat", "", None, "é中 é中 x", " a ", "word " * 300]
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    got = quality.score_texts(pa.array(texts), model)
    for text, score, (ids, shares) in zip(texts, got, quality.bags(pa.array(texts))):
        counts = Counter(plain_features(text))
        total = sum(counts.values())
        assert dict(zip(ids.tolist(), shares.tolist())) == pytest.approx({k: n / total for k, n in counts.items()})
        mean = sum(n * float(model.bucket[k]) for k, n in counts.items()) / max(1, total)
        assert score == pytest.approx(1 / (1 + math.exp(-mean - 0.3)), rel=1e-6)


def test_training_equals_plain_gradient_descent(monkeypatch):
    """Two epochs in Python loops: an average of vectors, a softmax layer, classes weighted equally."""
    import numpy as np

    monkeypatch.setattr(quality, "BUCKETS", 8)
    monkeypatch.setattr(quality, "EPOCHS", 2)
    monkeypatch.setattr(quality, "BATCH", 2)
    rows = [([0, 3], [0.5, 0.5]), ([1], [1.0]), ([], []), ([3, 5, 7], [0.25, 0.25, 0.5]), ([2, 6], [0.75, 0.25])]
    labels = np.array([1, 0, 1, 1, 0])
    got = quality.train([(np.array(i, np.int32), np.array(w, np.float32)) for i, w in rows], labels)
    rng = np.random.default_rng(quality.SEED)
    emb = ((rng.random((8, quality.DIM), np.float32) - 0.5) / quality.DIM).astype(float).tolist()
    out, bias = [[0.0, 0.0] for _ in range(quality.DIM)], [0.0, 0.0]
    steps = done = 0
    steps = 2 * 3
    for _ in range(2):
        order = rng.permutation(5)
        for k in (0, 2, 4):
            rate = quality.RATE * (1 - done / steps)
            done += 1
            grads = []
            for i in order[k : k + 2]:
                hidden = [sum(w * emb[b][d] for b, w in zip(*rows[i])) for d in range(quality.DIM)]
                z = [math.exp(sum(hidden[d] * out[d][c] for d in range(quality.DIM)) + bias[c]) for c in (0, 1)]
                weight = 5 / (2 * 3) if labels[i] else 5 / (2 * 2)
                g = [(z[c] / sum(z) - (labels[i] == c)) * weight for c in (0, 1)]
                grads.append((i, hidden, g, [sum(g[c] * out[d][c] for c in (0, 1)) for d in range(quality.DIM)]))
            for i, hidden, g, back in grads:
                for c in (0, 1):
                    bias[c] -= rate * 0.1 * g[c] / len(grads)
                    for d in range(quality.DIM):
                        out[d][c] -= rate * hidden[d] * g[c]
                for b, w in zip(*rows[i]):
                    for d in range(quality.DIM):
                        emb[b][d] -= rate * 30 * w * back[d]
    want = [sum(e[d] * (out[d][1] - out[d][0]) for d in range(quality.DIM)) for e in emb]
    assert got.bucket.tolist() == pytest.approx(want, abs=1e-4)
    assert got.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)


def test_sample_is_of_labelled_documents_and_one_row_of_an_id(spark):
    rows, labels = corpus(60)
    frame = spark.createDataFrame(rows + [rows[5]] * 50 + [(5, "another text", *"abcde")], DOCS)
    many = labels + [(i, i % 2, 0, "x", "y") for i in range(10**6, 10**6 + 3000)]
    a = quality.fit(frame, spark.createDataFrame(many, LABELS).selectExpr("doc_id", "quality AS label"), rows=40)
    b = quality.fit(spark.createDataFrame(rows + [(5, "another text", *"abcde")], DOCS), spark.createDataFrame(labels, LABELS).selectExpr("doc_id", "quality AS label"), rows=40)
    assert (a.bucket == b.bucket).all() and a.bias == b.bias and a.bucket.any()


TEXTS = ["The cat sat on the mat", "the CAT sat\ton the dog", "abracadabra abracadabra", "", None, "  ", "zzz", "the the the the", "é中 é中", "a", "The cat sat on the mat"] * 6


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_equals_brute_force(spark, order):
    rows = [(i, t, *"abcde") for i, t in enumerate(TEXTS)] + [(12, TEXTS[1], *"abcde"), (None, "the end", *"abcde"), (500, "long words here " * 9000, *"abcde")]
    learnt = [t for i, t, *_ in rows if i is None or out(i, 5) != 1]
    model = Ppm(learnt, order)
    counts = Counter(w for t in learnt for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        want.append((-1 if i is None else i, i is not None and out(i, 5) == 1, len(tokens), sum(w in counts for w in tokens), total, base, model.score(t)))
    for edges in (1 << 20, 60, 9):  # whole, in parts, and with branches cut
        got = ppm.score_documents(spark.createDataFrame(rows, DOCS), order, part_edges=edges).collect()
        have = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got)
        assert len(have) == len(want)
        for a, b in zip(have, sorted(want)):
            assert a[:5] == b[:5]
            assert a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-5)


def test_ppm_of_nothing(spark):
    assert ppm.score_documents(spark.createDataFrame([], DOCS)).collect() == []
    alone = next(i for i in range(99) if out(i, 5) == 1)
    (r,) = ppm.score_documents(spark.createDataFrame([(alone, "ab", *"abcde")], DOCS)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)
    assert r.score == pytest.approx(-3 * math.log10(257)) and r.base_score == pytest.approx(0.0)


def test_ppm_probabilities_sum_to_one():
    import numpy as np

    texts = b"abracadabra"
    sym, doc = ppm.symbols(np.frombuffer(texts, np.uint8), np.array([0, len(texts)]))
    code, n = np.unique(ppm.codes(sym, doc, 3), return_counts=True)
    low, at = np.unique(code & np.uint64((1 << 17) - 1), return_inverse=True)
    trie = ppm.Trie(code, n, (low, np.bincount(at, n)), 3)
    for ctx in (b"abr", b"xyz", b"\0\0a", b"zra"):
        context = int.from_bytes(ctx, "big")
        every = np.array([context << 9 | s for s in range(257)], np.uint64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1, abs=1e-6)


def test_ppm_in_parts_scores_contexts_that_no_training_text_has(spark):
    learnt, held = (next(i for i in range(99) if (out(i, 5) == 1) == x) for x in (False, True))
    unseen = "zzz qxq \x01\x02\x03 élan ÿÿÿ the mat aa bb mm 00 99"  # pairs of bytes below, between and above the parts
    rows = [(learnt, "the cat sat on the mat and the dog sat on the log " * 3, *"abcde"), (held, unseen, *"abcde")]
    want = {learnt: None, held: None}
    for edges in (1 << 20, 60, 7):
        got = {r.doc_id: r.score for r in ppm.score_documents(spark.createDataFrame(rows, DOCS), part_edges=edges).collect()}
        want = got if want[held] is None else want
        assert got == pytest.approx(want, rel=1e-5, abs=1e-5)
    model = Ppm([rows[0][1]], 5)
    assert want[held] == pytest.approx(model.score(unseen), rel=1e-5)


def test_ppm_layout_puts_every_key_in_one_part():
    import numpy as np

    for most in (1000, 40, 7, 1):
        layout = ppm.Layout(np.array([5, 900, 901, 65_535]), np.array([3, 41, 9, 80]), 60, most)
        key = np.array([a << 25 | b << 9 for a in range(256) for b in (0, 5, 6, 899, 900, 901, 902, 65_534, 65_535)])
        part = layout.part(key)
        assert part.min() >= 0 and part.max() < layout.tries
        assert len(set(part[(key >> 9) & 0xFFFF == 900])) == layout.cut[900] == (1 if most >= 41 else min(256, -(-41 // most)))
        by_branch = [set(part[(key >> 9) & 0xFFFF == b]) for b in (5, 900, 901, 65_535)]
        for x, a in zip(by_branch, (5, 900, 901, 65_535)):
            for y, b in zip(by_branch, (5, 900, 901, 65_535)):
                assert a == b or not x & y or layout.cut[a] == layout.cut[b] == 1
        word = layout.part(np.arange(-1 << 63, (-1 << 63) + (1 << 20), 1 << 8))
        assert word.min() >= layout.tries and word.max() < layout.parts


def test_ppm_packing_gives_keys_back():
    import numpy as np

    key = np.unique(np.random.default_rng(3).integers(-(1 << 63), 1 << 62, 1000))
    assert (ppm.unpacked(ppm.packed(key)) == key).all()
    assert len(ppm.unpacked(ppm.packed(key[:0]))) == 0
