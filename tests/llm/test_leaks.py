"""Benchmark decontamination (op2) against brute force."""

import random

from brute import edit_words, stretch_distance

from hammerfield.llm import decontam

DOCS, ITEMS = "doc_id long, text string, distance string, item_id string", "item_id long, text string, doc_id string"


def brute(docs, items):
    out = {}
    for d, text, *_ in docs:
        words = edit_words(text)
        for i, item, *_ in items:
            pattern = edit_words(item)
            if len(pattern) >= 5:
                most = int(0.2 * len(pattern) + 1e-9)
                got, end = stretch_distance(pattern, words)
                if got <= most:
                    out[d, i] = (got, end)
    return out


def planted(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 8, 20, 45]))), "x") for i in range(60)]
    items += [(100, "too short", "x"), (101, None, "x"), (102, "", "x"), (103, items[0][1].upper(), "x")]
    docs = []
    for d in range(160):
        words = rng.choices(vocabulary, k=rng.choice([0, 10, 300]))
        if d % 2:
            copy = items[rng.randrange(60)][1].split()
            for _ in range(rng.randrange(int(0.2 * len(copy)) + 1)):
                at, kind = rng.randrange(len(copy)), rng.randrange(3)
                copy[at : at + (kind < 2)] = [] if kind == 0 and len(copy) > 1 else [rng.choice(vocabulary)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words), "a", "b"))
    return docs + [(900, None, "a", "b"), (901, "", "a", "b"), (902, "w " * 30000 + items[3][1], "a", "b"), (902, items[3][1], "a", "b")], items


def test_recall_and_exact_distances(spark):
    docs, items = planted()
    want = brute([d for d in docs if d[0] != 902], items)
    got = decontam.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    found = {(r.doc_id, r.item_id): (r.distance, r.last_word) for r in got if r.doc_id != 902}
    assert found.keys() <= want.keys()
    assert all(found[k][0] == want[k][0] for k in found)
    assert len(found) >= 0.95 * len(want) and len(want) > 60
    assert sum(r.doc_id == 902 and r.item_id == 3 for r in got) == 2  # repeated rows each count, however long


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    docs, items = planted(6)
    frame, table = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    whole = {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, table).collect()}
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (4000,))
    blocks = {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, table).collect()}
    assert len(whole & blocks) >= 0.95 * len(whole | blocks)
    assert decontam.find_leaks(spark.createDataFrame([], DOCS), table).collect() == []
    assert decontam.find_leaks(frame, spark.createDataFrame([], ITEMS)).collect() == []


def test_recall_of_each_length_of_items():
    """As many edits as the limit allows, other words around: short items in a block of long ones, and each length alone."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    for lengths in ([5] * 20 + [9] * 20 + [100] * 300, [16] * 40 + [45] * 40, [5] * 40, [24] * 40, [29] * 40):
        items = [rng.choices(vocabulary, k=n) for n in lengths]
        index = decontam.build(list(range(len(items))), pa.array([" ".join(w) for w in items]))
        short = [i for i, n in enumerate(lengths) if n < 100]
        docs = [(i, [*rng.choices(vocabulary, k=30), *decontam.edited(np.arange(lengths[i]), int(0.2 * lengths[i] + 1e-9), np.random.default_rng(i * 10 + k)).tolist(), *rng.choices(vocabulary, k=30)]) for i in short for k in range(8)]
        texts = [" ".join(x if isinstance(x, str) else items[i][x] if x < lengths[i] else f"new{x}" for x in words) for i, words in docs]
        raw, off = decontam.X.text_bytes(pa.array(texts))
        found = {(d, i) for d, i, *_ in decontam.search(index, *decontam.word_hashes(raw, off), len(texts), 0.8)}
        for n in {lengths[i] for i in short}:
            own = [(d, i) for d, (i, _) in enumerate(docs) if lengths[i] == n]
            assert len(found & set(own)) >= 0.95 * len(own), (n, len(own))
