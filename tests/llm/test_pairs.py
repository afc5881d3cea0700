"""Embedding links (op1), Jaccard join (op10) and connected components against brute force."""

import random

import numpy as np
from brute import components, jaccard_links, shingles
from pyspark.sql import types as T

from hammerfield.llm.components import connected_components
from hammerfield.llm.ego import link_vectors
from hammerfield.llm.jaccard import similar_documents

VECTORS = "vec_id long, embedding array<float>, label int, rep string, n string, cell string"


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        x = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.5])
        rows.append((i, [float(v) for v in np.float32(x)], int(rng.integers(3)) if i % 17 else None))
    rows += [(300 + k, rows[5][1], rows[5][2]) for k in range(30)]  # equal vectors
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None] * 8, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] + [1.0] * 15, 1), (405, [], 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (5, rows[5][1], rows[5][2])]
    return [r + ("x", "y", "z") for r in rows]


def brute_vectors(rows, cosine):
    def good(r):
        return r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    links, seen = [], [0] * len(rows)
    unit = [np.array(r[1], float) / np.linalg.norm(r[1]) if good(r) else None for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                seen[i] += 1
                seen[j] += 1
                links.append((rows[i][0], rows[j][0]))
    least = components({r[0] for r in rows}, links)
    return sorted((r[0], n, least[r[0]], r[0] == least[r[0]]) for r, n in zip(rows, seen))


def test_links_equal_brute_force(spark):
    rows = vectors()
    got = link_vectors(spark.createDataFrame(rows, VECTORS), block=16)
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == brute_vectors(rows, 0.98)


def test_block_size_does_not_matter(spark):
    rows = vectors(8)
    frame = spark.createDataFrame(rows, VECTORS)
    small, large = (sorted(map(tuple, link_vectors(frame, cosine=0.9, block=b).collect())) for b in (8, 4096))
    assert small == large == brute_vectors(rows, 0.9)


def test_empty_and_nameless_vectors(spark):
    assert link_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (7, [3.0, -1.0], 1), (8, None, None)]
    got = link_vectors(spark.createDataFrame([r + ("", "", "") for r in rows], VECTORS))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, None, False), (None, 1, None, False), (7, 0, 7, True), (8, 0, 8, True)], key=str)


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):
        base = rng.choices(vocabulary, k=rng.choice([4, 9, 30, 80, 200]))
        for _ in range(rng.choice([1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(rng.choice([" ", "\n", "\t\x0b "]).join(copy))
    rows += ["", None, "   ", "One", "one", "one two", "ONE  two", "the end", "x " * 5000, "x " * 5001, "é à ü ñ ö", "É à ü ñ ö"]
    rows.append(rows[0])
    return [(i * 3, t, "clash", "clash", "clash") for i, t in enumerate(rows)]


DOCS = "doc_id long, text string, `set` string, component string, n_shingles string"


def test_jaccard_join_equals_brute_force(spark):
    for k, num in ((3, 90), (5, 80)):
        rows = texts(k)
        docs = [(r[0], r[1]) for r in rows]
        least = components([i for i, _ in docs], jaccard_links(docs, k, num, 100))
        want = sorted((i, len(shingles(t, k)), least[i]) for i, t in docs)
        frame = spark.createDataFrame(rows, DOCS)
        for family in (1 << 20, 300):  # families cut into pieces give the same
            got = similar_documents(frame, k, num, 100, family=family).collect()
            assert sorted(r[:3] for r in got) == want
            leads = {r.doc_id for r in got if r.leads}
            assert leads == {least[i] for i in least}


def test_jaccard_join_of_nothing_nulls_and_repeated_rows(spark):
    assert similar_documents(spark.createDataFrame([], DOCS)).collect() == []
    text = "a b c d e f g h"
    rows = [(None, text), (4, text), (4, text), (9, text + " i"), (None, None), (2, None)]
    got = similar_documents(spark.createDataFrame([r + ("", "", "") for r in rows], DOCS), 3, 80, 100)
    want = [(None, 6, 4), (4, 6, 4), (4, 6, 4), (9, 7, 4), (None, 0, None), (2, 0, 2)]
    assert sorted((r[:3] for r in got.collect()), key=str) == sorted(want, key=str)
    leads = sorted((r.doc_id, r.n_shingles) for r in got.collect() if r.leads and r.doc_id is not None)
    assert leads == [(2, 0), (4, 6), (4, 6)]


def random_sets(seed, n, words):
    """Documents of shared and own words, so that many pairs are close to the threshold and some words are very common."""
    rng = random.Random(seed)
    passages = [[f"p{i}x{j}" for j in range(40)] for i in range(4)]
    rows = []
    for i in range(n):
        base = rng.randrange(n // 6)
        own = [f"d{base}y{j}" for j in range(words)]
        for _ in range(rng.randrange(0, words // 6)):
            own[rng.randrange(words)] = f"z{rng.randrange(1 << 30)}"
        rows.append((i, " ".join(own + rng.choice(passages))))
    return rows


def test_jaccard_join_near_the_threshold_and_with_common_shingles(spark):
    for seed, num, hot in ((1, 90, 16), (2, 80, 2), (3, 60, 2)):
        docs = random_sets(seed, 240, 60)
        least = components([i for i, _ in docs], jaccard_links(docs, 3, num, 100))
        assert len(set(least.values())) < len(docs)
        frame = spark.createDataFrame([r + ("", "", "") for r in docs], DOCS).repartition(3)
        got = {r.doc_id: r.component_id for r in similar_documents(frame, 3, num, 100, hot=hot).collect()}
        assert got == least


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 230)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    rng.shuffle(edges)
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, schema))
    assert {r.node: r.component for r in got.collect()} == {k: v for k, v in components(nodes, [e for e in edges if e[0] != e[1]]).items()}
    assert got.count() == len(nodes)
    assert connected_components(spark.createDataFrame([], schema)).collect() == []
