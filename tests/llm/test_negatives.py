"""Hard negatives and packed products against plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hammerfield.llm import negatives


@pytest.mark.parametrize("low,high,d", [(-132, 145, 64), (0, 0, 5), (-3, -1, 7), (0, 9, 3), (-(2**20), 2**20, 64), (-(2**27), 2**27, 40), (2**10, 2**11, 1), (-1, 1, 300)])
def test_packed_products_are_exact(low, high, d):
    rng = np.random.default_rng(d)
    for n, m in ((1, 1), (7, 50), (20, 3)):
        a, b = rng.integers(low, high + 1, (n, d)), rng.integers(low, high + 1, (m, d))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        got = negatives.products(a.astype(float), b.astype(float))
        info = np.iinfo(np.int64)
        assert got.tolist() == [[min(max(x, info.min), info.max) for x in r] for r in want]
    assert negatives.products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2
    assert negatives.products(np.full((1, 2), 2.0**60), np.full((1, 2), 2.0**60)).tolist() == [[np.iinfo(np.int64).max]]


def test_several_fields_share_a_number():
    a = np.random.default_rng(1).integers(-132, 145, (30, 64)).astype(float)
    width = (64 * 277 * 277).bit_length()
    assert negatives.EXACT // width == 2
    assert (negatives.products(a, a) == (a @ a.T)).all()


def plain(rows, every=10):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, lab, tuple(v)) for i, lab, v in good if i % every == 0}
    out = []
    for i, lab, v in anchors:
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in good if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:5]:
            hard = sorted(x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


def vectors(seed, n=400, d=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, d))
    label = rng.integers(0, 4, n)
    v = centre[label] + rng.normal(size=(n, d)) * 0.8
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[rng.random(n) < 0.3] = np.round(v[0], 1)  # a third is one vector: many ties
    rows = [(int(i), int(k), [float(np.float32(x)) for x in w]) for i, k, w in zip(range(n), label, v)]
    rows += [rows[3], rows[20], rows[21], (40, 2, rows[5][2]), (None, 1, rows[1][2]), (500, None, rows[1][2]), (510, 1, None), (520, 1, [None] * d), (530, 1, [float("nan")] * d), (540, 1, [float("inf")] * d)]
    rows += [(550, 0, [0.0] * d), (560, 1, []), (561, 1, []), (562, 2, []), (570, 1, [1.0, 0.5]), (571, 1, [1.0, 0.25]), (572, 3, [0.5, 0.5]), (580, 9, rows[2][2]), (-10, 1, rows[4][2])]
    return rows


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("seed,block,anchors,tile", [(1, 4096, 512, 16), (2, 16, 4, 2), (3, 7, 1, 1)])
def test_negatives_equal_plain_ones(spark, seed, block, anchors, tile, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = vectors(seed)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", rank int, score int").repartition(5)
    got = negatives.mine(frame, F.col("vec_id") % 10 == 0, block=block, anchors=anchors).collect()
    assert sorted(map(tuple, got)) == plain(rows)
    assert len({r.anchor_id for r in got}) > 20


def test_empty_tables_and_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, F.col("vec_id") % 10 == 0).collect() == []
    rows = [(1, 1, [1.0]), (2, 1, [0.5]), (3, 2, [0.4])]
    assert negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    got = negatives.mine(spark.createDataFrame([(10, 1, [1.0]), *rows], SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == [(10, 1, 1, 3, 65536, 26112), (10, 2, 1, 3, 32768, 26112)]
