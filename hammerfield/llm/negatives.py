"""Hard negatives for anchors by Kronecker-packed products.

Components are whole numbers. To score an anchor against many candidates, the candidates' components at one place are
made non-negative by a bias and laid side by side in separated fields of one wide number, wide enough for the largest
sum that can arise; the anchor's component multiplies all of them at once, and after the last component the fields are
unpacked and the biases taken off again. The wide numbers are kept in doubles, which hold whole numbers of 53 bits
exactly, so a product of matrices does the multiplications and nothing is rounded. Where not even one field fits,
Python's unbounded integers take the place of doubles.

Anchors and candidates are written as blocks. Blocks meet in tiles: groups of candidate blocks by groups of anchor
blocks, so that a task's share is bounded whatever the tables' sizes, and each side is copied to as many tiles as the
other side has groups. Positives come first (rows of an anchor's label), then negatives between the bounds that each
positive's score sets. A task keeps the best of what it has seen for each anchor, so a tile returns a few rows an
anchor, which meet by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ego import _by_length
from .workspace import discard, stage, text_batches

POSITIVES, NEGATIVES = 5, 10
#: Per cent of a positive's score between which its negatives' scores lie.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows of a block of candidates and of anchors; blocks of a tile on each side.
BLOCK, ANCHORS, TILE = 4096, 512, 16
#: Bits of a whole number that a double holds exactly.
EXACT = 53
NONE = np.iinfo(np.int64).min


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles, which are whole numbers; beyond the range of doubles, its ends."""
    top = np.finfo(np.float64).max / SCALE / 2
    return np.floor(np.clip(x, -top, top) * SCALE)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with the rows of b (whole numbers in doubles), as int64.

    Products beyond the range of a long become its ends.
    """
    n, d = len(b), a.shape[1]
    if not d or not len(a) or not n:
        return np.zeros((len(a), n), np.int64)
    bias_a, bias_b = max(0, -int(a.min())), max(0, -int(b.min()))
    most = d * (int(a.max()) + bias_a) * (int(b.max()) + bias_b)
    width = most.bit_length() or 1
    fields = EXACT // width
    if not fields:
        wide = np.array([[int(x) for x in r] for r in a.tolist()], object) @ np.array([[int(x) for x in r] for r in b.tolist()], object).T
        info = np.iinfo(np.int64)
        return np.clip(wide, info.min, info.max).astype(np.int64)
    # candidates i, i + rows, i + 2 rows ... share a wide number
    rows = -(-n // fields)
    packed = np.zeros((rows, d))
    for f in range(fields):
        part = b[f * rows : (f + 1) * rows]
        packed[: len(part)] += (part + bias_b) * float(1 << f * width)
    sums = ((a + bias_a) @ packed.T).astype(np.int64)
    out = np.empty((len(a), fields * rows), np.int64)
    for f in range(fields):
        out[:, f * rows : (f + 1) * rows] = sums >> f * width & (1 << width) - 1
    # sum (x + p)(y + q) = sum xy + q sum x + p sum y + d p q
    off = bias_b * a.sum(axis=1).astype(np.int64)[:, None] + bias_a * b.sum(axis=1).astype(np.int64)[None] + d * bias_a * bias_b
    return out[:, :n] - off


def leading(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k highest of each row of scores that are not NONE, equal scores by the smaller id."""
    n = scores.shape[1]
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else scores.min(axis=1)
    row, col = np.nonzero((scores >= least[:, None]) & (scores != NONE))
    return first_of(row, ids[col], scores[row, col], k)


def first_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first entries of each row, by falling score, then id."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    start = np.searchsorted(row, row)
    keep = np.arange(len(row)) - start < k
    return row[keep], ids[keep], score[keep]


def usable(rows: DataFrame) -> Column:
    """Rows with an id, a label and a vector of finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))


BLOCKS = "block string, length int, n long, ids binary, labels binary, body binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, label, embedding) as blocks of one vector length, sorted by label, of up to `size` rows, where they are read."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def emit(length: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held.pop(length)).sort_by([("label", "ascending"), ("vec_id", "ascending")])
            body = pa.concat_arrays([c.flatten() for c in table.column("embedding").chunks]).to_numpy(zero_copy_only=False)
            ids, labels = (table.column(c).to_numpy().astype("<i8") for c in ("vec_id", "label"))
            data = whole(body.astype(np.float64)).reshape(len(ids), length)
            if not data.size or np.abs(data).max() < 1 << 15:
                data = data.astype("<i2")
            return pa.RecordBatch.from_arrays([pa.array([np.random.default_rng().bytes(12).hex()]), pa.array([length], pa.int32()), pa.array([len(ids)]), *(pa.array([x.tobytes()]) for x in (ids, labels, data))], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for part in _by_length(batch, "embedding"):
                if not part.num_rows:
                    continue
                length, at = len(part.column(2)[0]), 0
                while at < part.num_rows:
                    have = sum(b.num_rows for b in held.get(length, []))
                    held.setdefault(length, []).append(part.slice(at, size - have))
                    at += size - have
                    if at <= part.num_rows:
                        yield emit(length)
        for length in list(held):
            yield emit(length)

    return rows.select("vec_id", "label", "embedding").mapInArrow(make, BLOCKS)


def _tiles(candidates: DataFrame, anchors: DataFrame, more: list[str]) -> DataFrame:
    """Each pair of a candidate and an anchor block of one length, once: joined by the tile that both belong to."""
    n, m = (max(1, -(-x.count() // TILE)) for x in (candidates, anchors))
    group = lambda parts: F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = candidates.select("length", group(n).alias("c"), every(m).alias("a"), "ids", "labels", "body")
    own = [F.col(x).alias(f"a_{x}") for x in ["block", "ids", "labels", "body", *more]]
    right = anchors.select("length", group(m).alias("a"), every(n).alias("c"), *own)
    return left.join(right, ["length", "c", "a"]).select("length", "ids", "labels", "body", *[f"a_{x}" for x in ["block", "ids", "labels", "body", *more]])


class _Best:
    """Per anchor block, the best entries so far of each of its rows; the oldest block goes out when there are too many."""

    def __init__(self, k: int, most: int = 32):
        self.k, self.most, self.held = k, most, {}

    def add(self, block: str, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        old = self.held.pop(block, None)
        if old is not None:
            row, ids, score = first_of(*(np.r_[x, y] for x, y in zip(old, (row, ids, score))), self.k)
        self.held[block] = (row, ids, score)
        if len(self.held) > self.most:
            yield self.out(next(iter(self.held)))

    def out(self, block: str) -> pa.RecordBatch:
        row, ids, score = self.held.pop(block)
        return pa.RecordBatch.from_arrays([pa.array([block] * len(row), pa.string()), pa.array(row, pa.int32()), pa.array(ids), pa.array(score)], ["block", "row", "id", "score"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for block in list(self.held):
            yield self.out(block)


FOUND = "block string, row int, id long, score long"


def _arrays(batch: pa.RecordBatch, k: int) -> tuple:
    """Ids, labels and components of the candidates and of the anchors of a row of tiles, and the anchors' block."""
    length, ids, labels, body, block, a_ids, a_labels, a_body = (batch.column(c)[k].as_py() for c in range(8))
    ids, labels, a_ids, a_labels = (np.frombuffer(x, "<i8") for x in (ids, labels, a_ids, a_labels))
    # two bytes a component where they all fit
    numbers = lambda x, n: np.frombuffer(x, "<f8" if len(x) == 8 * n * length else "<i2").astype(np.float64).reshape(n, length)
    return ids, labels, numbers(body, len(ids)), block, a_ids, a_labels, numbers(a_body, len(a_ids))


def _positives(k: int):
    """The k best rows of each anchor's own label, itself excepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for n in range(batch.num_rows):
                ids, labels, x, block, a_ids, a_labels, y = _arrays(batch, n)
                # both are sorted by label: each label is a range
                for label in np.intersect1d(labels, a_labels):
                    a, b = np.searchsorted(labels, [label, label + 1])
                    c, d = np.searchsorted(a_labels, [label, label + 1])
                    scores = products(y[c:d], x[a:b])
                    scores[a_ids[c:d, None] == ids[None, a:b]] = NONE
                    row, found, score = leading(scores, ids[a:b], k)
                    yield from best.add(block, row + c, found, score)
        yield from best.rest()

    return run


def _negatives(k: int, per: int, low: int, high: int):
    """For each anchor and positive (row: anchor x per + place of the positive) the k best rows of other labels between the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for n in range(batch.num_rows):
                ids, labels, x, block, a_ids, a_labels, y = _arrays(batch, n)
                where, bound = np.array([(p["row"] * per + p["rank"] - 1, p["score"]) for p in batch.column(8)[n].as_py()], object).reshape(-1, 2).T
                if not len(where):
                    continue
                where = where.astype(np.int64)
                # the bounds as whole numbers, exact at any size
                least = np.array([-(-low * int(s) // 100) for s in bound]).astype(np.int64)
                most = np.array([high * int(s) // 100 for s in bound]).astype(np.int64)
                scores = products(y, x)
                for label in np.intersect1d(labels, a_labels):
                    a, b = np.searchsorted(labels, [label, label + 1])
                    c, d = np.searchsorted(a_labels, [label, label + 1])
                    scores[c:d, a:b] = NONE
                for p in range(0, len(where), ANCHORS):
                    part = slice(p, p + ANCHORS)
                    held = scores[where[part] // per]
                    held[(held < least[part, None]) | (held > most[part, None])] = NONE
                    row, found, score = leading(held, ids, k)
                    yield from best.add(block, where[part][row], found, score)
        yield from best.rest()

    return run


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score over vectors (vec_id, label, embedding).

    A component counts as floor(256 x); scores are inner products, higher first, equal ones by the smaller vec_id.
    Rows with a null id, label or vector or with a null or not finite component take no part, and vectors of different
    lengths are never scored together. Anchors are the rows that `anchor` (a condition on vec_id) picks. Each has as
    positives its first rows of its own label; the rows that bear its own id are none. For each positive the first rows
    of other labels with low x positive_score <= 100 x score <= high x positive_score are its negatives, ranked from 1;
    there are none where the positive's score is below zero. Repeated rows are rows of their own, so an id may come
    more than once among positives and negatives; anchors equal in id, label and vector are one. Scores beyond a long
    count as its ends. Other columns are ignored.
    """
    text_batches(vectors.sparkSession)
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    rows = rows.filter(usable(rows))
    candidates = stage(blocks(rows, block), "candidates")
    asked = stage(blocks(rows.filter(anchor).dropDuplicates(["vec_id", "label", "embedding"]), anchors), "anchors")

    def ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("block", "row").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = stage(ranked(_tiles(candidates, asked, []).mapInArrow(_positives(positives), FOUND), positives), "positives")
    listed = first.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "rank", "score"))).alias("bounds"))  # of the anchors of one block
    bounded = stage(asked.join(listed, "block"), "bounded")
    second = ranked(_tiles(candidates, bounded, ["bounds"]).mapInArrow(_negatives(negatives, positives, low, high), FOUND), negatives)
    second = second.select("block", F.floor(F.col("row") / positives).cast("int").alias("row"), (F.col("row") % positives + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = first.select("block", "row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = asked.select("block", "ids").mapInArrow(_named, "block string, row int, anchor_id long")
    out = second.join(pairs, ["block", "row", "place"]).join(named, ["block", "row"])
    out = stage(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(candidates, asked, first, bounded)
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held = np.frombuffer(ids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(held), pa.string()), pa.array(range(len(held)), pa.int32()), pa.array(held)], ["block", "row", "anchor_id"])
