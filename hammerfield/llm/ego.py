"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are rotated to their principal axes, found from sums over all of them; distances stay as they are. The
leading axes are cut into cells of the join distance, and vectors are sorted by cell, axis after axis. Consecutive
stretches of that order are written as blocks with the box they fill. Blocks whose boxes lie within the join distance
meet, one pair of blocks a task unit, and are halved again and again: pairs of intervals whose boxes are too far apart
are skipped, and small ones are compared in full.

Equal vectors are one, with a count. A pair of blocks gives one row for each vector with partners (how many, and the
smallest vector of its component in the pair), never a row for each pair of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, roots
from .jaccard import runs
from .workspace import stage

AXES, BLOCK, LEAF = 6, 1024, 64


def valid_vectors(vectors: DataFrame) -> Column:
    """Rows with a label and a vector of finite components that is not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)


def _unit(arr: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths as unit vectors, in double precision."""
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in which the vectors have one length."""
    lengths = pc.list_value_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n))


def principal_axes(vectors: DataFrame, axes: int) -> dict[int, np.ndarray]:
    """For each length of vector the matrix (length x axes) of its leading axes.

    Each task adds up its products; the sum has length x length numbers whatever the input.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in _by_length(batch, "embedding"):
                if part.num_rows:
                    x = _unit(part.column(0))
                    total[x.shape[1]] = total.get(x.shape[1], 0) + np.r_[x.T @ x, x.sum(axis=0)[None], np.full((1, x.shape[1]), len(x))]
        for n, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(m), pa.int64()), pa.array(range(len(m)), pa.int64()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["length", "row", "sums"])

    rows = vectors.select("embedding").mapInArrow(products, "length long, row long, sums array<double>")
    summed = rows.select("length", "row", F.posexplode("sums")).groupBy("length", "row", "pos").agg(F.sum("col").alias("s")).toArrow()
    out = {}
    frame = summed.to_pandas()
    for n, g in frame.groupby("length"):
        m = np.zeros((n + 2, n))
        m[g["row"].to_numpy(), g["pos"].to_numpy()] = g["s"].to_numpy()
        mean = m[n] / m[n + 1, 0]
        _, basis = np.linalg.eigh(m[:n] / m[n + 1, 0] - np.outer(mean, mean))
        out[int(n)] = np.ascontiguousarray(basis[:, ::-1][:, :axes])
    return out


def _blocks(axes: dict[int, np.ndarray], reach: float, block: int):
    """Blocks of sorted vectors: label, length, box and packed rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["label", "length"]):
            table = group.combine_chunks()
            label, length = table.column("label")[0].as_py(), table.column("length")[0].as_py()
            for k in range(0, table.num_rows, block):
                part = table.slice(k, block)
                x = _unit(part.column("embedding").combine_chunks())
                y = x @ axes[length]
                yield pa.RecordBatch.from_arrays([
                    pa.array([label], pa.int32()), pa.array([length], pa.int32()), pa.array([part.column("rep").to_numpy().min()], pa.int64()),
                    pa.array([y.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([y.max(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([part.column("rep").to_numpy().astype("<i8").tobytes()]), pa.array([part.column("n").to_numpy().astype("<i8").tobytes()]), pa.array([x.tobytes()]),
                ], ["label", "length", "block", "low", "high", "reps", "counts", "rows"])

    return make


def apart(low_a, high_a, low_b, high_b) -> float:
    """Least squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float((gap * gap).sum())


def join_blocks(x: np.ndarray, y: np.ndarray, basis: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into x and y) of vectors with that cosine or more; with same, y is x and each pair comes once.

    Intervals of the two sequences are halved down to LEAF vectors; boxes beyond the join distance are skipped, with a
    margin for rounding.
    """
    limit = 2 - 2 * cosine + 1e-9
    px, py = x @ basis, y @ basis
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if apart(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0)) > limit:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        m, k = (a + b) // 2, (c + d) // 2
        lefts = [(a, m), (m, b)] if b - a > LEAF else [(a, b)]
        rights = [(c, k), (k, d)] if d - c > LEAF else [(c, d)]
        todo += [(p, q, r, s) for p, q in lefts for r, s in rights if not same or s > p]


def link_vectors(vectors: DataFrame, cosine: float = 0.98, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Two rows link when their labels are equal and not null and their cosine, in double precision, is at least the
    given one. A null, zero or not finite vector, one with a null component, and an empty one link with nothing; such
    a row is its own component. Vectors of different lengths never link. Repeated rows are rows of their own: each
    counts the others. component_id is the smallest vec_id of the component; a row without vec_id is never it unless
    all of its copies lack one, and its component is then null. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("int").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    good = rows.filter(valid_vectors(rows))
    key = [F.xxhash64("embedding", "label").alias("h1"), F.xxhash64("label", "embedding", F.lit(1)).alias("h2")]
    reps = good.select("vec_id", "label", "embedding", *key).groupBy("h1", "h2", "label").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    # one name for each distinct vector, whatever the ids are
    reps = stage(reps.select("h1", "h2", "label", "rep", "n", F.size("embedding").alias("length"), "embedding"), "vectors")
    named = reps.filter("rep IS NOT NULL")
    basis = principal_axes(reps, axes)
    if not basis:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    reach = float(np.sqrt(2 - 2 * cosine))
    shared = spark.sparkContext.broadcast(basis)  # a matrix of length x axes for each length

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch, "embedding"):
                if part.num_rows:
                    length = part.column(2)[0].as_py()
                    cell = np.floor(_unit(part.column(4)) @ shared.value[length] / reach).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.tolist(), pa.list_(pa.int32()))], ["rep", "label", "length", "n", "embedding", "cell"])

    ordered = named.select("rep", "label", "length", "n", "embedding").mapInArrow(cells, "rep long, label int, length int, n long, embedding array<double>, cell array<int>")
    order = ["label", "length", "cell", "rep"]
    ordered = ordered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    box = "label int, length int, block long, low array<double>, high array<double>, reps binary, counts binary, rows binary"
    blocks = stage(ordered.mapInArrow(_blocks(basis, reach, block), box), "blocks")

    # Pairs of blocks: those that share a pair of cells on the first two axes, the second block's box widened by the
    # join distance; a pair that shares several is taken at the first of them.
    def cell_range(low: Column, high: Column, axis: int) -> Column:
        return F.sequence(F.floor(low[axis] / reach).cast("int"), F.floor(high[axis] / reach).cast("int"))

    boxes = blocks.select("label", "length", "block", "low", "high")
    a = boxes.withColumn("c1", F.explode(cell_range(F.col("low"), F.col("high"), 0)))
    grown_low, grown_high = F.transform("low", lambda v: v - F.lit(reach + 1e-6)), F.transform("high", lambda v: v + F.lit(reach + 1e-6))
    b = boxes.select("label", "length", F.col("block").alias("block_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(cell_range(grown_low, grown_high, 0)).alias("c1"))
    if axes > 1 and max(m.shape[0] for m in basis.values()) > 1:
        a = a.withColumn("c2", F.explode(cell_range(F.col("low"), F.col("high"), 1)))
        b = b.withColumn("c2", F.explode(cell_range(F.transform("low_b", lambda v: v - F.lit(reach + 1e-6)), F.transform("high_b", lambda v: v + F.lit(reach + 1e-6)), 1)))
        on = ["label", "length", "c1", "c2"]
    else:
        on = ["label", "length", "c1"]
    gaps = F.zip_with(F.zip_with("low", "high_b", lambda p, q: p - q), F.zip_with("low_b", "high", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= F.lit(reach * reach + 1e-6)
    pairs = a.join(b, on).filter("block <= block_b").filter(near).select("label", "length", "block", "block_b").distinct()

    left = blocks.select("label", "length", "block", "reps", "counts", "rows")
    right = left.select("label", "length", F.col("block").alias("block_b"), F.col("reps").alias("reps_b"), F.col("counts").alias("counts_b"), F.col("rows").alias("rows_b"))
    met = pairs.join(left, ["label", "length", "block"]).join(right, ["label", "length", "block_b"]).select("length", "block", "block_b", "reps", "counts", "rows", "reps_b", "counts_b", "rows_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                length, p, q, reps_a, counts_a, rows_a, reps_b, counts_b, rows_b = (c[k].as_py() for c in batch.columns)
                ra, rb = np.frombuffer(reps_a, "<i8"), np.frombuffer(reps_b, "<i8")
                na, nb = np.frombuffer(counts_a, "<i8"), np.frombuffer(counts_b, "<i8")
                x, y = np.frombuffer(rows_a).reshape(len(ra), length), np.frombuffer(rows_b).reshape(len(rb), length)
                same = p == q
                ids = ra if same else np.r_[ra, rb]
                weight = np.zeros(len(ids), np.int64)
                root = np.arange(len(ids))
                shift = 0 if same else len(ra)
                us, vs = [], []
                for i, j in join_blocks(x, y, shared.value[length], cosine, same):
                    np.add.at(weight, i, nb[j])
                    np.add.at(weight, j + shift, na[i])
                    node, low = roots(i, j + shift)
                    us.append(node)
                    vs.append(low)
                if us:
                    node, low = roots(np.concatenate(us), np.concatenate(vs))
                    # the smallest id of each component
                    least = np.full(len(ids), np.iinfo(np.int64).max)
                    np.minimum.at(least, low, ids[node])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[node]), pa.array(weight[node]), pa.array(least[low])], ["rep", "links", "root"])

    found = stage(met.mapInArrow(compare, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    solved = named.select("h1", "h2", "label", "rep", "n").join(links, "rep", "left").join(joined, "rep", "left")
    solved = solved.select("h1", "h2", "label", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    nameless = reps.filter("rep IS NULL").select("h1", "h2", "label", (F.col("n") - 1).alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    solved = solved.unionByName(nameless)

    # written first, so that a vector that many rows share can be dealt to several tasks; rows without a vector stay apart
    solved = stage(solved, "solved")
    out = good.select("vec_id", "label", *key).join(solved.hint("merge"), ["h1", "h2", "label"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(valid_vectors(rows), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
