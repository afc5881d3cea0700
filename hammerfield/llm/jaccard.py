"""Jaccard join of shingle sets: documents linked when their sets are similar enough, as connected components.

1. Sets. A document's set is its distinct k-word shingles; equal sets are one set, named by a hash of its shingles.
2. Index lists. Shingles are ordered by hash. Of its first ones in that order, as many as may differ and DEPTH per cent
   more are posted for each set; of the first ones of the set that ends earlier, all but those that may differ are among
   the first ones of the other. So a set of which fewer than that are in other sets too, as where only a passage is
   shared, has no partner. The others are searched by the rarest of their shared shingles: all but one less than a
   partner must have in common with them.
3. Families. Sets that meet in a list are joined into families (components of the candidate graph), so a set's shingles
   are sent to one place whatever its number of lists.
4. Answers, in a family. A first set's answers are read from position-blocked lists of its rarest shingles, skipping
   the blocks whose positions or sizes leave too little in common. A set in those answers derives its own from them:
   Jaccard distance is a metric, so its partners are within (1 - threshold) more of the first set than it is; those
   already in its component are skipped.

Only names and hashes move in steps 2 and 3; a list of many sets is dealt by set, and a list or component is handled as
a minimum and its members, never as a group. Texts move once, to meet their families. A family of over FAMILY shingles
is dealt into pieces, each pair of pieces a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .components import connected_components
from .workspace import discard, stage, text_batches

FAMILY = 1_500_000
#: Per cent of a set that is searched beyond what may differ: more of it costs postings and leaves fewer candidates.
DEPTH = 15
#: Kinds of postings; sets of a batch that make a shingle common; its place in the order of rarity.
PLAIN, COMMON, IN_COMMON, HOT, HELD = 0, 1, 2, 16, (1 << 31) - 1
_U = np.uint64


def allowance(n, num: int, den: int):
    """Shingles that a set of size n may have outside a similar set."""
    return n - -(-n * num // den)


def depth(n):
    """Shingles that two similar sets have in common, at least, among the first ones of each; n: size of the smaller set."""
    return np.maximum(1, n * DEPTH // 100)


def demand(n, num: int, den: int):
    """depth() for the smallest partner that a set of size n may have."""
    return depth(-(-n * num // den))


def set_names(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and name of each document's set; h sorted and distinct in each document."""
    size = np.bincount(doc, minlength=n_docs)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(X.mix(h), out=c[1:])
    end = np.cumsum(size)
    return size, X.mix(c[end] - c[end - size] + size.astype(np.uint64)).astype(np.int64)


def ranks(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles of each set as ranks by rarity in all of them, sorted within each set; and the number of ranks."""
    order = np.argsort(flat).astype(np.int32)
    new = np.ones(len(flat), bool)
    held = flat[order]
    np.not_equal(held[1:], held[:-1], out=new[1:])
    del held
    which = np.cumsum(new, dtype=np.int32) - np.int32(1)
    times = np.bincount(which)
    rank = np.empty(len(times), np.int32)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times), dtype=np.int32)
    out = np.empty(len(flat), np.int32)
    out[order] = rank[which]
    at = 0
    for n in size.tolist():
        out[at : at + n].sort()
        at += n
    return out, len(times)


def answers(flat: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set, the first set (by position) of its component under Jaccard >= num/den.

    flat holds the sets one after another, each distinct; size their lengths.
    """
    n = len(size)
    root = np.arange(n)
    cut = np.r_[0, np.cumsum(size)]
    if n == 2:
        both = len(np.intersect1d(flat[: cut[1]], flat[cut[1] :], assume_unique=True))
        return np.array([0, 0 if den * both >= num * (size.sum() - both) else 1])

    # the first shingles of a set are in few others
    ranked, n_ranks = ranks(flat, size)
    sets = [ranked[cut[k] : cut[k + 1]] for k in range(n)]

    # Lists of the prefixes for the wider threshold 2 t - 1, within which a first set's answers are kept.
    wide = max(0, 2 * num - den)
    prefix = np.minimum(size, size - -(-size * wide // den) + 1)
    inside = np.arange(len(ranked)) - np.repeat(cut[:-1], size) < np.repeat(prefix, size)
    token, owner = ranked[inside], np.repeat(np.arange(n), prefix)
    position = np.concatenate([np.arange(p) for p in prefix])
    sort = np.lexsort((position, token))
    token, owner, position = token[sort], owner[sort], position[sort]
    start = np.searchsorted(token, np.arange(n_ranks + 1))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def join(a: int, b: int) -> None:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    mark = np.zeros(n_ranks, bool)

    def common(k: int, others: np.ndarray) -> np.ndarray:
        mark[sets[k]] = True
        picked = np.concatenate([sets[z] for z in others])
        out = np.add.reduceat(mark[picked].astype(np.int64), np.r_[0, np.cumsum(size[others])[:-1]])
        mark[sets[k]] = False
        return out

    covered = np.zeros(n, bool)
    known: list[tuple[int, np.ndarray, np.ndarray]] = []
    for x in range(n):
        if covered[x]:
            continue
        found = []
        for i, t in enumerate(sets[x][: prefix[x]]):
            a, b = start[t], start[t + 1]
            if b - a < 2:
                continue
            # a list is in order of position: what lies beyond the last useful position is skipped as a block
            last = np.searchsorted(position[a:b], size.max() * (den - wide) // den + 1, "right")
            z, p = owner[a : a + last], position[a : a + last]
            rest = 1 + np.minimum(size[x] - i - 1, size[z] - p - 1)
            found.append(z[(den + wide) * (rest + np.minimum(i, p)) >= wide * (size[x] + size[z])])
        z = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        z = z[(z != x) & (den * np.minimum(size[x], size[z]) >= wide * np.maximum(size[x], size[z]))]
        covered[x] = True
        if not len(z):
            continue
        both = common(x, z)
        either = size[x] + size[z] - both
        near = den * both >= num * either
        for y in z[near].tolist():
            join(x, y)
        fresh = z[near & ~covered[z]]
        covered[fresh] = True
        kept = den * both >= wide * either
        if len(fresh):
            known.append((x, fresh, np.stack([z[kept], both[kept], either[kept]])))
    for x, members, (z, both, either) in known:
        apart = 1 - both / either
        roots = np.array([find(k) for k in z.tolist()])
        if (roots == find(x)).all():
            continue
        for y in members.tolist():
            own = find(y)
            open_ = np.array([find(k) for k in z.tolist()]) != own
            y_apart = apart[np.flatnonzero(z == y)[0]]
            c = z[open_ & (apart <= y_apart + (den - num) / den + 1e-9)]
            if len(c):
                b = common(y, c)
                for k in c[den * b >= num * (size[y] + size[c] - b)].tolist():
                    join(y, k)
    return np.array([find(k) for k in range(n)])


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows of equal key as a table each; the input is sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _sets(text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, off = X.text_bytes(text)
    for i, j in X.chunks(off):
        h, doc = X.shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
        yield i, j, h, doc


def members(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row, n_shingles and set (its name; null for an empty set) of each row (doc_id, text, row), staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, name = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, h, doc in _sets(batch.column(1), k):
                size[i:j], name[i:j] = set_names(h, doc, j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(name, mask=size == 0)], ["doc_id", "row", "n_shingles", "set"])

    return stage(docs.select("doc_id", "text", "row").mapInArrow(run, "doc_id long, row string, n_shingles long, set long"), "members")


def post(docs: DataFrame, k: int, num: int, den: int, hot: int = HOT) -> DataFrame:
    """Postings (code, set) of the first shingles in hash order of each set.

    code: 62 bits of the shingle and a kind. A shingle of `hot` sets of a batch or more is common: its sets (IN_COMMON)
    need not meet anywhere, one row (COMMON) tells the others. Else PLAIN.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sets = [], []
            for i, j, h, doc in _sets(batch.column(1), k):
                size, name = set_names(h, doc, j - i)
                once = np.zeros(j - i, bool)
                once[np.unique(name, return_index=True)[1]] = True
                first = np.cumsum(size) - size
                keep = (np.arange(len(h)) - first[doc] < (allowance(size, num, den) + depth(size))[doc]) & once[doc]
                codes.append((h[keep] & ~_U(3)).astype(np.int64))
                sets.append(name[doc[keep]])
            if not sum(map(len, codes)):
                continue
            code, of = np.concatenate(codes), np.concatenate(sets)
            order = np.argsort(code, kind="stable")
            code, of = code[order], of[order]
            new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            times = np.diff(np.r_[new, len(code)])
            common = times >= hot
            code = np.r_[code + np.repeat(common, times) * IN_COMMON, code[new[common]] + COMMON]
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.r_[of, of[new[common]]])], ["code", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "code long, set long")


def shared(postings: DataFrame) -> DataFrame:
    """set, place and shingle of the postings whose shingle several sets have; place: how many, HELD for a common one."""
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(code: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        """Whole lists, sorted by code and set."""
        kind, shingle = code & 3, code & ~3
        told = np.unique(shingle[kind == COMMON])
        mine = kind == IN_COMMON
        plain = kind == PLAIN
        a, b = shingle[plain], of[plain]
        one = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        a, b = a[one], b[one]
        new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
        times = np.diff(np.r_[new, len(a)])
        place = np.repeat(np.where(np.isin(a[new], told), HELD, np.minimum(times, HELD - 1)), times)
        several = place > 1
        cols = [np.r_[b[several], of[mine]], np.r_[place[several], np.full(mine.sum(), HELD)].astype(np.int32), np.r_[a[several], shingle[mine]]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["set", "place", "shingle"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_code, held_set = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            code, of = np.r_[held_code, batch.column(0).to_numpy()], np.r_[held_set, batch.column(1).to_numpy()]
            # the last list may go on
            cut = int(np.searchsorted(code, code[-1] & ~3))
            held_code, held_set = code[cut:], of[cut:]
            if cut:
                yield rows(code[:cut], of[:cut])
        if len(held_code):
            yield rows(held_code, held_set)

    code = F.col("code")
    key = F.when(code.bitwiseAND(F.lit(3)) == IN_COMMON, F.col("set")).otherwise(code.bitwiseAND(F.lit(~3)))
    dealt = postings.repartition(parts, key).sortWithinPartitions("code", "set")
    return dealt.mapInArrow(run, "set long, place int, shingle long")


def stars(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, least set of each, distinct edges from the other sets to the least)."""
    order = np.lexsort((of, key))
    key, of = key[order], of[order]
    new = np.r_[True, key[1:] != key[:-1]]
    least = of[new][np.cumsum(new) - 1]
    edge = of != least
    return key[new], of[new], np.unique(np.stack([of[edge], least[edge]], 1), axis=0)


def candidates(found: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (u, v) between sets that have one of their rarest shared shingles in common, each list as a star.

    found: rows of shared(). A set with fewer shared shingles among its first ones than any partner would have with it
    has no partner. Of the others, all but one less than that number are searched, the rarest first.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (k, u, null) of the least set of each list of a batch, and edges (any k, u, v)."""
        for group in whole_runs(batches):
            of, place, shingle = (group.column(c).to_numpy() for c in range(3))
            one = np.r_[True, (of[1:] != of[:-1]) | (place[1:] != place[:-1]) | (shingle[1:] != shingle[:-1])]
            of, place, shingle = of[one], place[one], shingle[one]
            first = np.flatnonzero(place < 0)
            times = np.diff(np.r_[first, len(of)])
            most = np.maximum(times - demand(shingle[first], num, den), 0)
            at = np.arange(len(of)) - np.repeat(first, times)
            keep = (at > 0) & (at <= np.repeat(most, times))
            if not keep.any():
                continue
            key, least, edge = stars(shingle[keep], of[keep])
            k, u = np.r_[key, edge[:, 0]], np.r_[least, edge[:, 0]]
            v, none = np.r_[np.zeros(len(key), np.int64), edge[:, 1]], np.r_[np.ones(len(key), bool), np.zeros(len(edge), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(u), pa.array(v, mask=none)], ["k", "u", "v"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stars of the lists; rows come sorted by list and set, edges are passed on."""
        key = least = None
        for batch in batches:
            if not batch.num_rows:
                continue
            is_edge = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            a, b = batch.column(0).to_numpy()[~is_edge], batch.column(1).to_numpy()[~is_edge]
            u, v = batch.column(1).to_numpy()[is_edge], batch.column(2).fill_null(0).to_numpy()[is_edge]
            if len(a):
                new = np.r_[a[0] != key, a[1:] != a[:-1]]
                first = np.r_[least if not new[0] else b[0], b[new]] if not new[0] else b[new]
                low = first[np.cumsum(new) - (1 if new[0] else 0)]
                key, least = a[-1], low[-1]
                edge = b != low
                u, v = np.r_[u, b[edge]], np.r_[v, low[edge]]
            if len(u):
                pair = np.unique(np.stack([u, v], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["u", "v"])

    # the size of each set comes before its shingles
    sized = found.select("set", "place", "shingle").unionByName(sets.select("set", F.lit(-1).alias("place"), F.col("n").alias("shingle")))
    posted = sized.repartition(parts, "set").sortWithinPartitions("set", "place", "shingle")
    posted = posted.mapInArrow(search, "k long, u long, v long").repartition(parts, "k").sortWithinPartitions("k", "u")
    return posted.mapInArrow(link, "u long, v long").distinct()


def whole_runs(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The rows in tables of about so many that leave rows of equal first column together; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            of = batch.column(0).to_numpy()
            cut = int(np.searchsorted(of, of[-1]))
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks()
                held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def row_key(docs: DataFrame) -> Column:
    """A hash of the id and the text of a row, of 128 bits: an equal one decides which rows stay."""
    text = F.when(docs["text"].isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), docs["text"]))
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")), text).cast("binary"))


def similar_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, family: int = FAMILY, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text); linked when Jaccard >= num / den.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer than k words is one shingle;
    a null or blank text has the empty set, links with nothing and is its own component. component_id is the smallest
    doc_id of the component; null ids are never it unless there is no other. Repeated rows are kept. Extra columns are
    ignored. More columns: row, the row_key() of the row; leads, true for one row of each component (with the smallest
    id, the rows equal to it included) and for every row without words.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", row_key(docs).alias("row"))
    member = members(rows, k)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("first")
    sets = member.filter("set IS NOT NULL").groupBy("set").agg(first, F.max("n_shingles").alias("n"))
    sets = stage(sets.select("set", "n", F.col("first.doc_id").alias("least"), F.col("first.row").alias("chosen")), "sets")
    found = stage(shared(post(rows, k, num, den, hot)), "shared")
    edges = stage(candidates(found, sets, num, den), "candidates")
    discard(found)
    families = stage(connected_components(edges).select(F.col("node").alias("set"), F.col("component").alias("family")), "families")
    discard(edges)

    # The text of one row of each set that has a family.
    chosen = stage(sets.join(families, "set"), "chosen")
    weight = chosen.groupBy("family").agg(F.sum("n").alias("weight")).filter(F.col("weight") > family)
    weight = stage(weight.select("family", F.ceil(F.col("weight") * 2 / F.lit(family)).cast("int").alias("pieces")), "weights")
    large = not weight.isEmpty()
    pieces = F.coalesce("pieces", F.lit(1))
    own = F.pmod(F.xxhash64("set"), pieces).cast("int")
    split = F.when(pieces > 1, F.transform(F.sequence(F.lit(0), pieces - 1), lambda p: F.least(p, own) * pieces + F.greatest(p, own))).otherwise(F.array(F.lit(0)))
    chosen = chosen.join(weight, "family", "left").select("set", "family", "chosen", split.alias("split"))
    # joined by sorting at every size: the sets chosen grow with the input, and a plan that sends them to all tasks
    # while they are few says nothing about larger inputs
    texts = rows.select(F.col("row").alias("chosen"), "text").join(chosen.hint("merge"), "chosen")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """set, family, split and shingles; rows whose key is another set's as well are left out."""
        for batch in batches:
            wanted, family_of, split_of = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for i, j, h, doc in _sets(batch.column(3), k):
                size, name = set_names(h, doc, j - i)
                end = np.cumsum(size)
                keep = np.flatnonzero(name == wanted[i:j])
                if not len(keep):
                    continue
                lists = pa.array([h[end[x] - size[x] : end[x]].astype(np.int64) for x in keep], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(family_of[i:j][keep]), pa.array([split_of[i + x] for x in keep], pa.list_(pa.int32())), lists], ["set", "family", "split", "shingles"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["family", "split"]):
            names, first = np.unique(group.column("set").to_numpy(), return_index=True)
            if len(names) < 2:
                continue
            held = group.column("shingles").take(pa.array(first)).combine_chunks()
            held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
            del group
            root = answers(held.flatten().to_numpy(), np.diff(held.offsets.to_numpy()), num, den)
            moved = root != np.arange(len(names))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["u", "v"])

    solved = texts.select("set", "family", "split", "text").mapInArrow(shingled, "set long, family long, split array<int>, shingles array<long>")
    solved = solved.withColumn("split", F.explode("split")).repartition(parts, "family", "split").sortWithinPartitions("family", "split")
    links = stage(solved.mapInArrow(solve, "u long, v long"), "links")
    discard(families, weight)
    if large:
        roots_ = stage(connected_components(links).select(F.col("node").alias("set"), "component"), "roots")
        discard(links)
    else:
        roots_ = links.select(F.col("u").alias("set"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("set"), F.col("v").alias("component")).distinct())

    # The least id of each component, by sets; rows meet it by the name of their set. Tables that are joined are written
    # first, so that a name which many rows share can be dealt to several tasks.
    named = stage(sets.join(roots_, "set", "left").select("set", "least", "chosen", F.coalesce("component", "set").alias("component")), "named")
    least = named.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("x"), "least", "set")).alias("first"))
    least = stage(least.select("component", F.col("first.least").alias("component_id"), F.col("first.set").alias("leader")), "least")
    led = named.join(least.hint("merge"), "component").select("set", "component_id", F.when(F.col("leader") == F.col("set"), F.col("chosen")).alias("leads"))
    led = stage(led, "led")
    discard(sets, named, least)
    joined = member.join(led.hint("merge"), "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "row", F.coalesce(F.col("leads") == F.col("row"), F.col("set").isNull()).alias("leads"))
