"""Exact removal of repeated byte strings by a sparse enhanced suffix array.

Not every suffix is sorted. In every string of `least` bytes one k-gram is chosen by its hash alone, so equal strings
choose it at the same place; a suffix that starts at a chosen place is an anchor, one in about seventy bytes. Anchors
of equal k-grams are the suffixes that share a prefix, and whatever is repeated lies around two of them. Per k-gram:

* equal surroundings are taken together where they are read, so a passage in many texts is one suffix per batch;
* the other suffixes are sorted, with the lengths of their common prefixes between neighbours; a stack scan walks the
  intervals of that array (the common-prefix interval tree), and in each interval the bytes to the left are told apart:
  the longest common left extension of each member with any other gives repeats with all of their occurrences;
* from them each anchor gets the farthest bytes to its left and right that a repeat of `least` bytes covers.

A k-gram with more than `crowd` different surroundings is made longer first: a repeat of `least` bytes around it goes on
for half of what is missing to the right, or for the other half to the left, so its suffixes are dealt by the bytes there
on either side, again and again while a group is crowded; when nothing is missing a group has one string and needs no
array. Texts move once (equal ones are one), to be cut at their anchors and again at the spans found.

repeat_groups() gives the groups themselves, each with all of its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .jaccard import runs
from .workspace import discard, stage, text_batches

LEAST, GRAM, CROWD = 200, 64, 20_000
_U = np.uint64
PIECE = 1 << 19


def anchors(raw: np.ndarray, off: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-gram hash, document, place) of the anchors of a chunk of texts."""
    n, width = len(raw), least - gram + 1
    if n < least:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    if n > PIECE:  # one long text at most: pieces that overlap by a window
        parts = []
        for k in range(len(off) - 1):
            for a in range(off[k], max(off[k] + 1, off[k + 1] - least + 1), PIECE - least):
                b = min(off[k + 1], a + PIECE)
                h, _, p = anchors(raw[a:b], np.array([0, b - a]), least, gram)
                parts.append((h, np.full(len(h), k), p + a - off[k]))
        h, d, p = (np.concatenate(x) for x in zip(*parts))
        _, one = np.unique(d * (n + 1) + p, return_index=True)
        return h[one], d[one], p[one]
    c = X.prefix_hash(raw)
    at = np.arange(n - gram + 1)
    h = X.span_hash(c, at, at + gram)
    # the least hash of each window, the leftmost of equal ones: the place in the low bits
    packed = (h & ~_U(PIECE * 2 - 1)) | at.astype(np.uint64)
    m = -(-len(packed) // width) * width
    padded = np.full(m + width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    ahead = np.minimum.accumulate(padded.reshape(-1, width), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - least + 1)
    low = np.minimum(back[starts], ahead[starts + width - 1])
    doc = np.searchsorted(off, starts, "right") - 1
    inside = starts + least <= off[doc + 1]
    place, doc = (low[inside] & _U(PIECE * 2 - 1)).astype(np.int64), doc[inside]
    if not len(place):
        return np.zeros(0, np.uint64), place, place
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]
    return h[place[new]], doc[new], place[new] - off[doc[new]]


def common_prefix(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each pair of rows, at most `most`."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the common-prefix interval tree, by a stack scan.

    lcp[i] is the common prefix of suffixes i and i + 1 of the sorted array.
    """
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            yield length, first, i
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def extents(left: list[bytes], right: list[bytes], least: int = LEAST, listed: bool = True) -> tuple[np.ndarray, np.ndarray, list]:
    """For suffixes `right` with the bytes `left` before them: how far left and right of each a repeat reaches.

    A repeat is a string of at least `least` bytes around two of the suffixes' starts. The third result lists the
    groups: (bytes to the left, bytes to the right, members) of each repeat that no common byte extends; it is empty
    unless they are to be listed, since nested groups name each member as often as they are deep.
    """
    n = len(right)
    order = np.array(sorted(range(n), key=right.__getitem__))
    l_size, r_size = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    l_rows, r_rows = _matrix([x[::-1] for x in left]), _matrix(right)
    before = np.array(sorted(range(n), key=lambda k: left[k][::-1]))
    l_rank = np.empty(n, np.int64)
    l_rank[before] = np.arange(n)
    a, b = order[:-1], order[1:]
    lcp = common_prefix(r_rows[a], r_rows[b], np.minimum(r_size[a], r_size[b]))
    far_left, far_right, groups = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    for length, first, last in intervals(lcp):
        member = order[first : last + 1]
        member = member[np.argsort(l_rank[member])]
        a, b = member[:-1], member[1:]
        lcs = common_prefix(l_rows[a], l_rows[b], np.minimum(l_size[a], l_size[b]))
        if lcs.max() + length < least:
            continue
        best = np.maximum(np.r_[lcs, 0], np.r_[0, lcs])
        good = best + length >= least
        m = member[good]
        far_left[m] = np.maximum(far_left[m], best[good])
        far_right[m] = np.maximum(far_right[m], length)
        for reach, i, j in intervals(lcs) if listed else ():
            if reach + length >= least:
                groups.append((reach, length, member[i : j + 1].tolist()))
    return far_left, far_right, groups


def _matrix(rows: list[bytes]) -> np.ndarray:
    width = max(1, max(map(len, rows)))
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(len(rows), width)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id (null as the least long), text as bytes and the 128-bit key of the text."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    out = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("doc_id"), body.alias("text"))
    return out.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))


def _anchor_rows(rows: DataFrame, least: int, gram: int, remember: int = 500_000) -> DataFrame:
    """gram, k1, k2, place of the anchors of every text; a task gives those of equal texts once as long as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = []
            for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                if key not in seen:
                    if len(seen) >= remember:
                        seen.clear()
                    seen.add(key)
                    keep.append(i)
            batch = batch.take(pa.array(keep, pa.int64()))
            k1, k2 = k1[keep], k2[keep]
            raw, off = X.text_bytes(batch.column(2))
            for i, j in X.chunks(off, PIECE):
                h, d, p = anchors(raw[off[i] : off[j]], off[i : j + 1] - off[i], least, gram)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(k1[i + d]), pa.array(k2[i + d]), pa.array(p.astype(np.int32))], ["gram", "k1", "k2", "place"])

    return rows.select("k1", "k2", "text").mapInArrow(run, "gram long, k1 long, k2 long, place int")


SPAN = "k1 long, k2 long, first int, last int"


CONTEXTS = "gram long, k1 long, k2 long, place int, before int, around binary, to_left int, to_right int"


def _contexts(cut: DataFrame, least: int, gram: int, merge: bool = True) -> DataFrame:
    """Surroundings of each repeated anchor: gram, k1, k2, place, before (bytes to the left), around, to_left, to_right.

    The last two are the bytes to the left of the place and from it on that all suffixes of the gram have in common. With
    merge, of equal surroundings in a batch one is kept; all of them are covered whole, which rows without `around` say:
    place and before are then the first and last byte.
    """
    reach = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [x.split()[0] for x in CONTEXTS.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            groups: dict[tuple, list] = {}
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for x in batch.column(3)[i].as_py():
                    p = x["place"]
                    around = text[max(0, p - reach) : p + least]
                    groups.setdefault((x["gram"], min(p, reach), around) if merge else (x["gram"], min(p, reach), around, i, p), []).append((k1[i], k2[i], p))
            out = []
            for (g, before, around, *_), found in groups.items():
                where = set(found)
                a, b, p = found[0]
                out.append((g, a, b, p, before, around, 0, gram))
                if len(where) > 1:
                    out += [(a, a, b, p - before, p - before + len(around), None, 0, gram) for a, b, p in where]
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return cut.mapInArrow(run, CONTEXTS)


def _longer(contexts: DataFrame, least: int) -> DataFrame:
    """The suffixes with their gram made longer by half of what is missing, to the right and to the left."""
    missing = F.lit(least) - F.col("to_left") - F.col("to_right")
    right = F.ceil(missing / 2).cast("int")
    left = missing - right + 1
    at = F.col("before") + F.col("to_right")
    to_right = contexts.filter(at + right <= F.octet_length("around")).select(
        F.xxhash64("gram", F.lit(1), F.col("around").substr(at + 1, right)).alias("gram"), "k1", "k2", "place", "before", "around", "to_left", (F.col("to_right") + right).cast("int").alias("to_right")
    )
    to_left = contexts.filter(F.col("before") >= F.col("to_left") + left).select(
        F.xxhash64("gram", F.lit(2), F.col("around").substr(F.col("before") - F.col("to_left") - left + 1, left)).alias("gram"), "k1", "k2", "place", "before", "around", (F.col("to_left") + left).cast("int").alias("to_left"), "to_right"
    )
    return to_right.unionByName(to_left)


def _uncrowded(contexts: DataFrame, least: int, crowd: int) -> DataFrame:
    """The contexts with every gram made longer until no more than `crowd` suffixes share it, or nothing is missing."""
    done = None
    while True:
        open_ = F.col("to_left") + F.col("to_right") < least
        many = stage(contexts.filter(open_).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("gram"), "crowded")
        if many.isEmpty():
            return contexts if done is None else done.unionByName(contexts)
        # at most one k-gram in `crowd` suffixes: small wherever it is sent, and the suffixes are not shuffled to be told apart
        many = many.hint("broadcast")
        rest = contexts.filter(~open_).unionByName(contexts.filter(open_).join(many, "gram", "left_anti"))
        done = rest if done is None else done.unionByName(rest)
        contexts = stage(_longer(contexts.filter(open_).join(many, "gram", "left_semi"), least), "contexts")


def _chosen(text: bytes, place: int, least: int, gram: int) -> bool:
    """Whether a string chooses the place as an anchor by its own bytes, so that all of its occurrences do."""
    return place in anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), least, gram)[2]


def _solve(least: int, named: int = 0):
    """Spans around the suffixes of each k-gram; rows come sorted by k-gram.

    named, the length of the k-grams: instead the occurrences of each repeated string that chooses the anchor itself.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Where all suffixes of a group have the whole string in common."""
        now, first = None, {}
        for batch in batches:
            out = []
            for g, a, b, p, l, around, to_left, to_right in zip(*(c.to_pylist() for c in batch.columns)):
                if g != now:
                    now, first = g, {}
                text = around[l - to_left : l + to_right]
                if named and not _chosen(text, to_left, least, named):
                    continue
                row = (a, b, p - to_left, p + to_right, *([_name(text)] if named else []))
                if text not in first:
                    first[text] = row
                else:
                    if first[text] is not None:
                        out.append(first[text])
                        first[text] = None
                    out.append(row)
            yield out

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for group in runs(batches, ["gram"]):
            out: list[tuple] = []
            k1, k2, place, before, around = (group.column(c).to_pylist() for c in ("k1", "k2", "place", "before", "around"))
            merged: dict[tuple[int, bytes], set] = {}
            for a, b, p, l, text in zip(k1, k2, place, before, around):
                merged.setdefault((l, text), set()).add((a, b, p))
            distinct = list(merged)
            if len(distinct) > 1:
                far_left, far_right, groups = extents([t[:l] for l, t in distinct], [t[l:] for l, t in distinct], least, bool(named))
                far = list(zip(far_left.tolist(), far_right.tolist()))
            else:
                far, groups = [(0, 0)] * len(distinct), []
            if named:
                groups += [(l, len(t) - l, [i]) for i, (l, t) in enumerate(distinct) if len(merged[l, t]) > 1 and len(t) >= least]
                for reach, length, member in groups:
                    l, t = distinct[member[0]]
                    if not _chosen(t[l - reach : l + length], reach, least, named):
                        continue
                    name = _name(t[l - reach : l + length])
                    out += [(a, b, p - reach, p + length, name) for i in member for a, b, p in merged[distinct[i]]]
                yield out
                continue
            for (l, text), (reach, length) in zip(distinct, far):
                where = merged[l, text]
                if len(where) > 1:
                    reach, length = l, len(text) - l
                if length:
                    out += [(a, b, p - reach, p + length) for a, b, p in where]
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def split(batch: pa.RecordBatch, one: bool) -> pa.RecordBatch:
            full = batch.column(6).to_numpy() + batch.column(7).to_numpy() >= least
            return batch.filter(pa.array(full == one))

        # both kinds come in one stream; what is whole is looked at as it comes
        ended: list[pa.RecordBatch] = []

        def open_ones() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ended.append(split(batch, True))
                yield split(batch, False)

        ready = whole(iter(lambda: ended.pop(0), None))
        for out in arrays(open_ones()):
            held += out
            while ended:
                held += next(ready)
            if len(held) >= 20_000:
                yield _spans(held, bool(named))
                held = []
        while ended:
            held += next(ready)
        if held:
            yield _spans(held, bool(named))

    return run


def _name(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _spans(out: list[tuple], named: bool = False) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *([pa.int64()] if named else [])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["k1", "k2", "first", "last", *(["name"] if named else [])])


def _repeated_anchors(rows: DataFrame, keys: DataFrame | None, least: int, gram: int) -> DataFrame:
    """k1, k2, text and anchors (gram, place) of one row of each key (every row without keys) with k-grams that occur at several places."""
    found = _anchor_rows(rows, least, gram)
    name = F.xxhash64("k1", "k2", "place").alias("o")
    often = found.select("gram", name).groupBy("gram").agg(F.min("o").alias("a"), F.max("o").alias("b")).filter("a <> b").select("gram")
    # written before it is joined: the rows of a common k-gram can then be dealt to several tasks
    often = stage(often, "grams")
    cut = found.join(often.hint("merge"), "gram").groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", "place")).alias("anchors"))
    on = ["k1", "k2"]
    if keys is not None:
        cut, on = cut.join(keys.select(*on, F.col("rep").alias("doc_id")), on), ["doc_id", *on]
    return rows.join(cut, on).select("k1", "k2", "text", "anchors")


def repeated_spans(rows: DataFrame, keys: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """k1, k2, rep and spans (array of first, last; they may overlap) of each text with repeated bytes."""
    spark = rows.sparkSession
    text_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    contexts = stage(_contexts(_repeated_anchors(rows, keys, least, gram), least, gram), "contexts")
    dealt = _uncrowded(contexts.filter("around IS NOT NULL"), least, crowd).repartition(parts, "gram").sortWithinPartitions("gram")
    # what is covered whole is a span already: a k-gram may have any number of such copies, and no task holds them
    covered = contexts.filter("around IS NULL").select("k1", "k2", F.col("place").alias("first"), F.col("before").alias("last"))
    spans = dealt.mapInArrow(_solve(least), SPAN).unionByName(covered)
    spans = stage(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    discard(contexts)
    return spans.join(keys.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2"])


def repeat_groups(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """name, n_bytes, doc_id, row, first, last: each occurrence of each repeated string found, in every row of docs.

    The strings are those of the common-prefix interval trees: of `least` bytes or more around an anchor (at most
    `least` - `gram` bytes before it and `least` from it on) that several places have in common and no further byte within
    these bounds extends, and that choose the anchor by their own bytes. name is a 64-bit hash of the string; texts are UTF-8 bytes, a null one is empty. Every
    occurrence is listed, also in equal texts and repeated rows, which row, a number of the row of docs, tells apart.
    """
    spark = docs.sparkSession
    text_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # every row is a text of its own here, under a number that is written with it
    rows = stage(_rows(docs).withColumns({"k1": F.monotonically_increasing_id(), "k2": F.lit(0).cast("long")}), "rows")
    contexts = stage(_contexts(_repeated_anchors(rows, None, least, gram), least, gram, False), "contexts")
    dealt = _uncrowded(contexts, least, crowd).repartition(parts, "gram").sortWithinPartitions("gram")
    found = dealt.mapInArrow(_solve(least, gram), SPAN + ", name long").distinct()
    found = found.join(rows.select("doc_id", "k1"), "k1")
    return found.select("name", (F.col("last") - F.col("first")).alias("n_bytes"), F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), F.col("k1").alias("row"), "first", "last")


def merge_spans(spans: list, size: int) -> list[list[int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[list[int]] = []
    for first, last in sorted((x["first"], x["last"]) for x in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [[max(0, a), min(b, size)] for a, b in out]


def text_keys(rows: DataFrame) -> DataFrame:
    """k1, k2, rep (smallest doc_id) and copies of each distinct text; staged."""
    return stage(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "keys")


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text).

    Texts are UTF-8 bytes, a null one is empty. Each byte covered by a string of `least` bytes that starts anywhere
    else as well, in any row, is removed; a run of removed bytes is one span. Rows with equal texts, repeated rows
    among them, are occurrences of each other. Extra columns are ignored.
    """
    rows = _rows(docs)
    keys = text_keys(rows)
    marked = repeated_spans(rows, keys, least, gram, crowd)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                spans = merge_spans(batch.column(3)[i].as_py(), len(text))
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string()]))], ["k1", "k2", "n_removed", "n_spans", "kept_sha256"])

    found = rows.join(marked, ["doc_id", "k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(cut, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["k1", "k2"])
    whole = rows.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = whole.join(keys.select("k1", "k2", "copies"), ["k1", "k2"]).join(found, ["k1", "k2"], "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    return out.select(
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def whole_characters(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """The spans without bytes of characters that are not in them whole."""

    def inside(k: int) -> bool:
        return k < len(text) and text[k] & 0xC0 == 0x80

    out = []
    for a, b in spans:
        while a < b and inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        if a < b:
            out.append([a, b])
    return out


def cut_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """docs with the repeated bytes (see remove_repeats) taken out of text, whole characters only, and n_chars, if there, set.

    A null text stays null. Rows of equal texts of `least` bytes or more lose all of theirs.
    """
    rows = _rows(docs)
    keys = text_keys(rows)
    marked = repeated_spans(rows, keys, least, gram, crowd)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    own = [prefix + x for x in ("id", "k1", "k2", "spans")]
    keyed = docs.withColumns(dict(zip(own, (id_, F.xxhash64(body), F.xxhash64(F.lit(1), body)))))
    gone = rows.select("doc_id", "k1", "k2").distinct().join(keys.filter("copies > 1").select("k1", "k2"), ["k1", "k2"]).withColumn("spans", F.array(F.struct(F.lit(0).alias("first"), F.lit((1 << 31) - 1).alias("last"))))
    single = marked.join(keys.filter("copies = 1").select("k1", "k2"), ["k1", "k2"]).select("k1", "k2", "doc_id", "spans")
    marks = single.unionByName(gone.select("k1", "k2", "doc_id", "spans")).select("doc_id", "k1", "k2", "spans").toDF(*own)
    joined = keyed.join(marks.hint("merge"), own[:3], "left").select(*docs.columns, own[3])
    chars = "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            columns = dict(zip(names, batch.columns))
            texts = columns["text"].to_pylist()
            for i, spans in enumerate(batch.column(len(names))):
                if spans.is_valid and texts[i] is not None:
                    raw = texts[i].encode()
                    found = spans.as_py()
                    if len(found) == 1 and found[0]["last"] == (1 << 31) - 1 and len(raw) < least:
                        continue
                    kept, at = [], 0
                    for a, b in whole_characters(raw, merge_spans(found, len(raw))):
                        kept.append(raw[at:a])
                        at = b
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            columns["text"] = pa.array(texts, pa.string())
            if chars:
                columns["n_chars"] = pa.array([x if t is None else len(t) for t, x in zip(texts, columns["n_chars"].to_pylist())], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return joined.mapInArrow(cut, docs.schema)
