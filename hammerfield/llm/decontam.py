"""Benchmark decontamination by the CGK random walk.

Texts become sequences of words (runs of letters, digits and bytes beyond ASCII, lower-cased). The CGK embedding walks
a sequence with shared random bits: at step j it writes the word it stands on and moves on if the word's j-th bit is
set. Sequences a few edits apart fall back into step after each edit, so their embeddings agree at most steps: edit
distance becomes Hamming distance. Each repetition samples M steps; a window of a document whose sampled words equal
those of a window of an item is a candidate. The number of repetitions, and how rarely the embeddings of a candidate
may agree, are what simulated edits need to reach the target recall in every class of items of about equal length. Items
of a class that misses it are found by their pieces instead: cut into one piece more than the edits allowed, an item has
a piece that no edit touches, so these are all found. An exact edit distance decides about the candidates of both kinds.

Items are taken by length: windows are as long as the shortest item of a length class (at most WINDOW words), and longer
items are covered by several windows. Every word of every document starts one walk, which serves all classes. Documents never move: the items are a stated query set, sent in blocks of a
bounded number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .workspace import text_batches

SIMILARITY, TARGET, LEAST_WORDS = 0.8, 0.95, 5
WINDOW, M, MAX_REPEATS, SEED = 24, 3, 24, 11
COPIES, COPY_WORDS = 400, 400
BLOCK_BYTES = 4 << 20
_U = np.uint64
_M = _U(0x9FB21C651E98DF25)

#: Bytes that end a word: ASCII other than letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower-cased for A-Z and the capitals of Latin-1, and its document."""
    low = X.LOWER[raw]
    capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1 if len(low) else []
    low[capital] += 0x20
    s, e, doc = X.words(raw, off, NOT_WORD)
    return X.block_hash(low, s, e), doc


def walk(words: np.ndarray, start: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """The word written at each step by walks from the given starts; words must reach steps beyond each of them."""
    at = start.copy()
    again = words
    for j in range(steps):
        if j and not j % 48:
            again = X.mix(again + _U(j))
        x = words[at]
        yield x
        at += ((again[at] if again is not words else x) >> _U(8 + j % 48) & _U(1)).astype(np.int64)


@dataclass
class Windows:
    """Windows of the items of a length class, hashed for each repetition."""

    steps: int
    samples: np.ndarray  # repeats x M steps
    keys: list[np.ndarray]  # for each repeat the sorted keys
    part_of: list[np.ndarray]  # and the windows they are of
    hit: list[np.ndarray]  # and which top 16 bits occur
    embedding: np.ndarray  # windows x steps
    owner: np.ndarray  # item of each window
    offset: np.ndarray  # and its first word there
    least: np.ndarray  # agreeing steps that a candidate of each window needs


@dataclass
class Index:
    """A block of items."""

    item_ids: list
    items: list[np.ndarray]  # word hashes
    windows: list[Windows]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by words: sorted keys, their items and first words, top 16 bits
    recall: dict[int, float]  # of the items of so many edits, up to the next number, and windows; simulated, or 1 by pieces

    @property
    def steps(self) -> int:
        return max((w.steps for w in self.windows), default=2 * WINDOW)


def _keys(written: list[np.ndarray] | np.ndarray, sample: np.ndarray) -> np.ndarray:
    h = np.zeros(len(written[0]), np.uint64)
    for j in sample:
        h = h * _M + written[j]
    return X.mix(h)


def _embed(items: list[np.ndarray], starts: list[np.ndarray], steps: int) -> np.ndarray:
    """Embeddings (walks x steps) of sequences from several starts each."""
    gap = np.zeros(steps + 1, np.uint64)
    flat = np.concatenate([x for item in items for x in (item, gap)] or [gap])
    base = np.cumsum([0] + [len(x) + steps + 1 for x in items])
    at = np.concatenate([b + s for b, s in zip(base, starts)] or [np.zeros(0)]).astype(np.int64)
    return np.stack(list(walk(flat, at, steps)), 1)


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = list(item)
    for _ in range(edits):
        k, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if k == 0 and out:
            out[at] = rng.integers(1 << 62)
        elif k == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, rng.integers(1 << 62))
    return np.array(out, np.uint64)


def edits_allowed(words: int, similarity: float) -> int:
    return int((1 - similarity) * words + 1e-9)


def _places(words: int, size: int) -> np.ndarray:
    return np.unique(np.append(np.arange(0, words - size + 1, size), words - size))


def _classes(items: list[np.ndarray], similarity: float) -> dict[int, list[int]]:
    """The items by the edits allowed: each number to 12, then ranges of an eighth, then all of over COPY_WORDS words."""
    top = max(1, edits_allowed(COPY_WORDS, similarity))
    held: dict[int, list[int]] = {}
    for i, w in enumerate(items):
        e = min(top, max(1, edits_allowed(len(w), similarity)))
        if 12 < e < top:
            e = int(12 * 1.125 ** int(np.log(e / 12) / np.log(1.125) + 1e-9))
        held.setdefault(e, []).append(i)
    return dict(sorted(held.items()))


def _agreement(items: list[np.ndarray], size: int, steps: int, samples: np.ndarray, similarity: float, rng: np.random.Generator) -> np.ndarray:
    """Most agreeing steps of a candidate of each simulated copy after each repeat (copies x repeats), -1 without one.

    All items are cut to the length of the shortest (COPY_WORDS at most): as many edits in fewer words and windows than
    the others have. Other words follow each copy, as they do in a document.
    """
    words = min(COPY_WORDS, min(len(w) for w in items))
    most, places = max(1, edits_allowed(words, similarity)), _places(words, size)
    pick = [items[k][:words] for k in rng.integers(len(items), size=COPIES)]
    copies = [edited(w, most, rng) for w in pick]
    flat = np.concatenate([x for c in copies for x in (c, rng.integers(1 << 62, size=steps + 1).astype(np.uint64))])
    base = np.cumsum([0] + [len(c) + steps + 1 for c in copies])[:-1]
    of = np.repeat(np.arange(COPIES), [len(c) for c in copies])
    near = list(walk(flat, np.concatenate([b + np.arange(len(c)) for b, c in zip(base, copies)]), steps))
    own = list(_embed(pick, [places] * COPIES, steps).T)
    own_of = np.repeat(np.arange(COPIES), len(places))
    best, out = np.full(COPIES, -1), []
    for s in samples:
        # a copy meets its own item alone
        h, g = (X.mix(_keys(x, s) + o.astype(np.uint64) * _M) for x, o in ((near, of), (own, own_of)))
        order = np.argsort(g)
        lo, hi = np.searchsorted(g[order], h, "left"), np.searchsorted(g[order], h, "right")
        at, part = _spread(np.flatnonzero(hi > lo), lo, hi, order)
        np.maximum.at(best, of[at], sum((x[at] == y[part]).astype(np.int64) for x, y in zip(near, own)))
        out.append(best.copy())
    return np.stack(out, 1)


def _spread(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of at with each of its entries lo..hi."""
    more = hi[at] - lo[at]
    pick = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more - lo[at], more)
    return np.repeat(at, more), entries[pick]


def _pieces(items: list[np.ndarray], which: list[int], similarity: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    held: dict[int, list[tuple[int, int, int]]] = {}
    for i in which:
        w, n = items[i].tolist(), len(items[i])
        parts = min(n, edits_allowed(n, similarity) + 1)
        for k in range(parts):
            a, b = k * n // parts, (k + 1) * n // parts
            h = 0
            for x in w[a:b]:
                h = (h * int(_M) + x) & 0xFFFFFFFFFFFFFFFF
            held.setdefault(b - a, []).append((h, i, a))
    out = {}
    for size, rows in held.items():
        key = X.mix(np.array([h for h, _, _ in rows], np.uint64))
        order = np.argsort(key, kind="stable")
        top = np.zeros(1 << 16, bool)
        top[key >> _U(48)] = True
        out[size] = key[order], np.array([i for _, i, _ in rows])[order], np.array([a for _, _, a in rows])[order], top
    return out


def build(item_ids: list, texts: pa.Array, similarity: float = SIMILARITY, target: float = TARGET) -> Index | None:
    """Index of items; those of fewer than LEAST_WORDS words have no window. None if no item has one."""
    raw, off = X.text_bytes(texts)
    words, doc = word_hashes(raw, off)
    cut = np.searchsorted(doc, np.arange(len(off)))
    found = [(i, words[cut[k] : cut[k + 1]]) for k, i in enumerate(item_ids) if cut[k + 1] - cut[k] >= LEAST_WORDS]
    if not found:
        return None
    ids, items = [i for i, _ in found], [w for _, w in found]
    rng = np.random.default_rng(SEED)
    windows, pieced, recall = [], [], {}
    # from LEAST_WORDS words, each class to half as many again, then all of WINDOW words or more
    bounds = [LEAST_WORDS]
    while bounds[-1] < WINDOW:
        bounds.append(min(WINDOW, bounds[-1] * 3 // 2))
    for low, high in zip(bounds, [*bounds[1:], 1 << 60]):
        own = [i for i, w in enumerate(items) if low <= len(w) < high]
        if own:
            made, missed, reached = _windows(items, own, similarity, target, rng)
            windows += [made] if len(made.owner) else []
            pieced += missed
            recall |= {e: min(r, recall.get(e, 1.0)) for e, r in reached.items()}
    return Index(ids, items, windows, _pieces(items, pieced, similarity), recall)


def _windows(items: list[np.ndarray], own: list[int], similarity: float, target: float, rng: np.random.Generator) -> tuple[Windows, list[int], dict[int, float]]:
    """Windows of the items of a length class, the items left to pieces, and the recall by edits allowed."""
    size = min(WINDOW, *(len(items[i]) for i in own), WINDOW)
    steps = 2 * size
    samples = np.stack([np.sort(rng.choice(steps - 2, M, replace=False)) for _ in range(MAX_REPEATS)])
    classes = {e: [own[k] for k in which] for e, which in _classes([items[i] for i in own], similarity).items()}

    # What as many edits as the limit allows leave, class by class; two standard errors for so many copies.
    safe = target + 2 * (target * (1 - target) / COPIES) ** 0.5
    repeats, least, recall, walked, pieced, reached = 0, np.zeros(len(items), np.int64), {}, [], [], {}
    for e, which in classes.items():
        agree = _agreement([items[i] for i in which], size, steps, samples, similarity, rng)
        reach = (agree >= 0).mean(axis=0)
        if reach[-1] >= safe:
            reached[e] = agree
            repeats = max(repeats, int(np.argmax(reach >= safe)) + 1)
            walked += which
        else:
            pieced += which
            recall[e] = 1.0
    for e, agree in reached.items():
        last = agree[:, repeats - 1]
        least[classes[e]] = last[last >= 0].min()  # costs no copy that was met
        recall[e] = float((last >= 0).mean())
    samples = samples[:repeats]

    walked = np.array(sorted(walked), np.int64)
    places = [_places(len(items[i]), size) for i in walked]
    embedding = _embed([items[i] for i in walked], places, steps)
    keys, part_of, hit = [], [], []
    for s in samples:
        h = _keys(list(embedding.T), s)
        order = np.argsort(h, kind="stable")
        keys.append(h[order])
        part_of.append(order)
        top = np.zeros(1 << 16, bool)
        top[h >> _U(48)] = True
        hit.append(top)
    owner = np.repeat(walked, [len(p) for p in places])
    offset = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
    return Windows(steps, samples, keys, part_of, hit, embedding, owner, offset, least[owner]), pieced, recall


def distance(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and the end of the first such stretch.

    Bit-parallel by columns; the bits of a Python integer hold a pattern of any length.
    """
    n = len(pattern)
    mask: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        mask[w] = mask.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text.tolist(), 1):
        eq = mask.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(x | up) & full
        minus = up & x
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = plus << 1 & full, minus << 1 & full
        y = eq | down
        up = (minus | ~(y | plus)) & full
        down = plus & y
        if score < best:
            best, end = score, j
    return best, end


def search(index: Index, words: np.ndarray, doc: np.ndarray, n_docs: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """(document, item, distance, last word) of the best stretch of each document for each item it holds."""
    if not len(words):
        return []
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    padded = np.zeros(len(words) + n_docs * (index.steps + 1) + max(index.pieces, default=0), np.uint64)
    place = np.arange(len(words)) + doc * (index.steps + 1)
    padded[place] = words
    near: set[tuple[int, int, int]] = set()

    def add(at: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> None:
        # starts that name the same place of the same item within a window are one
        begin = at - first[doc[at]] - offset
        near.update(zip(doc[at].tolist(), owner.tolist(), (begin // index.steps).tolist()))

    for k in range(0, len(words), 1 << 15):
        start = place[k : k + (1 << 15)]
        h = np.zeros(len(start), np.uint64)
        for n in range(1, max(index.pieces, default=0) + 1):
            h = h * _M + padded[start + (n - 1)]
            if n in index.pieces:
                keys, owner, offset, top = index.pieces[n]
                x = X.mix(h)
                at = np.flatnonzero(top[x >> _U(48)])
                lo, hi = np.searchsorted(keys, x[at], "left"), np.searchsorted(keys, x[at], "right")
                of, part = _spread(np.flatnonzero(hi > lo), lo, hi, np.arange(len(keys)))
                add(at[of] + k, owner[part], offset[part])
        written = list(walk(padded, start, index.steps)) if index.windows else []
        for part_ in index.windows:
            pairs = []
            for r, sample in enumerate(part_.samples):
                h = _keys(written, sample)
                at = np.flatnonzero(part_.hit[r][h >> _U(48)])
                lo, hi = np.searchsorted(part_.keys[r], h[at], "left"), np.searchsorted(part_.keys[r], h[at], "right")
                of, part = _spread(np.flatnonzero(hi > lo), lo, hi, part_.part_of[r])
                if len(of):
                    pairs.append(at[of] * len(part_.owner) + part)
            if not pairs:
                continue
            at, part = np.divmod(np.unique(np.concatenate(pairs)), len(part_.owner))
            agree = np.zeros(len(at), np.int64)
            for j, x in enumerate(written[: part_.steps]):
                agree += x[at] == part_.embedding[part, j]
            good = agree >= part_.least[part]
            add(at[good] + k, part_.owner[part[good]], part_.offset[part[good]])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    distinct = {item: set(index.items[item].tolist()) for item in {x[1] for x in near}}
    for d, item, bucket in near:
        pattern = index.items[item]
        most = edits_allowed(len(pattern), similarity)
        lo = max(0, bucket * index.steps - most)
        hi = min(int(count[d]), (bucket + 1) * index.steps + len(pattern) + most)
        stretch = words[first[d] + lo : first[d] + hi]
        if len(distinct[item].difference(stretch.tolist())) > most:  # each word that is not there costs an edit
            continue
        got, end = distance(pattern, stretch)
        if got <= most and (got, lo + end) < best.get((d, item), (1 << 60, 0)):
            best[d, item] = (got, lo + end)
    return [(d, item, got, end) for (d, item), (got, end) in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, distance int, similarity double, last_word long"


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """The items (item_id, text) in blocks of about block_bytes of text, one block on the driver at a time."""
    items = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        held = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        if held.num_rows:
            yield held.column("item_id").to_pylist(), held.column("text")


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, target: float = TARGET, key: str = "doc_id") -> DataFrame:
    """doc_id, item_id, distance, similarity and last_word: a row for each document row and item found in it.

    An item is found where some stretch of the document is within (1 - similarity) x its words of it by edit distance
    in words; distance is the least, last_word the number of words up to the end of the first such stretch. Null or
    empty texts hold nothing; items of fewer than LEAST_WORDS words are never found; equal items are each reported;
    repeated rows of docs each give their own rows. Other columns are ignored. key names the column that stands for a
    row in place of doc_id; it keeps its name and, unless it is doc_id, its type.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(docs[key].cast("long").alias(key) if key == "doc_id" else docs[key], "text")
    schema = SCHEMA.replace("doc_id long", f"{key} {rows.schema[key].dataType.simpleString()}")
    names = [x.split()[0] for x in schema.split(", ")]
    out = None
    for ids, texts in item_blocks(items):
        index = build(ids, texts, similarity, target)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)  # a block of items of BLOCK_BYTES at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                raw, off = X.text_bytes(batch.column(1))
                doc_ids, rows = batch.column(0).to_pylist(), []
                for i, j in X.chunks(off):
                    words, doc = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                    for d, item, got, end in search(index, words, doc, j - i, similarity):
                        rows.append((doc_ids[i + d], index.item_ids[item], got, 1 - got / len(index.items[item]), end))
                if rows:
                    cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.schema.types[0], pa.int64(), pa.int32(), pa.float64(), pa.int64()])], names)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
