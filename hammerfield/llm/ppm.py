"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to ORDER with the counts of what follows them in the training documents. A
symbol is coded in its longest known context; where it has not been seen there, an escape is coded (method C: as many
escapes as distinct symbols) and the next shorter context tried, without the symbols already excluded. Below the empty
context all 257 symbols (bytes and the end) are equally likely. A document's score is the sum of the base-10 logarithms.

What is coded is the token sequence: words with A-Z lower-cased, each ended by a space, the last by the end symbol.
That is also what the unigram base scores, so the two are probabilities of the same thing.

Nothing of the model passes through the driver. Counts of contexts and words are added up on the executors and written
once: the dictionary. It is cut into parts, contexts by their last two bytes (a branch of over PART_EDGES by the third
as well), words by hash. Each block of documents asks each part once for the distinct contexts and words it has there,
the parts answer with log-probabilities, and the answers go back to their blocks, where the documents are added up. The
documents are read once for the counts, once for the questions and once for the sums, however large the trie is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .workspace import discard, stage, text_batches

ORDER, PART_EDGES, BLOCK_BYTES, HELD_KEYS = 5, 400_000, 16 << 20, 1_000_000
END, SYMBOLS = 256, 257
END_WORD = np.uint64(0xE5D)
_U = np.uint64
#: Keys of the dictionary: contexts are positive, words negative; counts of two-byte contexts of a branch that is cut carry CUT.
_WORD, CUT = np.int64(-(1 << 63)), 1 << 60


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, document of each): the words of each text, each ended by a space, the last by END; END alone without words."""
    n_docs = len(off) - 1
    s, e, doc = X.words(raw, off)
    count = np.bincount(doc, minlength=n_docs)
    bare = np.flatnonzero(count == 0)
    size = e - s + 1
    stop = np.cumsum(size)
    source = np.arange(int(size.sum())) + np.repeat(s - stop + size, size)
    low = np.append(X.LOWER[raw], np.uint8(32)).astype(np.uint16)
    out = low[np.minimum(source, len(raw))]
    out[stop - 1] = 32
    last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) if len(doc) else doc
    out[stop[last] - 1] = END
    of = np.repeat(doc, size)
    if len(bare):
        at = np.searchsorted(of, bare)
        out, of = np.insert(out, at, END), np.insert(of, at, bare)
    return out, of


def codes(sym: np.ndarray, doc: np.ndarray, order: int) -> np.ndarray:
    """Context and symbol of each position: the context's bytes, oldest first (0 before the start), then 9 bits of symbol."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else doc
    ctx = np.zeros(len(sym), np.uint64)
    wide = sym.astype(np.uint64)
    for j in range(order, 0, -1):
        x = np.zeros(len(sym), np.uint64)
        x[j:] = wide[:-j]
        for k in range(j):  # the first j positions of a document look back before its start
            hit = first + k
            hit = hit[hit < len(sym)]
            x[hit[doc[hit] == doc[first[: len(hit)]]]] = 0
        ctx = ctx << _U(8) | x
    return ctx << _U(9) | wide


class Trie:
    """A part of the trie, ready for look-ups; built from the counts of (longest context, symbol) codes.

    low: counts of (1-byte context, symbol) codes of the whole corpus, from which the shortest contexts come; middle:
    those of (2-byte context, symbol) codes where the part has not all of them.
    """

    def __init__(self, code: np.ndarray, count: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int = ORDER, middle: tuple[np.ndarray, np.ndarray] | None = None):
        self.order, self.edges, self.nodes = order, [], []
        for k in range(order + 1):
            source, times = low if k < 2 else middle if k == 2 and middle is not None else (code, count)
            keep = k
            short = source & _U((1 << (8 * keep + 9)) - 1)
            edge, at = np.unique(short, return_inverse=True)
            n = np.bincount(at, times, minlength=len(edge))
            node, of = np.unique(edge >> _U(9), return_inverse=True)
            total, kinds = np.bincount(of, n, minlength=len(node)), np.bincount(of, minlength=len(node))
            self.edges.append({"code": edge, "n": n, "of": of})
            self.nodes.append({"ctx": node, "total": total, "kinds": kinds})
        # log10 of: a symbol in its first context, of the escape from it; and after an escape from a longer context,
        # what divides a count in this node's parent and the escape from the parent
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, (e, v) in enumerate(zip(self.edges, self.nodes)):
                e["first"] = np.log10(e["n"] / (v["total"] + v["kinds"])[e["of"]])
                v["escape"] = np.log10(v["kinds"] / (v["total"] + v["kinds"]))
                if k:
                    up = self.edges[k - 1]
                    mask = _U((1 << (8 * (k - 1))) - 1)
                    parent = np.searchsorted(self.nodes[k - 1]["ctx"], v["ctx"] & mask)
                    shared = up["n"][np.searchsorted(up["code"], ((e["code"] >> _U(9)) & mask) << _U(9) | e["code"] & _U(511))]
                    seen = np.bincount(e["of"], shared, minlength=len(v["ctx"]))
                    left = self.nodes[k - 1]["total"][parent] - seen
                    kinds = self.nodes[k - 1]["kinds"][parent] - v["kinds"]
                    v["above"] = np.log10(np.maximum(left + kinds, 1))
                    v["onward"] = np.where(kinds > 0, np.log10(np.maximum(kinds, 1)) - v["above"], 0.0)
        spare = SYMBOLS - (self.nodes[0]["kinds"][0] if len(self.nodes[0]["kinds"]) else 0)
        self.rest = -np.log10(max(1, spare))
        self._hash()
        # what look-ups do not need: the longest edges are in the hash table alone
        self.edges[-1] = None
        for e in self.edges[:-1]:
            e["log"] = np.log10(e["n"]).astype(np.float32)
            e["first"] = e["first"].astype(np.float32)
            del e["of"], e["n"]
        for v in self.nodes:
            for x in ("escape", "above", "onward"):
                if x in v:
                    v[x] = v[x].astype(np.float32)
            del v["total"], v["kinds"]

    def _hash(self) -> None:
        """Open addressing of the longest edges: nearly every position is answered by one probe or two."""
        code, value = self.edges[-1]["code"], self.edges[-1]["first"].astype(np.float32)
        self.bits = max(4, int(1.5 * len(code) + 1).bit_length())
        self.key = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.value = np.zeros(1 << self.bits, np.float32)
        slot, todo = self._slot(code), np.arange(len(code))
        while len(todo):
            free = self.key[slot[todo]] == np.iinfo(np.uint64).max
            place, take = np.unique(slot[todo[free]], return_index=True)
            got = todo[free][take]
            self.key[place], self.value[place] = code[got], value[got]
            todo = np.setdiff1d(todo, got, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Log-probability of each position."""
        out = np.zeros(len(code))
        slot = self._slot(code)
        key = self.key[slot]
        hit = key == code
        out[hit] = self.value[slot[hit]]
        miss = []
        todo = np.flatnonzero(~hit)
        todo, gone = todo[key[todo] != np.iinfo(np.uint64).max], todo[key[todo] == np.iinfo(np.uint64).max]
        miss.append(gone)
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            key = self.key[slot]
            hit = key == code[todo]
            out[todo[hit]] = self.value[slot[hit]]
            empty = key == np.iinfo(np.uint64).max
            miss.append(todo[empty])
            more = ~hit & ~empty
            todo, slot = todo[more], slot[more]
        rest = np.concatenate(miss)
        out[rest] = self._escaped(code[rest])
        return out

    def _escaped(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code))
        child = np.full(len(code), -1)  # the node of the next longer context, where it is known
        todo = np.arange(len(code))
        for k in range(self.order, -1, -1):
            e, v = self.edges[k], self.nodes[k]
            if not len(todo) or not len(v["ctx"]):
                continue
            short = code[todo] & _U((1 << (8 * k + 9)) - 1)
            longer = self.nodes[k + 1] if k < self.order else None
            entered = child[todo] >= 0
            node = np.minimum(np.searchsorted(v["ctx"], short >> _U(9)), len(v["ctx"]) - 1)
            known = v["ctx"][node] == short >> _U(9)
            if e is None:  # not in the hash table, so not among the longest edges
                at = found = np.zeros(len(todo), bool)
            else:
                at = np.minimum(np.searchsorted(e["code"], short), len(e["code"]) - 1)
                found = e["code"][at] == short
            after = found & entered
            if longer is not None:
                if after.any():
                    out[todo[after]] += e["log"][at[after]].astype(np.float64) - longer["above"][child[todo[after]]]
                on = ~found & entered
                out[todo[on]] += longer["onward"][child[todo[on]]]
            new = found & ~entered
            if new.any():
                out[todo[new]] += e["first"][at[new]]
            fresh = ~found & ~entered & known
            out[todo[fresh]] += v["escape"][node[fresh]]
            child[todo] = np.where(known, node, -1)
            todo = todo[~found]
        out[todo] += self.rest
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(5) == 1, F.lit(False))


def distinct(key: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; by sorting, which is faster here than hashing."""
    key = np.sort(key)
    return key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key


class Lookup:
    """Values of keys by open addressing in a small table; every key asked for must be there."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(2 * len(key)).bit_length())
        self.key, self.value = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits)
        used = np.zeros(1 << self.bits, bool)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[~used[slot[todo]]]
            self.key[slot[free]] = key[free]  # of several for one slot the last stays
            used[slot[free]] = True
            placed = self.key[slot[todo]] == key[todo]
            self.value[slot[todo[placed]]] = value[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        todo = np.flatnonzero(self.key[slot] != key)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            todo = todo[self.key[slot[todo]] != key[todo]]
        return self.value[slot]


def word_keys(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and document of each token: the words and one end for each document."""
    h, doc = X.word_hashes(raw, off)
    n = len(off) - 1
    return np.r_[h, np.full(n, END_WORD)].astype(np.int64) | _WORD, np.r_[doc, np.arange(n)]


def _keys(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the positions and the document of each, keys of the tokens and the document of each."""
    sym, doc = symbols(raw, off)
    return codes(sym, doc, order).astype(np.int64), doc, *word_keys(raw, off)


def dictionary(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """key and n over the training rows (train, text), added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key = np.concatenate([c for c, _ in held])
            order = np.argsort(key)
            key, n = key[order], np.concatenate([n for _, n in held])[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            return key[start], np.add.reduceat(n, start) if len(start) else n

        def send(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 200_000]), pa.array(n[k : k + 200_000])], ["key", "n"])

        for batch in batches:
            batch = batch.filter(batch.column(0))
            raw, off = X.text_bytes(batch.column(1))
            for i, j in X.chunks(off):
                code, _, word, _ = _keys(raw[off[i] : off[j]], off[i : j + 1] - off[i], order)
                held.append(np.unique(np.r_[code, word], return_counts=True))
                if sum(len(k) for k, _ in held) > 2 * HELD_KEYS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_KEYS:
                        yield from send(*held.pop())
        if held:
            yield from send(*merged())

    return rows.select("train", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Layout:
    """Which part of the dictionary a key is in; a few arrays of 65,536 numbers, whatever the input."""

    def __init__(self, branch: np.ndarray, edges: np.ndarray, words: int, most: int):
        size = np.zeros(1 << 16, np.int64)
        size[branch] = edges
        # branches in order, as many to a part as fit; a larger one has parts of its own, by the third byte
        self.cut = np.where(size > most, np.minimum(256, -(-size // most)), 1).astype(np.int32)
        alone = self.cut > 1
        fill = np.cumsum(np.where(alone, 0, size)) // most
        step = np.r_[False, (fill[1:] != fill[:-1]) | alone[1:] | alone[:-1]]
        self.first = np.cumsum(np.where(step, np.r_[1, self.cut[:-1]], 0)).astype(np.int32)
        self.tries = int(self.first[-1] + self.cut[-1])
        self.words = max(1, -(-words // most))

    def part(self, key: np.ndarray) -> np.ndarray:
        branch = (key >> 9) & 0xFFFF
        code = self.first[branch] + ((key >> 25) & 0xFF) % self.cut[branch]
        return np.where(key < 0, self.tries + (key >> 8 & 0xFFFFFF) % self.words, code).astype(np.int32)

    @property
    def parts(self) -> int:
        return self.tries + self.words


def packed(key: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, the first bytes of all together: most of them are zero."""
    return np.diff(key, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _in_order(key: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by part and value, the parts there are, and where each starts."""
    key = distinct(key)
    part = layout.part(key)
    order = np.argsort(part, kind="stable")
    part = part[order]
    start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return key[order], part[start], start


ASK = "part int, block long, key long, n long, keys binary"


def questions(dealt: DataFrame, layout: Layout, order: int) -> DataFrame:
    """The distinct keys of each block of documents (block, text), a row for each part they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            block = batch.column(0).to_numpy()
            for now in np.unique(block).tolist():
                raw, off = X.text_bytes(batch.column(1).filter(pa.array(block == now)))
                for i, j in X.chunks(off):
                    code, _, word, _ = _keys(raw[off[i] : off[j]], off[i : j + 1] - off[i], order)
                    found = held.setdefault(now, [])
                    found.append(distinct(np.r_[code, word]))
                    if len(found) >= 12:
                        held[now] = [distinct(np.concatenate(found))]
        for now in list(held):
            key, part, start = _in_order(np.concatenate(held.pop(now)), layout)
            stop = np.r_[start[1:], len(key)]
            zero = np.zeros(len(part), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(zero + now), pa.array(zero), pa.array(zero), pa.array([packed(key[a:b]) for a, b in zip(start, stop)], pa.binary())], [x.split()[0] for x in ASK.split(", ")])

    return dealt.select("block", "text").mapInArrow(run, ASK)


def answers(told: DataFrame, asked: DataFrame, layout: Layout, low: tuple[np.ndarray, np.ndarray], order: int) -> DataFrame:
    """block, part and values (doubles for words, else floats) for each row of questions().

    told: the dictionary (key, n). A part is in memory once, and the questions of all blocks pass by it.
    """
    spark = told.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part, middle = layout.part(key), np.zeros(0, np.int64)
            at = np.flatnonzero((key >= 0) & (layout.cut[(key >> 9) & 0xFFFF] > 1))
            if len(at):  # each part of a branch that is cut gets the branch's counts
                short, of = np.unique(key[at] & ((1 << 25) - 1), return_inverse=True)
                times = layout.cut[(short >> 9) & 0xFFFF]
                middle = np.repeat(short, times)
                sub = np.arange(len(middle)) - np.repeat(np.cumsum(times) - times, times)
                part = np.r_[part, layout.first[(middle >> 9) & 0xFFFF] + sub].astype(np.int32)
                n = np.r_[n, np.repeat(np.bincount(of, n[at]).astype(np.int64), times)]
            key = np.r_[key, middle | CUT]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(key), -1)), pa.array(key), pa.array(n), pa.nulls(len(key), pa.binary())], [x.split()[0] for x in ASK.split(", ")])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told_, look_up = None, [], None
        for batch in batches:
            part, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | ((block[1:] < 0) != (block[:-1] < 0))) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if part[a] != now:
                    now, told_, look_up = int(part[a]), [], None
                if block[a] < 0:
                    told_.append((batch.column(2).to_numpy()[a:b], batch.column(3).to_numpy()[a:b]))
                    continue
                if look_up is None:
                    key, n = (np.concatenate(x) for x in zip(*told_)) if told_ else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    look_up, told_ = (_words if now >= layout.tries else _contexts)(key, n, low, order), []
                values = [look_up(unpacked(x.as_py())).tobytes() for x in batch.column(4)[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(block[a:b]), pa.array(part[a:b]), pa.array(values, pa.binary())], ["block", "part", "values"])

    rows = told.select("key", "n").mapInArrow(deal, ASK).unionByName(asked)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), layout.parts)
    return rows.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(reply, "block long, part int, values binary")


def _words(key: np.ndarray, n: np.ndarray, low, order):
    """log10(count + 0.5) of words."""
    sort = np.argsort(key)
    key, n = np.r_[key[sort], np.iinfo(np.int64).max], np.r_[n[sort], 0]

    def look_up(asked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(key, asked)
        return np.log10(np.where(key[at] == asked, n[at], 0) + 0.5)

    return look_up


def _contexts(key: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int):
    """Log-probabilities of symbols in their contexts."""
    cut = key >= CUT
    middle = None
    if cut.any():
        code, of = np.unique(key[cut] ^ CUT, return_inverse=True)
        middle = code.astype(np.uint64), np.bincount(of, n[cut])
    trie = Trie(key[~cut].astype(np.uint64), n[~cut], low, order, middle)
    return lambda asked: trie.log10(asked.astype(np.uint64)).astype(np.float32)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(layout: Layout, order: int):
    """Sums of a block of documents from the answers to its questions."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, off = X.text_bytes(left.column("text").combine_chunks())
        held = []  # each chunk's rows and distinct keys
        for i, j in X.chunks(off):
            code, doc, word, of = _keys(raw[off[i] : off[j]], off[i : j + 1] - off[i], order)
            held.append((i, j, distinct(np.r_[code, word])))
        key, part, start = _in_order(np.concatenate([k for _, _, k in held] or [np.zeros(0, np.int64)]), layout)
        got = dict(zip(right.column("part").to_pylist(), right.column("values")))
        value = np.concatenate([np.frombuffer(got[p].as_py(), np.float64 if p >= layout.tries else np.float32) for p in part.tolist()] or [np.zeros(0)])
        sort = np.argsort(key)
        key, value = key[sort], value[sort].astype(np.float64)
        tokens, known, base, score = (np.zeros(len(off) - 1) for _ in range(4))
        for i, j, own in held:
            code, doc, word, of = _keys(raw[off[i] : off[j]], off[i : j + 1] - off[i], order)
            found = Lookup(own, value[np.searchsorted(key, own)])
            score[i:j] = np.bincount(doc, found[code], minlength=j - i)
            v = found[word]
            tokens[i:j] = np.bincount(of, minlength=j - i)
            known[i:j] = np.bincount(of, v > 0, minlength=j - i)  # log10(1.5) at least
            base[i:j] = np.bincount(of, v, minlength=j - i)
        return pa.table({"doc_id": left.column("doc_id"), "train": left.column("train"), "n_tokens": tokens.astype(np.int64), "n_known": known.astype(np.int64), "base": base, "score": score})

    return run


def score_documents(docs: DataFrame, order: int = ORDER, part_edges: int = PART_EDGES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    Both models learn from the rows that are not held out. A null or blank text is its end alone. Repeated rows are
    kept, and count again in training. A null id is not held out. With nothing to learn from, every token is unknown
    and every symbol equally likely. Extra columns are ignored. order: 2 at least. Rows are dealt into blocks by a hash
    of id and text, so only rows equal in both are sure to meet in one task.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))
    told = stage(dictionary(rows, order), "dictionary")

    contexts = told.filter("key >= 0")
    branch = F.shiftright("key", 9).bitwiseAND(F.lit(0xFFFF)).cast("int")
    sizes = contexts.groupBy(branch.alias("branch")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # 65,536 rows at most
    low = contexts.groupBy(F.col("key").bitwiseAND(F.lit((1 << 17) - 1)).alias("code")).agg(F.sum("n").alias("n")).toArrow()  # 65,792 rows at most
    low = low.column("code").to_numpy().astype(np.uint64), low.column("n").to_numpy()
    train_tokens, kinds = told.filter("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    layout = Layout(sizes.column("branch").to_numpy(), sizes.column("n").to_numpy(), kinds, part_edges)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).repartition(n_blocks, "block")
    got = stage(answers(told, questions(dealt, layout, order), layout, low, order), "answers")
    discard(told)
    both = dealt.select("block", "train", "text", "doc_id").groupBy("block").cogroup(got.groupBy("block"))
    out = both.applyInArrow(_scorer(layout, order), "doc_id long, train boolean, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + 0.5 * (kinds + 1))))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(train_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
