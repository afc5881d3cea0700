"""Ranked lexical search by the Best Position Algorithm.

Scores are sums over a query's terms of whole numbers (impacts): a weight of the term, by the documents that hold it,
times a part that grows with its occurrences and falls with the length of the document.

1. A pass over the texts keeps, for each document that holds a term of the queries, its length and those terms with
   their occurrences; sums over all documents give the weights. Texts are read once.
2. Documents stay where they are, in shards of bounded size. In a shard each term has an impact list: its documents by
   falling impact, and where each document stands in it. A query reads its lists side by side. Every document met is
   looked up in the other lists (direct access), which tells its whole score and also its positions there. The best
   position of a list is the end of its unbroken run of seen positions, at least the last one read and often far beyond.
   What no list has shown scores no more than the sum of the impacts at the best positions; once that sum is below the
   k-th score found, strictly, since an equal score can win by its id, the shard is done.
3. The best of each shard meet by query; k rows a query and shard are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .decontam import NOT_WORD, item_blocks
from .workspace import stage, text_batches

K = 20
#: Postings of a shard; a document is never split.
SHARD = 2_000_000
#: Rows read from each list before the first look at the threshold; doubled up to MOST_ROWS.
ROWS, MOST_ROWS = 16, 1024


@dataclass
class Terms:
    """Distinct terms of a block of queries, by hash, and the terms of each query with how often it has them."""

    key: np.ndarray  # uint64, sorted
    check: np.ndarray  # a second hash of each
    queries: list[tuple[np.ndarray, np.ndarray]]


def term_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end of each term of a chunk of texts, and the texts with A-Z lower-cased."""
    low = X.LOWER[raw]
    s, e, doc = X.words(raw, off, NOT_WORD)
    return X.block_hash(low, s, e), doc, s, e, low


def terms_of(texts: pa.Array) -> Terms:
    raw, off = X.text_bytes(texts)
    key, doc, s, e, low = term_hashes(raw, off)
    one, first, which = np.unique(key, return_index=True, return_inverse=True)
    cut = np.searchsorted(doc, np.arange(len(off)))
    queries = [np.unique(which[a:b], return_counts=True) for a, b in zip(cut, cut[1:])]
    return Terms(one, X.block_hash(low, s[first], e[first], 1 << 32), queries)


def count_terms(terms: Terms, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; text, term and occurrences of each term of the queries in it, in that order."""
    key, doc, s, e, low = term_hashes(raw, off)
    size = np.bincount(doc, minlength=len(off) - 1)
    if not len(key) or not len(terms.key):
        z = np.zeros(0, np.int64)
        return size, z, z, z
    at = np.minimum(np.searchsorted(terms.key, key), len(terms.key) - 1)
    held = np.flatnonzero(terms.key[at] == key)
    held = held[X.block_hash(low, s[held], e[held], 1 << 32) == terms.check[at[held]]]
    pair, tf = np.unique(doc[held] * np.int64(len(terms.key)) + at[held], return_counts=True)
    return size, pair // len(terms.key), pair % len(terms.key), tf


class Shard:
    """Impact lists of a shard: documents by falling impact, and each document's place, for every term."""

    def __init__(self, n_docs: int, n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        keep = impact > 0
        doc, term, impact = doc[keep], term[keep], impact[keep]
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        # the documents of each list in ascending order, and their places in it
        by_doc = np.lexsort((self.doc, term))
        self.sorted, self.place = self.doc[by_doc], by_doc - self.start[term]
        self.n_docs = n_docs

    def look_up(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the list of a term of each document (-1: not in it) and its impact there."""
        a, b = self.start[term], self.start[term + 1]
        at = np.minimum(a + np.searchsorted(self.sorted[a:b], docs), b - 1)
        found = self.sorted[at] == docs
        place = np.where(found, self.place[at], -1)
        return place, np.where(found, self.impact[a + np.maximum(place, 0)], 0)


def best(shard: Shard, terms: np.ndarray, times: np.ndarray, rank: np.ndarray, k: int = K, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents of a shard for a query and their scores, best first; and the documents looked at.

    rank: the documents' order among equal scores. Scores of zero are none.
    """
    lists = [(t, q, int(shard.start[t]), int(shard.start[t + 1])) for t, q in zip(terms.tolist(), times.tolist()) if shard.start[t] < shard.start[t + 1]]
    seen = [np.zeros(b - a, bool) for _, _, a, b in lists]
    position = [0] * len(lists)  # rows of each list that are seen without a gap
    met = np.zeros(shard.n_docs, bool)
    top, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    read, looked = 0, 0
    while lists:
        fresh = np.unique(np.concatenate([shard.doc[a + read : min(b, a + read + rows)] for _, _, a, b in lists]))
        fresh = fresh[~met[fresh]]
        met[fresh] = True
        looked += len(fresh)
        total = np.zeros(len(fresh), np.int64)
        for n, (t, q, _, _) in enumerate(lists):
            place, impact = shard.look_up(t, fresh)
            total += q * impact
            seen[n][place[place >= 0]] = True
        read += rows
        rows = min(2 * rows, MOST_ROWS)
        top, scores = np.r_[top, fresh], np.r_[scores, total]
        order = np.lexsort((rank[top], -scores))[:k]
        top, scores = top[order], scores[order]
        limit = 0
        for n, (_, q, a, b) in enumerate(lists):
            p = position[n]
            while p < b - a and seen[n][p]:
                step = seen[n][p : p + 4096]
                gap = int(np.argmin(step))
                p += len(step) if step[gap] else gap
            position[n] = p
            limit += q * int(shard.impact[a + p - 1]) if p < b - a else 0  # a list seen whole has nothing left to add
        if limit == 0 or (len(top) == k and limit < scores[-1]):
            break
    return top, scores, looked


POSTED = "doc_id long, n long, terms array<int>, tf array<long>"
FOUND = "query int, doc_id long, score long, looked long"


def post(docs: DataFrame, terms) -> DataFrame:
    """doc_id, n and the query terms with their occurrences, of each document with at least one term of any kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = X.text_bytes(batch.column(1))
            for i, j in X.chunks(off):
                size, doc, term, tf = count_terms(terms.value, raw[off[i] : off[j]], off[i : j + 1] - off[i])
                cut = pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(term, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(tf, pa.int64()))]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(size > 0))

    return docs.select("doc_id", "text").mapInArrow(run, POSTED)


def search(docs: DataFrame, items: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents (doc_id, text) for each row of items (item_id, text).

    Terms are the runs of letters, digits and characters beyond ASCII of the whole text, A-Z lower-cased; a null text has
    none. N counts the documents with a term, L all their terms, n those of one document; df documents hold a term, tf
    times in one. With w = floor(1000 ln((2N + 2) / (2df + 1))) and m = 75 + 25 n N div L, a document's score is the sum
    of w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included. Scores of 0 are left out; equal scores
    rank by ascending doc_id, null ids last. Repeated rows, of either table, are rows of their own; an item without
    terms, and any item where there are no documents, gets none. Other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    out = None
    for ids, texts in item_blocks(items):
        found = _search_block(rows, ids, texts, k, shard)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _search_block(rows: DataFrame, ids: list, texts: pa.Array, k: int, shard: int) -> DataFrame:
    """The search for a block of items, of bounded bytes."""
    spark = rows.sparkSession
    terms = terms_of(texts)
    shared = spark.sparkContext.broadcast(terms)  # of a block of items
    posted = stage(post(rows, shared), "postings")
    n, total = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.count(F.lit(1)) + 1))).cast("long").alias("w")
    weights = np.zeros(len(terms.key), np.int64)
    for r in posted.select(F.explode("terms").alias("term")).groupBy("term").agg(weight).collect():  # the terms of a block of items
        weights[r["term"]] = r["w"]
    weighed = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            base = 0
            # batches are cut where a shard is full
            cut = np.append(0, np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy()))
            while base < batch.num_rows:
                end = max(base + 1, int(np.searchsorted(cut, cut[base] + shard - size, "right")) - 1)
                held.append(batch.slice(base, end - base))
                size += int(cut[end] - cut[base])
                base = end
                if size >= shard or base < batch.num_rows:
                    yield from answer(held)
                    held, size = [], 0
        if held:
            yield from answer(held)

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        doc_id, term_lists, tf_lists = (pa.concat_arrays(table.column(c).chunks) for c in ("doc_id", "terms", "tf"))
        sizes = term_lists.value_lengths().to_numpy()
        term, tf = term_lists.flatten().to_numpy().astype(np.int64), tf_lists.flatten().to_numpy()
        length = table.column("n").to_numpy()
        m = 75 + 25 * length * n // total
        doc = np.repeat(np.arange(len(sizes)), sizes)
        impact = weighed.value[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        lists = Shard(len(sizes), len(weighed.value), doc, term, impact)
        rank = np.empty(len(sizes), np.int64)
        rank[np.lexsort((doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(sizes))
        for q, (query_terms, times) in enumerate(shared.value.queries):
            top, scores, looked = best(lists, query_terms, times, rank, k)
            if len(top):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), q), pa.int32()), doc_id.take(pa.array(top)), pa.array(scores), pa.array(np.full(len(top), looked))], ["query", "doc_id", "score", "looked"])

    found = posted.mapInArrow(run, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, pa.int64())}))
    return found.join(named, "query").select("item_id", "rank", "doc_id", "score")
