"""Token-ID files: static range asymmetric numeral system (rANS) blocks under a frequency table shared by the file.

Layout of a file, all integers little-endian:

    b"RANS0001", header length u32, header (JSON: counts, block size, lanes, sizes and CRC-32s of the sections), sections

    docs     zlib: validity bytes, doc ids i64, tokens of each document i64
    table    zlib: distinct ids u32, their frequencies u32 (sum 2^bits)
    blocks   zlib: for each block the words before it u64, tokens u32, CRC-32 of its ids u32, its lanes' states u64
    words    u32 renormalisation words of all blocks

A block decodes on its own from its checkpoint: its first word, its states and the table. Its lanes are interleaved:
token t is in lane t mod LANES, and the lanes of a step share the block's one stream of words.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as X
from .files import write_file
from .workspace import new_dir, stage, text_batches

MAGIC = b"RANS0001"
BITS, LANES, STEPS = 18, 32, 512
BLOCK = LANES * STEPS
_U = np.uint64
LOW = _U(1 << 31)
END_ID = 1
FILE_BYTES = 32 << 20


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and frequencies of at least 1 that sum to 2^BITS."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << BITS
    if len(symbols) > total:
        raise ValueError(f"more than {total} distinct ids")
    spare = total - len(symbols)
    share = counts * (spare / counts.sum()) if len(symbols) else counts
    freq = 1 + np.floor(share).astype(np.int64)
    if len(symbols):
        freq[np.argmax(counts)] += total - freq.sum()
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def encode_blocks(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block, states of each block's lanes). The last block is filled with the commonest id."""
    blocks = -(-len(ids) // BLOCK)
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    at = place[ids]
    at = np.concatenate([at, np.full(blocks * BLOCK - len(ids), int(np.argmax(freq)) if len(freq) else 0)])
    at = at.reshape(blocks, STEPS, LANES)
    f_of = freq.astype(np.uint64)
    c_of = np.cumsum(f_of) - f_of
    state = np.full((blocks, LANES), LOW, np.uint64)
    out = np.empty((blocks, STEPS, LANES), np.uint32)
    sent = np.empty((blocks, STEPS, LANES), bool)
    for t in range(STEPS - 1, -1, -1):
        f = f_of[at[:, t]]
        full = state >= f << _U(63 - BITS)
        out[:, t], sent[:, t] = state.astype(np.uint32), full
        state = np.where(full, state >> _U(32), state)
        state = ((state // f) << _U(BITS)) + state % f + c_of[at[:, t]]
    return out[sent], sent.sum(axis=(1, 2)), state


def decode_blocks(words: np.ndarray, first: np.ndarray, states: np.ndarray, symbols: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Ids of the given blocks, a row each; first: index of each block's first word."""
    f_of = freq.astype(np.uint64)
    c_of = np.cumsum(f_of) - f_of
    slot_of = np.repeat(np.arange(len(symbols), dtype=np.int64), freq)
    state, at = states.copy(), first.astype(np.int64).copy()
    out = np.empty((len(first), STEPS, LANES), np.int64)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    mask = _U((1 << BITS) - 1)
    for t in range(STEPS):
        slot = state & mask
        s = slot_of[slot.astype(np.int64)]
        out[:, t] = s
        state = f_of[s] * (state >> _U(BITS)) + slot - c_of[s]
        low = state < LOW
        k = np.cumsum(low, axis=1)
        place = np.minimum(at[:, None] + k - 1, len(words) - 1)
        state = np.where(low, (state << _U(32)) | words[np.maximum(place, 0)], state)
        at += k[:, -1]
    return symbols[out.reshape(len(first), BLOCK)]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of the documents' ids."""
    symbols, freq = frequency_table(ids)
    words, each, states = encode_blocks(ids, symbols, freq)
    n = len(each)
    crc = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(n)]
    tokens = [min(BLOCK, len(ids) - k * BLOCK) for k in range(n)]
    sections = {
        "docs": zlib.compress(np.array([x is not None for x in doc_ids], np.uint8).tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes()),
        "table": zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes()),
        "blocks": zlib.compress((np.cumsum(each) - each).astype("<u8").tobytes() + np.array(tokens, "<u4").tobytes() + np.array(crc, "<u4").tobytes() + states.astype("<u8").tobytes()),
        "words": words.astype("<u4").tobytes(),
    }
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "blocks": n, "symbols": len(symbols), "bits": BITS, "lanes": LANES, "steps": STEPS, "sections": {k: [len(v), zlib.crc32(v)] for k, v in sections.items()}}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(sections.values())


class File:
    """A parsed file; ids(first, last) decodes a range of blocks without the others."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<I", data, len(MAGIC))
        at = len(MAGIC) + 4 + n
        self.head = json.loads(data[len(MAGIC) + 4 : at])
        if (self.head["bits"], self.head["lanes"], self.head["steps"]) != (BITS, LANES, STEPS):
            raise ValueError("token file of another block layout")
        part = {}
        for name, (size, crc) in self.head["sections"].items():
            part[name] = data[at : at + size]
            if len(part[name]) != size or zlib.crc32(part[name]) != crc:
                raise ValueError(f"section {name} is damaged")
            at += size
        d, s, b = self.head["docs"], self.head["symbols"], self.head["blocks"]
        raw = zlib.decompress(part["docs"])
        self.valid, self.doc_ids = np.frombuffer(raw, np.uint8, d).astype(bool), np.frombuffer(raw, "<i8", d, d)
        self.lengths = np.frombuffer(raw, "<i8", d, 9 * d)
        raw = zlib.decompress(part["table"])
        self.symbols, self.freq = np.frombuffer(raw, "<u4", s), np.frombuffer(raw, "<u4", s, 4 * s)
        raw = zlib.decompress(part["blocks"])
        self.first, self.tokens = np.frombuffer(raw, "<u8", b), np.frombuffer(raw, "<u4", b, 8 * b)
        self.crc, self.states = np.frombuffer(raw, "<u4", b, 12 * b), np.frombuffer(raw, "<u8", b * LANES, 16 * b).reshape(b, LANES)
        self.words = np.frombuffer(part["words"], "<u4")

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.head["blocks"] if last is None else last
        if first >= last:
            return np.zeros(0, np.uint32)
        rows = decode_blocks(self.words, self.first[first:last], self.states[first:last], self.symbols, self.freq)
        for k, row in enumerate(rows, first):
            if zlib.crc32(row[: self.tokens[k]].astype("<u4").tobytes()) != self.crc[k]:
                raise ValueError(f"block {k} is damaged")
        return np.concatenate([row[: self.tokens[k]] for k, row in enumerate(rows, first)])


class Encoder:
    """The tokenizers library, asked once for each distinct run of bytes other than ASCII white space.

    Only for vocabularies whose tokenizer lower-cases, drops white space and treats what is between it apart. Runs are
    told apart by a 64-bit hash; their ids are kept in arrays, emptied when they hold `most` runs.
    """

    def __init__(self, path: str, most: int = 3_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.key = self.check = np.zeros(0, np.uint64)  # sorted by key
        self.start = self.size = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, key: np.ndarray, check: np.ndarray, runs: list[str]) -> None:
        start, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        for k in range(0, len(runs), 20_000):
            lists = [e.ids for e in self.library.encode_batch_fast(runs[k : k + 20_000], add_special_tokens=False)]
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            total = int(count.sum())
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
            size[k : k + len(lists)], start[k : k + len(lists)] = count, self.used + np.cumsum(count) - count
            self.used += total
        at = np.searchsorted(self.key, key)
        self.key, self.check, self.start, self.size = (np.insert(a, at, b) for a, b in ((self.key, key), (self.check, check), (self.start, start), (self.size, size)))

    def _plainly(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids without the table, a text at a time."""
        data, cuts = raw.tobytes(), off.tolist()
        lists = [np.array(self.library.encode(data[a:b].decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(cuts, cuts[1:])]
        return np.concatenate(lists), np.array(list(map(len, lists)), np.int64)

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of texts, and the number of ids of each."""
        s, e, doc = X.words(raw, off)
        data = raw.tobytes()
        # the marks of special tokens are told apart by case, ordinary text is not
        told = raw if b"<|" in data else X.LOWER[raw]
        key, check = X.block_hash(told, s, e), X.block_hash(told, s, e, 1 << 32)
        one, first, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.key) + len(one) > self.most:
            self._clear()
        at = np.searchsorted(self.key, one)
        new = np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] != one) if len(self.key) else np.arange(len(one))
        if len(new):
            self._learn(one[new], check[first[new]], [data[a:b].decode() for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist())])
            at = np.searchsorted(self.key, one)
        at = at[which]
        if (self.check[at] != check).any():  # words with one key that the second hash tells apart
            return self._plainly(raw, off)
        size = self.size[at]
        place = np.arange(int(size.sum())) + np.repeat(self.start[at] - np.cumsum(size) + size, size)
        return self.pool[place], np.bincount(doc, size, minlength=len(off) - 1).astype(np.int64)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, name: str = "word_bpe_49k.json", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all documents, each with the end id, in ascending doc_id order; returns the list of files.

    Texts are dealt by range of doc_id, so the files in name order hold the documents in order. A task encodes its
    range and closes a file whenever about file_bytes of ids are gathered. Rows with the same doc_id stay together, in
    the order of a hash of their texts; null ids come first; a null text has the end id alone.
    """
    spark = docs.sparkSession
    text_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id")
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import tokenizer_path

        encode, part = encoder(path or tokenizer_path(name)), TaskContext.get().partitionId()
        ids, lengths, held, size, made = [], [], [], 0, []

        def close() -> None:
            nonlocal size
            each, flat = np.concatenate(lengths), np.concatenate(ids)
            file = f"tokens-{part:06d}-{len(made):06d}.rans"
            data = pack(held, each, flat)
            write_file(f"{folder}/{file}", data)
            made.append((file, len(held), len(flat), len(data)))
            for x in (ids, lengths, held):
                x.clear()
            size = 0

        for batch in batches:
            raw, off = X.text_bytes(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for i, j in X.chunks(off, min(X.CHUNK_BYTES, file_bytes)):
                found, count = encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                ids.append(np.insert(found, np.cumsum(count), END_ID))
                lengths.append(count + 1)
                held += doc_ids[i:j]
                size += 4 * len(ids[-1])
                if size >= file_bytes:
                    close()
        if held:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["file", "docs", "tokens", "bytes"])

    return stage(rows.mapInArrow(write, "file string, docs long, tokens long, bytes long"), "token-files")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """file, doc_id, ids (array of ints) and the tokens before it in the file, for each document of the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, file, ids in _opened(batches):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(file.lengths)), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lists), pa.string()), pa.array(file.doc_ids, mask=~file.valid), pa.array(np.cumsum(file.lengths) - file.lengths), lists], ["file", "doc_id", "before", "ids"])

    return _files(spark, folder).mapInArrow(read, "file string, doc_id long, before long, ids array<int>")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(folder).select("path", "content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, File, np.ndarray]]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            file = File(content.as_py())
            yield path.rpartition("/")[2], file, file.ids()


def token_digests(docs: DataFrame, path: str | None = None, name: str = "word_bpe_49k.json") -> DataFrame:
    """Write the token files of docs, read them back, and return doc_id, start, n_tokens and ids_crc32 from them.

    start counts the ids of all documents before a document. An empty table gives no files and an empty result.
    """
    spark = docs.sparkSession
    folder = new_dir(spark, "tokens")
    files = write_tokens(docs, folder, path, name)
    if files.isEmpty():
        return spark.createDataFrame([], SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, file, ids in _opened(batches):
            before = np.cumsum(file.lengths) - file.lengths
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(before.tolist(), file.lengths.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(crc), pa.string()), pa.array(file.doc_ids, mask=~file.valid), pa.array(before), pa.array(file.lengths), pa.array(crc, pa.int64())], ["file", "doc_id", "before", "n_tokens", "ids_crc32"])

    rows = _files(spark, folder).mapInArrow(read, "file string, doc_id long, before long, n_tokens long, ids_crc32 long")
    # Files are numbered by task: a running sum within each task's files, and one over the totals of the tasks. A window
    # without partitions sees one row for each task of the writing job, never one for each file.
    numbered = files.select("file", "tokens", F.split_part("file", F.lit("-"), F.lit(2)).cast("int").alias("part"))
    totals = numbered.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = numbered.withColumn("within", within).join(totals.select("part", before.alias("before_part")), "part")
    starts = starts.select("file", (F.col("before_part") + F.col("within")).alias("first"))
    return rows.join(starts, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
