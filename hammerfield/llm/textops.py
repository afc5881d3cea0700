"""Vectorised byte and word operations on Arrow string columns.

Texts of a batch are handled in chunks of whole documents of about a megabyte, so memory does not
grow with the batch; a document longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (n + 1); null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = arr.cast(pa.large_string() if not pa.types.is_binary(arr.type) else pa.large_binary()).fill_null("" if not pa.types.is_binary(arr.type) else b"")
    n, (_, offs, data) = len(arr), arr.buffers()
    off = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in ((0, _P), (1, _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _pow[k] = np.multiply.accumulate(out)
    return _pow[0], _pow[1]


_TAIL = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)


def block_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they are, each salt another hash.

    A span is cut into blocks of eight bytes, each mixed with its place before they are added. Unlike a polynomial
    modulo 2^64, which gives both Thue-Morse words of 1,024 letters one hash whatever its base, this has no fixed family
    of strings that collide.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    blocks = np.maximum(size + 7 >> 3, 1)
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(start, blocks) + 8 * place
    left = np.clip(np.repeat(end, blocks) - at, 0, 8)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    value = mix((eight[at] & _TAIL[left]) ^ (place + (salt + 1)).astype(np.uint64) * _P)
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = the polynomial hash of raw[i:j] times P^i, modulo 2^64.

    For overlapping spans at every place, where bytes decide afterwards: some strings collide by construction (see
    block_hash), so an equal hash must never decide a result.
    """
    up, _ = _powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans; equal bytes give equal hashes wherever they are."""
    _, down = _powers(len(c))
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


def words(raw: np.ndarray, off: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word: by default [^\\x20\\x09-\\x0D]+, else a run of bytes outside `space`; off starts at 0."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~space[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    begin = off[:-1][off[:-1] < off[1:]]
    first[begin] = word[begin]
    last[off[1:][off[:-1] < off[1:]] - 1] = word[off[1:][off[:-1] < off[1:]] - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word with A-Z lower-cased, and its document."""
    s, e, doc = words(raw, off)
    return block_hash(LOWER[raw], s, e), doc


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each document, sorted by (document, hash), and their documents.

    A document of fewer than k words has its whole word sequence as its one shingle; one without words has none.
    """
    w, doc = word_hashes(raw, off)
    n = len(w)
    if not n:
        return w, doc
    count = np.bincount(doc, minlength=len(off) - 1)
    end = np.cumsum(count)[doc]
    at = np.arange(n)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        x = np.zeros(n, np.uint64)
        x[: n - j] = w[j:]
        x[at + j >= end] = 0
        h = h * _U(0x9FB21C651E98DF25) + x
    keep = (at + k <= end) | ((count[doc] < k) & (at == end - count[doc]))
    h, doc = mix(h[keep]), doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]
