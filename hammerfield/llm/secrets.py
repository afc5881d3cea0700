"""Secret scan: spans of texts that look like keys, by stated patterns and by sliding-window entropy.

Three patterns give the base spans. Beside them, the runs of each character class (CLASSES) are the candidate strings:
a window of fixed width moves over each, its character counts change by the one that enters and the one that leaves,
and with them the sum of c * log2(c), which gives the window's Shannon entropy. The windows at or above the class's
bound, of the kinds of characters it asks for, join into spans; what the allow-list names is suppressed. All runs of a
chunk of texts move through numpy together: each step's change of the sum is found from the places of equal characters,
and a running total of the changes is the sum. It is kept in integers, so nothing depends on the order of additions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as X
from .workspace import text_batches

#: The patterns of base spans, on bytes with A-Z lower-cased (assign) or as they are.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


DIGITS, UPPER, LOWER = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
HEX = _table(DIGITS + b"abcdef")
KINDS = ["assign", "access", "hex"]


@dataclass(frozen=True)
class CharClass:
    """A class of candidate strings: a window of `width` characters counts at `bits` of entropy a character or more, and
    with at least `each` characters of every one of `needs`."""

    kind: str
    chars: bytes
    width: int
    bits: float
    needs: tuple[bytes, ...]
    each: int


#: Windows over random characters of the class have, on average, 3.6, 3.9 and 4.2 bits; words have no digits.
CLASSES = (
    CharClass("entropy_hex", DIGITS + b"abcdefABCDEF", 24, 3.0, (DIGITS, b"abcdefABCDEF"), 3),
    CharClass("entropy_base32", DIGITS + UPPER, 20, 3.4, (DIGITS, UPPER), 3),
    CharClass("entropy_base64", DIGITS + UPPER + LOWER + b"+/_=-", 24, 3.9, (DIGITS, UPPER, LOWER), 2),
)
#: What is no secret: a candidate string that holds one of these (A-Z lower-cased), such as samples in manuals and alphabets.
ALLOWED = (r"example", r"placeholder", r"changeme", r"0123456789", r"abcdefghij", r"([0-9a-z])\1{7}", r"(?:^|[^0-9a-f])[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}(?:$|[^0-9a-f])")
#: c * log2(c) is kept as an integer, in units of 2^-20 bit.
UNIT = 1 << 20


def weight(c: np.ndarray) -> np.ndarray:
    """c * log2(c) in units, for whole counts."""
    return np.rint(c * np.log2(np.maximum(c, 1)) * UNIT).astype(np.int64)


def window_sums(codes: np.ndarray, run: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Sum of weight(count) over the characters of the window that ends at each place.

    codes: characters of all runs in a row; run and first: the run of each place and where that run starts. Windows at
    the start of a run are shorter.
    """
    n = len(codes)
    at = np.arange(n)
    group = run * 256 + codes
    order = np.argsort(group, kind="stable")
    key = group[order] * np.int64(n + 1) + order  # ascending: equal characters of a run by their places
    place = np.empty(n, np.int64)
    place[order] = at
    base = group * np.int64(n + 1)
    # equal characters in the width - 1 places before, and in those after, within the run
    before = place - np.searchsorted(key, base + np.maximum(at - width + 1, first))
    steps = weight(np.arange(width + 2))
    change = steps[before + 1] - steps[before]
    leaves = np.flatnonzero(at - width >= first)
    gone = leaves - width
    after = np.searchsorted(key, base[gone] + leaves) - place[gone]
    change[leaves] -= steps[after] - steps[after - 1]
    total = np.cumsum(change)
    return total - np.where(first > 0, total[first - 1], 0)


def entropy_spans(raw: np.ndarray, off: np.ndarray, kind: CharClass) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the spans of a class, and the start and end of the candidate string of each."""
    s, e, doc = X.words(raw, off, ~_table(kind.chars))
    long = e - s >= kind.width
    s, e, doc = s[long], e[long], doc[long]
    size = e - s
    if not len(s):
        return s, e, doc, s, e
    run = np.repeat(np.arange(len(s)), size)
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(run))
    codes = raw[at - first + s[run]].astype(np.int64)
    limit = int(np.floor((np.log2(kind.width) - kind.bits) * kind.width * UNIT))
    high = (window_sums(codes, run, first, kind.width) <= limit) & (at - first >= kind.width - 1)
    for needed in kind.needs:
        seen = np.cumsum(_table(needed)[codes])
        high &= seen - np.where(at >= kind.width, seen[at - kind.width], 0) >= kind.each
    ends = np.flatnonzero(high)
    if not len(ends):
        return s[:0], e[:0], doc[:0], s[:0], e[:0]
    # windows of one run that overlap or touch are one span
    new = np.r_[True, (ends[1:] - ends[:-1] > kind.width) | (run[ends[1:]] != run[ends[:-1]])]
    last = ends[np.r_[new[1:], True]]
    r, shift = run[last], s[run[last]] - first[last]
    return ends[new] - kind.width + 1 + shift, last + 1 + shift, doc[r], s[r], e[r]


def scan(raw: np.ndarray, off: np.ndarray, classes: Iterable[CharClass] = CLASSES, allowed: Iterable[str] = ALLOWED) -> list[list[tuple[int, int, int]]]:
    """Spans (start, rank of the kind, end) of each text, sorted, in code points: base kinds first, then the classes."""
    classes = list(classes)
    quiet = [re.compile(p.encode()) for p in allowed]
    n = len(off) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    data, low = raw.tobytes(), X.LOWER[raw].tobytes()
    cuts = off.tolist()
    for k in range(n):
        a, b = cuts[k], cuts[k + 1]
        out[k] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low[a:b]) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
        out[k] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data[a:b]) if m.end() - m.start() >= ACCESS_LEAST]
    s, e, doc = X.words(raw, off, ~HEX)
    for i in np.flatnonzero(e - s >= HEX_LEAST).tolist():
        k = int(doc[i])
        out[k].append((int(s[i]) - cuts[k], 2, int(e[i]) - cuts[k]))
    base = [list(x) for x in out]
    for rank, kind in enumerate(classes, len(KINDS)):
        for a, b, k, x, y in zip(*(v.tolist() for v in entropy_spans(raw, off, kind))):
            if any(p.search(low[x:y]) for p in quiet):
                continue
            a, b = a - cuts[k], b - cuts[k]
            if not any(p <= a and b <= q for p, _, q in base[k]):
                out[k].append((a, rank, b))
    for k in range(n):
        if out[k]:
            a, b = cuts[k], cuts[k + 1]
            # bytes that go on with a character are no code points
            points = np.append(0, np.cumsum(raw[a:b] & 0xC0 != 0x80))
            out[k] = sorted((int(points[p]), kind, int(points[q])) for p, kind, q in out[k])
    return out


def find_secrets(docs: DataFrame, classes: Iterable[CharClass] = CLASSES, allowed: Iterable[str] = ALLOWED) -> DataFrame:
    """doc_id and found, an array of (kind, start, end), for every row of docs (doc_id, text), null ids and repeated rows too.

    Base kinds, leftmost matches that do not overlap within a kind, in code points with the end exclusive: assign (a
    named password, secret, token or key and its value of 6 characters or more), access (AKIA and capitals or digits,
    20 or more in all), hex (24 or more of 0-9a-f). Then the spans of the classes; those inside a base span, and those
    whose candidate string the allow-list (regular expressions on its bytes, A-Z lower-cased) names, are left out. A
    null or empty text holds none. Other columns are ignored. Each row is scanned whole, where it is read: nothing is
    shuffled.
    """
    text_batches(docs.sparkSession)
    classes, allowed = tuple(classes), tuple(allowed)
    names = pa.array([*KINDS, *(c.kind for c in classes)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = X.text_bytes(batch.column(1))
            found: list[list[tuple[int, int, int]]] = []
            for i, j in X.chunks(off):
                found += scan(raw[off[i] : off[j]], off[i : j + 1] - off[i], classes, allowed)
            flat = np.array([x for row in found for x in row], np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([names.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])], ["kind", "start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64)), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(kind)], ["doc_id", "found"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")
