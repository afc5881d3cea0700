"""BPE encoding as a bounded-lookahead transducer, and decoding as an incremental state machine.

The model is read from a public tokenizer file (byte-level BPE with an end-of-word suffix: NFC, white space collapsed,
lower case, split by a pattern). Text streams through in slices, cut after white space or else inside a word, and each
piece of the pattern through a transducer, which goes back and forth in a window of a few times the merge list's
sufficient lookahead and emits a token once that many symbols follow it or the piece ends. A piece may go on over any
number of slices. Memory is a slice, a window and bounded caches; short pieces and words that came before are looked up.
Only a run of combining marks or Hangul letters without end cannot be cut: its normal form is not settled before it ends.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .workspace import text_batches

#: Fixed value: the split pattern of the word_bpe vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
SLICE = 1 << 16
CACHE = 300_000
PAIRS = 1 << 18
#: Characters that str.split takes for white space and the pattern does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.vocab: dict[str, int] = data["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.written = {v: k for k, v in (self.vocab | self.special).items()}
        self.alphabet = byte_alphabet()
        #: by token: the rank that makes it, and its parts
        self._made = {a + b: (k, a, b) for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.lookahead = sufficient_lookahead(pairs)
        self.step = 4 * self.lookahead
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        self._lengths = _lengths(self.vocab)
        self._apart: dict[tuple[str, str], bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._chunks = _Cache(self._encode_chunk)
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    # -- one piece -------------------------------------------------------------------------------------------

    def merge(self, parts: list[str]) -> list[str]:
        """Apply the merges to a list of symbols, lowest rank first, leftmost first."""
        rank, none = self.rank.get, 1 << 60
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether two tokens side by side are left as they are by the merges."""
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            known = self._apart[left, right] = not self._cross(left, right)
        return known

    def _cross(self, left: str, right: str) -> bool:
        """Whether some merge takes parts of both tokens.

        Goes back in time over the parts that touch at the boundary: two that were there together are merged when their
        merge comes before those that made the next larger part of either; of equal merges the one to the left comes first.
        """
        made, rank = self._made, self.rank
        end_left = end_right = 1 << 60
        a, b = left, right
        while True:
            k = rank.get((a, b))
            if k is not None and k < end_left and k <= end_right:
                return True
            of_a, of_b = made.get(a), made.get(b)
            if of_b is not None and (of_a is None or of_b[0] >= of_a[0]):
                end_right, b = of_b[0], of_b[1]
            elif of_a is not None:
                end_left, a = of_a[0], of_a[2]
            else:
                return False

    def path(self, window: str, before: str | None, ended: bool) -> list[str]:
        """The tokens of a stretch of symbols after the token `before`; ended: the stretch is the last of its piece.

        The only tokens of which each stays apart from the one before it: the longest are tried first, and a place from
        which none leads on is not tried again.
        """
        n, vocab, lengths, apart, start = len(window), self.vocab, self._lengths, self._apart, before
        out: list[str] = []
        back: list[tuple[int, Iterator[int]]] = []
        closed: set[int] = set()
        at, tries = 0, iter(lengths.get(window[:3], _SHORT))
        while at < n:
            for k in tries:
                stop = at + k
                if stop > n or stop in closed:
                    continue
                token = window[at:stop] + END if ended and stop == n else window[at:stop]
                if token not in vocab:
                    continue
                if before is not None:
                    known = apart.get((before, token))
                    if known is None:
                        known = self.stay_apart(before, token)
                    if not known:
                        continue
                out.append(token)
                back.append((at, tries))
                before, at = token, stop
                tries = iter(lengths.get(window[at : at + 3], _SHORT))
                break
            else:
                closed.add(at)
                at, tries = back.pop()
                out.pop()
                before = out[-1] if out else start
        return out

    def symbols_of(self, text: str) -> str:
        """A character for each byte of a text."""
        return text if text.isascii() and text.isprintable() else text.encode("utf-8").decode("latin-1").translate(self.table)

    def ids(self, tokens: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return struct.pack(f"<{len(tokens)}I", *map(self.vocab.__getitem__, tokens))

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one whole piece of the pattern."""
        return self.ids(Transducer(self).feed(self.symbols_of(piece), True))

    def _encode_chunk(self, chunk: str) -> bytes:
        pieces, out = self._pieces, []
        for piece in (chunk,) if chunk.isascii() and chunk.isalpha() else _pattern().findall(chunk):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    if len(pieces) >= CACHE:
                        pieces.clear()
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    # -- a text ----------------------------------------------------------------------------------------------

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids of a text, slice by slice, as little-endian unsigned 32-bit integers."""
        for k, part in enumerate(self._special.split(text or "")) if self._special else [(0, text or "")]:
            if k % 2:
                yield self.special[part].to_bytes(4, "little")
                continue
            open_: Transducer | None = None
            for cut, goes_on in slices(part):
                ids, open_ = self._encode_slice(cut, open_, goes_on)
                yield ids

    def _encode_slice(self, text: str, open_: Transducer | None, goes_on: bool) -> tuple[bytes, Transducer | None]:
        """Ids of a slice. open_: the piece that the slice before left open; goes_on: the next slice may go on in the last word."""
        text = unicodedata.normalize("NFC", text)
        # lower-casing is by character: no final sigma
        text = (text if text.isascii() else text.replace("Σ", "σ")).lower()
        out = []
        if open_ is not None:
            k = m.end() if (m := open_.kind.match(text)) else 0
            if goes_on and k == len(text):
                return self.ids(open_.feed(self.symbols_of(text))), open_
            out.append(self.ids(open_.feed(self.symbols_of(text[:k]), True)))
            text, open_ = text[k:], None
        words = _space().split(text) if goes_on or _NOT_SPACE.search(text) else text.split()
        if goes_on and (pieces := _pattern().findall(words[-1])):
            kind = next((x for x in _runs() if x.fullmatch(pieces[-1])), None)
            out += [*map(self._chunks.__getitem__, words[:-1]), *map(self.encode_piece, pieces if kind is None else pieces[:-1])]
            if kind is not None:
                open_ = Transducer(self, kind)
                out.append(self.ids(open_.feed(self.symbols_of(pieces[-1]))))
        else:
            out += map(self._chunks.__getitem__, words)
        return b"".join(out), open_


class Transducer:
    """Tokens of one piece that comes in parts of any length; a token is given once nothing that follows can change it."""

    __slots__ = ("model", "kind", "window", "before")

    def __init__(self, model: Bpe, kind=None):
        self.model, self.kind, self.window, self.before = model, kind, "", None

    def feed(self, part: str, ended: bool = False) -> list[str]:
        """The tokens that are stable after more symbols; ended: there are no more."""
        step, at = self.model.step, 0
        if ended and part and not self.window and len(part) <= step:
            # all that is left is one window
            before, self.before = self.before, None
            return self.model.path(part, before, True)
        out: list[str] = []
        while len(self.window) + len(part) - at > step:
            take = step - len(self.window)
            self.window += part[at : at + take]
            at += take
            out += self._stable()
        self.window += part[at:]
        if ended and self.window:
            out += self.model.path(self.window, self.before, True)
            self.window, self.before = "", None
        return out

    def _stable(self) -> list[str]:
        """The tokens followed by the sufficient lookahead, taken out of the window."""
        out, end, most = [], 0, len(self.window) - self.model.lookahead
        for token in self.model.path(self.window, self.before, False):
            if end + len(token) > most:
                break
            out.append(token)
            end += len(token)
        if out:
            self.window, self.before = self.window[end:], out[-1]
        return out


def slices(text: str, size: int | None = None) -> Iterator[tuple[str, bool]]:
    """Slices of a text of about `size` characters, and whether a word may go on from each into the next.

    They are cut after white space, or where there is none before a character that no normal form and no contraction
    joins with what comes before it.
    """
    size, at, n = size or SLICE, 0, len(text)
    while at < n:
        end = at + size
        if end >= n:
            yield text[at:], False
            return
        if (space := max(text.rfind(" ", at, end), text.rfind("\n", at, end))) >= at:
            end = space + 1
            yield text[at:end], False
        else:
            while end < n and not _loose(text, end):
                end += 1
            yield text[at:end], end < n
        at = end


def _loose(text: str, k: int) -> bool:
    a, b = text[k - 1], text[k]
    return not ("'" in text[max(0, k - 3) : k + 1] or unicodedata.category(b)[0] == "M" or "\u1100" <= a <= "\u11ff" or "\u1100" <= b <= "\u11ff" or "\uac00" <= a <= "\ud7a3")


#: Lengths tried at a place where no token of three symbols or more starts.
_SHORT = (2, 1)


def _lengths(vocab: Iterable[str]) -> dict[str, tuple[int, ...]]:
    """By the first three symbols, the lengths of the tokens that start with them and the shorter ones, longest first."""
    found: dict[str, set[int]] = {}
    for token in vocab:
        n = len(token.removesuffix(END)) or len(token)
        if n >= 3:
            found.setdefault(token[:3], {1, 2}).add(n)
    return {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}


class _Cache(dict):
    """Results of a function by argument; long arguments are not kept, and the cache is emptied when it is full."""

    def __init__(self, f, size: int = CACHE):
        super().__init__()
        self.f, self.size = f, size

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value


@lru_cache(1)
def _pattern():
    return regex.compile(PATTERN)


@lru_cache(1)
def _runs():
    """The kinds of pieces that may go on: letters, and what is neither letter, digit nor white space."""
    return regex.compile(r"[\p{L}]+"), regex.compile(r"[^\s\p{L}\p{N}]+")


@lru_cache(1)
def _space():
    return regex.compile(r"\s+")


@lru_cache(1 << 16)
def _symbols(token: str) -> tuple[str, ...]:
    body = token.removesuffix(END) if len(token) > len(END) else token
    out = list(body)
    if body is not token and len(body) < len(token):
        out[-1] += END
    return tuple(out)


def symbols(token: str) -> list[str]:
    """The starting symbols of a token; the end-of-word mark belongs to the last of them."""
    return list(_symbols(token))


def sufficient_lookahead(pairs: list[tuple[str, str]]) -> int:
    """Symbols to the right of a token boundary that can still decide it.

    A boundary before (p, q) is decided by whether q forms, which a merge of lower rank of a part on q's right edge
    with what follows can prevent, and so on: ranks fall strictly along such a chain, so its greatest length in
    symbols is found in rank order.
    """
    made = {a + b: (k, a, b) for k, (a, b) in reversed(list(enumerate(pairs)))}
    reach: dict[str, tuple[list[int], list[int]]] = {}  # by left part: ranks, and the longest chain up to each
    most = 1
    for k, (a, b) in enumerate(pairs):
        longest, part, limit = 0, b, k
        while True:
            ranks, best = reach.get(part, ((), ()))
            if i := bisect_left(ranks, limit):
                longest = max(longest, best[i - 1])
            if part not in made:
                break
            limit, part = min(limit, made[part][0]), made[part][2]
        length = len(symbols(b)) + longest
        ranks, best = reach.setdefault(a, ([], []))
        ranks.append(k)
        best.append(max(length, best[-1]) if best else length)
        most = max(most, length)
    return most


class Decoder:
    """Incremental decoding: feed() gives the text that is certain so far, finish() the rest.

    written=True gives each token as the vocabulary writes it, with a space between tokens (what the tokenizer file,
    which names no decoder, asks for); written=False turns tokens into bytes and bytes into text, with a space for
    each end of word, and replaces what is not UTF-8.
    """

    def __init__(self, model: Bpe, written: bool = False):
        self.model, self.written, self.first = model, written, True
        if not written:
            self.table = token_bytes(model)
            self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not self.written:
            return self.state.decode(b"".join(map(self.table.__getitem__, ids)))
        if not ids:
            return ""
        out = " ".join(map(self.model.written.__getitem__, ids))
        if not self.first:
            out = " " + out
        self.first = False
        return out

    def finish(self) -> str:
        return "" if self.written else self.state.decode(b"", True)


def token_bytes(model: Bpe) -> dict[int, bytes]:
    if not hasattr(model, "_bytes"):
        byte = {c: bytes([b]) for b, c in enumerate(model.alphabet)}
        model._bytes = {}
        for i, token in model.written.items():
            if token in model.special:
                model._bytes[i] = token.encode()
            else:
                body, end = (token[: -len(END)], b" ") if token.endswith(END) else (token, b"")
                model._bytes[i] = b"".join(byte.get(c, c.encode()) for c in body) + end
    return model._bytes


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long, text_bytes long"


def encode_and_decode(docs: DataFrame, path: str | None = None, name: str = "word_bpe_49k.json") -> DataFrame:
    """Encode every whole text and decode its ids again: counts and digests of both, per row of docs.

    doc_id, n_tokens, ids_sha256, decoded_sha256 (of the text in UTF-8, tokens as written), n_words (ends of words) and
    text_bytes (bytes of the text that the byte-to-text decoder gives). A null text is empty: no tokens, the digests of
    nothing. Repeated rows and null ids are kept; other columns are ignored. path: the tokenizer file, at the same
    place on every executor; by default the installed public file of that name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path or tokenizer_path(name))
        for batch in batches:
            rows = [digests(model, text.as_py()) for text in batch.column(1)]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], [x.split()[0] for x in SCHEMA.split(", ")])

    text_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def digests(model: Bpe, text: str | None) -> tuple[int, str, str, int, int]:
    ids_sha, text_sha = hashlib.sha256(), hashlib.sha256()
    written, plain = Decoder(model, True), Decoder(model)
    n = n_words = n_bytes = 0
    for ids in model.encode(text):
        ids_sha.update(ids)
        numbers = np.frombuffer(ids, "<u4").tolist()
        n += len(numbers)
        out = written.feed(numbers)
        n_words += out.count(END)
        text_sha.update(out.encode())
        n_bytes += len(plain.feed(numbers).encode())
    text_sha.update(written.finish().encode())
    n_bytes += len(plain.finish().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest(), n_words, n_bytes
