"""BPE encoding (op6) and token files (op8) against the tokenizers library."""

import hashlib
import json
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from hammerfield.llm import bpe, rans
from hammerfield.llm.workspace import new_dir

NAME = "word_bpe_49k.json"
DOCS = "doc_id long, text string, n_tokens string, ids string, start string, file string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.tokenizer_path(NAME))
    t.no_padding()
    t.no_truncation()
    return t


def texts(seed=5):
    rng = random.Random(seed)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCdef019 .,'", "éàüßΣσς中文한글🙂́‍", "0123456789-/:", " \t\n\x0b\x0c\r\x1c\x85  "]
    out = [None, "", " ", "\n\t ", "a", "it's they'll I'M", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|>", "é É", "İstanbul ΑΣ Σ", "x" * 3000, "é" * 2000, "ab" * 40000 + " end", "word " * 40000]
    for _ in range(150):
        out.append("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([3, 30, 300]))))
    return [*out, out[20], out[20]]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_op6_equals_library(spark, library):
    rows = texts()
    got = bpe.encode_and_decode(spark.createDataFrame([(i, t, "", "", "", "") for i, t in enumerate(rows)], DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = ids_of(library, rows[r.doc_id])
        assert r.n_tokens == len(ids), rows[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_and_decode(spark.createDataFrame([], DOCS)).collect() == []


def small_model(tmp_path, rng, letters="abc", merges=14):
    """A random merge list over a few letters, in which each pair could come up in training: the merges before leave it so."""

    def model():
        path = tmp_path / f"{rng.random()}.json"
        path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": pairs}, "added_tokens": []}))
        return bpe.Bpe(str(path))

    tokens = [*letters, *(c + bpe.END for c in letters)]
    pairs = []
    while len(pairs) < merges:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if not a.endswith(bpe.END) and a + b not in tokens and model().merge(bpe.symbols(a) + bpe.symbols(b)) == [a, b]:
            pairs.append((a, b))
            tokens.append(a + b)
    return model()


def merged(model, word):
    parts = [model.alphabet[b] for b in word.encode()]
    parts[-1] += bpe.END
    return model.merge(parts)


def fed(model, word, rng, most):
    """Tokens of a word fed in parts of up to `most` symbols."""
    machine, rest, out = bpe.Transducer(model), model.symbols_of(word), []
    while len(rest) > 1:
        k = min(rng.randrange(1, most + 1), len(rest) - 1)
        out += machine.feed(rest[:k])
        rest = rest[k:]
        assert len(machine.window) <= 4 * model.lookahead
    return out + machine.feed(rest, True)


def test_transducer_equals_whole_merge():
    model, rng = bpe.load(bpe.tokenizer_path(NAME)), random.Random(1)
    assert 2 <= model.lookahead < 1000
    pieces = [rng.choice(["the", "ation", "a", "ing", "zq", "un", "é", "ss"]) for _ in range(4000)]
    for n in (1, 5, 60, 900):
        for _ in range(20):
            word = "".join(rng.choices(pieces, k=n))[: 4 * n]
            assert fed(model, word, rng, 700) == merged(model, word)


def test_tokens_stay_apart_as_the_merges_leave_them(tmp_path):
    model, rng = bpe.load(bpe.tokenizer_path(NAME)), random.Random(6)
    tokens = [t for t in model.vocab if t not in model.special]
    first = [t for t in tokens if not t.endswith(bpe.END)]
    pairs = [(rng.choice(first), rng.choice(tokens)) for _ in range(20_000)]
    pairs += [(a, b) for a in rng.sample(first, 150) for b in rng.sample(tokens, 40)] + [(a, a) for a in first[:3000]]
    for a, b in pairs:
        if model.merge(bpe.symbols(a)) == [a] and model.merge(bpe.symbols(b)) == [b]:
            assert model.stay_apart(a, b) == (model.merge(bpe.symbols(a) + bpe.symbols(b)) == [a, b]), (a, b)
    for _ in range(40):
        small = small_model(tmp_path, rng, "ab", 12)
        for a in small.vocab:
            for b in small.vocab:
                if not a.endswith(bpe.END):
                    assert small.stay_apart(a, b) == (small.merge(bpe.symbols(a) + bpe.symbols(b)) == [a, b]), (a, b)


def test_lookahead_suffices_for_random_merge_lists(tmp_path):
    rng = random.Random(4)
    for _ in range(60):
        model = small_model(tmp_path, rng)
        for n in (1, 2, 7, 40, 300):
            for _ in range(6):
                word = "".join(rng.choices("aab" if rng.random() < 0.5 else "abc", k=n))
                assert fed(model, word, rng, 9) == merged(model, word)


def test_tokens_come_before_the_end_of_the_piece():
    model = bpe.load(bpe.tokenizer_path(NAME))
    machine = bpe.Transducer(model)
    got = sum(len(machine.feed("aab" * 10)) for _ in range(200))
    assert got > 0 and len(machine.window) <= 4 * model.lookahead


def test_every_piece_goes_through_the_transducer(monkeypatch):
    model, fed_ = bpe.Bpe(bpe.tokenizer_path(NAME)), []
    feed = bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, part, ended=False: fed_.append(part) or feed(self, part, ended))
    text = "Plain words, 42 plain words's é " + "long" * 50_000
    ids = b"".join(model.encode(text))
    pieces = {"plain", "words", ",", "4", "2", "'s", "\u00c3\u00a9".replace("\u00c3", model.alphabet[0xC3]).replace("\u00a9", model.alphabet[0xA9])}
    assert pieces <= set(fed_) and sum(map(len, fed_)) >= 200_000 and len(fed_) < 20
    assert len(ids) > 4 * 50_000


def test_slices_without_white_space_equal_library(monkeypatch, library):
    monkeypatch.setattr(bpe, "SLICE", 50)
    rng = random.Random(7)
    alphabets = ["abcdefghij", "abc'stREllve", "0123456789", "!?.,'-", "éàüßΣσς中文", "한글각", "e\u0301a\u0308\u0323", "\t\x1c\u2028 ", "\u1112\u1161\u11ab"]
    for _ in range(300):
        text = "".join("".join(rng.choices(rng.choice(alphabets), k=rng.choice([1, 3, 20, 90]))) for _ in range(rng.choice([2, 8, 30])))
        assert np.frombuffer(b"".join(bpe.load(bpe.tokenizer_path(NAME)).encode(text)), "<u4").tolist() == ids_of(library, text), repr(text)
        assert "".join(x for x, _ in bpe.slices(text)) == text


def test_memory_does_not_grow_with_a_piece():
    model = bpe.load(bpe.tokenizer_path(NAME))

    def most(n):
        text = "abcdefghijklmnopqrstuvwxy" * n
        tracemalloc.start()
        for _ in model.encode(text):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    most(4000)
    assert most(40_000) < most(8000) + 300_000


def test_incremental_decoder_is_the_same_for_any_cuts():
    model, rng = bpe.load(bpe.tokenizer_path(NAME)), random.Random(2)
    ids = np.frombuffer(b"".join(model.encode("naïve 中文 🙂🙂 plain words, 42!")), "<u4").tolist()
    for written in (True, False):
        whole = bpe.Decoder(model, written)
        want = whole.feed(ids) + whole.finish()
        for _ in range(10):
            d, at, out = bpe.Decoder(model, written), 0, ""
            while at < len(ids):
                step = rng.randrange(1, 4)
                out += d.feed(ids[at : at + step])
                at += step
            assert out + d.finish() == want
    assert "naïve 中文 🙂🙂 plain words , 4 2 !" in want


def test_op8_reads_back_what_the_library_encodes(spark, library):
    rows = [(i * 7 % 200, t) for i, t in enumerate(texts(8))] + [(None, "no id")]
    frame = spark.createDataFrame([(i, t, "", "", "", "") for i, t in rows], DOCS)
    got = sorted(rans.token_digests(frame).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)

    def row(i, t):
        ids = [*ids_of(library, t), rans.END_ID]
        return i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))

    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted((row(i, t) for i, t in rows), key=str)
    assert rans.token_digests(spark.createDataFrame([], DOCS)).collect() == []


def test_op8_files_hold_the_ids(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(9))]
    folder = new_dir(spark, "tokens")
    files = rans.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, file_bytes=4000)
    assert files.count() > 5
    for r in rans.read_tokens(spark, folder).collect():
        assert r.ids == [*ids_of(library, rows[r.doc_id][1]), rans.END_ID]


def test_blocks_decode_alone_and_damage_is_found():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 5 * rans.BLOCK + 77) % 49_000
    data = rans.pack([1, None], np.array([100, len(ids) - 100]), ids.astype(np.uint32))
    file = rans.File(data)
    assert (file.ids() == ids).all()
    for k in range(6):
        assert (file.ids(k, k + 1) == ids[k * rans.BLOCK : (k + 1) * rans.BLOCK]).all()
    assert len(data) < 2.2 * len(ids) and file.valid.tolist() == [True, False]
    broken = bytearray(data)
    broken[-100] ^= 1
    with pytest.raises(ValueError):
        rans.File(bytes(broken))
    with pytest.raises(ValueError):
        rans.File(b"other" + data)
    for few in ([], [3], [3] * 40_000):
        one = np.array(few, np.uint32)
        assert (rans.File(rans.pack([0], np.array([len(one)]), one)).ids() == one).all()
