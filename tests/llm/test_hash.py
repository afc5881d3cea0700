"""Words that a polynomial modulo 2^64 cannot tell apart are told apart by every operator that names words by hashes."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from hammerfield.llm import bpe, decontam, jaccard, ppm, quality, rans
from hammerfield.llm import textops as X

_T = ["a", "b"]
for _ in range(10):
    _T = [_T[0] + _T[1], _T[1] + _T[0]]
ONE, OTHER = _T


def raw(*texts):
    return X.text_bytes(pa.array(texts))


def test_spans_of_equal_bytes_alone_have_equal_hashes():
    data, off = raw(ONE + OTHER + ONE)
    h = X.block_hash(data, off[:1] + np.array([0, 1024, 2048]), off[:1] + np.array([1024, 2048, 3072]))
    assert h[0] == h[2] != h[1]
    body = np.frombuffer(b"\0\0abc\0abc\0", np.uint8)
    s, e = np.array([0, 0, 0, 2, 6, 2, 5]), np.array([0, 1, 2, 5, 9, 6, 6])
    h = X.block_hash(body, s, e).tolist()
    assert h[3] == h[4] and h[1] == h[6] and len(set(h)) == 5
    assert not set(h) & set(X.block_hash(body, s, e, 1 << 32).tolist())
    assert len(X.block_hash(body, s[:0], e[:0])) == 0


def test_words_of_each_operator_differ():
    data, off = raw(f"{ONE} {OTHER} {ONE}")
    for hashes in (X.word_hashes, decontam.word_hashes, ppm.word_keys):
        h = hashes(data, off)[0]
        assert h[0] == h[2] != h[1]
    b, _ = quality.buckets(*raw(f"{ONE} {OTHER}"))
    assert b[0] != b[1]


def test_encoder_equals_the_library():
    path = bpe.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [f"x {ONE} y", f"x {OTHER} y", ONE, OTHER, ""]
    encode = rans.Encoder(path)
    for _ in range(2):
        ids, count = encode(*raw(*texts))
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    plain, sizes = encode._plainly(*raw(*texts))
    assert plain.tolist() == ids.tolist() and sizes.tolist() == count.tolist()


def test_encoder_falls_back_where_one_key_stands_for_two_words(monkeypatch):
    path = bpe.tokenizer_path("word_bpe_49k.json")
    real = X.block_hash
    monkeypatch.setattr(rans.X, "block_hash", lambda r, s, e, salt=0: real(r, s, e, salt) if salt else np.zeros(len(s), np.uint64))
    library = Tokenizer.from_file(path)
    texts = ["one two", "two one three"]
    ids, count = rans.Encoder(path)(*raw(*texts))
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and count.sum() == len(ids)


def test_joins_keep_both_words_apart(spark):
    pad = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{pad} {ONE}"), (2, f"{pad} {OTHER}"), (3, ONE), (4, OTHER), (5, ONE)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, k=3, num=99, den=100).collect()}
    assert got == {1: (11, 1), 2: (11, 2), 3: (1, 3), 4: (1, 4), 5: (1, 3)}
    items = spark.createDataFrame([(7, f"{ONE} {ONE} {ONE} {ONE} {ONE}")], "item_id long, text string")
    held = spark.createDataFrame([(1, " ".join([ONE] * 5)), (2, " ".join([OTHER] * 5))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(held, items).collect()] == [(1, 7, 0)]
    scored = {r.doc_id: r.n_known for r in ppm.score_documents(spark.createDataFrame([(1, f"{ONE} k"), (8, f"{OTHER} k"), (10, f"{ONE} k")], "doc_id long, text string")).collect()}
    assert len(scored) == 3
