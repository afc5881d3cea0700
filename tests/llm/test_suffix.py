"""Removal of repeated byte strings (op3) against brute force."""

import hashlib
import random

from brute import repeated, spans

from hammerfield.llm.suffix import cut_repeats, extents, intervals, remove_repeats, repeat_groups

DOCS = "doc_id long, text string, k1 string, place string, spans string, _id string, n_chars int"


def rows_of(texts):
    return [(i, t, "a", "b", "c", "d", None if t is None else len(t)) for i, t in enumerate(texts)]


def want(texts, least):
    raw = [(t or "").encode() for t in texts]
    out = []
    for i, (t, c) in enumerate(zip(raw, repeated(raw, least))):
        kept = bytes(b for b, x in zip(t, c) if not x)
        out.append((i, len(t), sum(c), len(spans(c)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, alphabet, least):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices(alphabet, k=n))
    shared = [noise(least + d) for d in (-1, 0, 1, 7, 150)]
    out = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [noise(rng.randrange(3 * least)), rng.choice(shared)]
        out.append("".join(parts))
    out += [out[3], out[3], None, "", "", "a" * (3 * least), "ab" * least, shared[4][:-20], shared[4][5:] + noise(5), noise(10 * least) + shared[2]]
    return out


def test_equals_brute_force(spark):
    for least, gram, alphabet in ((24, 8, "ab"), (30, 10, "abcdefgh é中"), (200, 64, "abcdefghij ")):
        texts = corpus(least, alphabet, least)
        got = remove_repeats(spark.createDataFrame(rows_of(texts), DOCS), least, gram)
        assert sorted(map(tuple, got.collect())) == want(texts, least)


def test_crowded_grams_give_the_same(spark):
    texts = corpus(5, "abc", 24)
    for crowd in (1, 5):
        got = remove_repeats(spark.createDataFrame(rows_of(texts), DOCS), 24, 8, crowd=crowd)
        assert sorted(map(tuple, got.collect())) == want(texts, 24)


def test_groups_have_all_occurrences(spark):
    for crowd, alphabet in ((1 << 20, "abc"), (3, "ab"), (1 << 20, "abcdefgh é中")):
        texts = corpus(6, alphabet, 24)
        raw = [(t or "").encode() for t in texts]
        found = {}
        for r in repeat_groups(spark.createDataFrame(rows_of(texts), DOCS), 24, 8, crowd=crowd).collect():
            assert r.n_bytes == r.last - r.first >= 24
            found.setdefault((r.name, raw[r.doc_id][r.first : r.last]), set()).add((r.doc_id, r.first))
        assert len({name for name, _ in found}) == len(found) > 20
        covered = [bytearray(len(t)) for t in raw]
        for (_, text), places in found.items():
            every = {(i, k) for i, t in enumerate(raw) for k in range(len(t)) if t.startswith(text, k)}
            assert places == every and len(every) > 1
            for i, k in every:
                covered[i][k : k + len(text)] = b"\1" * len(text)
        assert covered == repeated(raw, 24)


def test_groups_of_nothing(spark):
    assert repeat_groups(spark.createDataFrame([], DOCS)).collect() == []
    assert repeat_groups(spark.createDataFrame(rows_of(["abc", None, "x" * 199]), DOCS)).collect() == []


def test_very_long_text(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdef ", k=700))
    long = "".join(rng.choices("abcdefghijklmnopq ", k=1_200_000)) + passage
    texts = [long, passage[100:600], "q" * 199, "q" * 199]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert (got[0].n_removed, got[0].n_spans) == (500, 1)
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (500, 0, 0)


def test_nothing_and_null_ids(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    text = "z" + "".join(map(str, range(200)))
    frame = spark.createDataFrame([(None, text, "", "", "", "", 1), (None, text, "", "", "", "", 1), (4, None, "", "", "", "", None)], DOCS)
    got = remove_repeats(frame).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(False, 0, 0, 0), (True, len(text), len(text), 1), (True, len(text), len(text), 1)]


def test_cut_keeps_columns_and_whole_characters(spark):
    texts = corpus(11, "abé中", 30)
    got = cut_repeats(spark.createDataFrame(rows_of(texts), DOCS), 30, 10)
    assert got.columns == ["doc_id", "text", "k1", "place", "spans", "_id", "n_chars"]
    raw = [(t or "").encode() for t in texts]
    covered = repeated(raw, 30)
    for r in got.collect():
        assert (r.k1, r.place, r.spans, r._id) == ("a", "b", "c", "d")
        if texts[r.doc_id] is None:
            assert r.text is None
            continue
        expected, at = "", 0
        for c in texts[r.doc_id]:
            n = len(c.encode())
            expected += "" if all(covered[r.doc_id][at : at + n]) else c
            at += n
        assert r.text == expected and r.n_chars == len(expected)


def test_intervals_and_groups():
    assert sorted(intervals(__import__("numpy").array([2, 2, 0, 3]))) == [(0, 0, 4), (2, 0, 2), (3, 3, 4)]
    left, right = [b"xab", b"yab", b"zb", b"qab"], [b"cdefg", b"cdefh", b"cdexx", b"cd"]
    _, _, groups = extents(left, right, 5)
    found = {(reach, length, tuple(sorted(m))) for reach, length, m in groups}
    assert (2, 4, (0, 1)) in found  # "ab" + "cdef"
    assert extents(left, right, 5, False)[2] == [] and all((a == b).all() for a, b in zip(extents(left, right, 5)[:2], extents(left, right, 5, False)[:2]))
    far_left, far_right, _ = extents(left, right, 100)
    assert not far_left.any() and not far_right.any()
