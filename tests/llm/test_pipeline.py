"""The pipeline's stages and its whole run against brute force, on a small folder of tables."""

import hashlib
import random
import struct

import pytest
from brute import components, edit_words, jaccard_links, repeated, stretch_distance, words
from tokenizers import Tokenizer

import corpus_pipeline
from hammerfield.llm import bpe, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def tables():
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("ba", "do", "ri", "ne", "ka", "lu") for b in ("tan", "mer", "sol", "vik", "pra", "nod", "gim")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, prose(20)) for i in range(10)]
    passage = prose(60)
    texts = [prose(rng.randrange(5, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " tail", prose(150) + " " + passage, passage + " " + prose(90), prose(30) + " " + items[2][1] + " " + prose(40), None, "", prose(20_000)]
    junk = [" ".join(rng.choice(["#$%@", "!!!! ????", "0x0x 1111"]) for _ in range(rng.randrange(4, 40))) for _ in range(40)]
    docs = [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts + junk)]
    alone = prose(50)
    leaked = prose(25) + " " + items[4][1] + " " + prose(25)
    docs += [docs[5], docs[5], (None, texts[7], "en", "src", len(texts[7])), (None, alone, "en", "src", len(alone)), (None, leaked, "en", "src", len(leaked))]
    docs += [(8, prose(70), "en", "src", 1), (8, texts[8], "en", "src", 1), (8, None, "en", "src", None), (None, None, "en", "src", None), (None, None, "en", "src", None)]
    labels = [(i, int(i < len(texts)), 0) for i in range(len(texts + junk)) if i % 4 and texts + junk != [] and (texts + junk)[i]]
    return docs, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items, labels = tables()
    out = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def row_key(d):
    return hashlib.md5(("" if d[0] is None else str(d[0])).encode() + (b"" if d[1] is None else b" " + d[1].encode())).hexdigest()


def brute(spark, folder):
    docs, items, labels = tables()
    table = spark.read.parquet(f"{folder}/labels.parquet")
    seen = table.filter(quality.remainder(table["doc_id"], 4) != 2).selectExpr("doc_id", "quality AS label")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {(r.doc_id, r.text): r.score for r in quality.score(frame, quality.fit(frame, seen)).collect()}
    # rows are judged one by one: those equal in id and text are one, and an id may stand for several texts
    left = [d for d in docs if scores[d[0], d[1]] >= 0.7]
    blank = [d for d in left if not words(d[1])]
    rows = sorted({d for d in left if words(d[1])}, key=lambda d: (d[0] is None, d[0] or 0, row_key(d)))
    least = components(range(len(rows)), jaccard_links([(i, d[1]) for i, d in enumerate(rows)], 5, 80, 100))
    left = blank + [d for i, d in enumerate(rows) if least[i] == i]
    raw = [(d[1] or "").encode() for d in left]
    left = [(d[0], None if d[1] is None else bytes(b for b, x in zip(t, c) if not x).decode()) for d, t, c in zip(left, raw, repeated(raw, 200))]
    leaks = lambda w: any(stretch_distance(edit_words(x), w)[0] <= int(0.2 * len(edit_words(x)) + 1e-9) for _, x in items)
    left = [d for d in left if not leaks(edit_words(d[1]))]
    library = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    out = []
    for i, t in left:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_run_equals_brute_force(spark, folder):
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = brute(spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert 40 < len(want) < 70


def test_stages_take_empty_tables_and_return_the_columns(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "leaks", "tokens"]
    empty = spark.createDataFrame([], COLUMNS)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, empty, folder)
        assert out.collect() == []
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS


def test_clean_documents_stay(spark, folder):
    docs, _, _ = tables()
    frame = spark.createDataFrame([d for d in docs if d[0] is not None and 10 <= d[0] < 40], COLUMNS)
    for _, f in corpus_pipeline.STAGES[1:4]:
        assert sorted(map(tuple, f(spark, frame, folder).collect())) == sorted(map(tuple, frame.collect()))
