"""Jump consistent hash sharding (op4) against the published loop."""

import zlib
from collections import defaultdict

import pytest
from brute import jump
from pyspark.sql import functions as F

from hammerfield.llm.sharding import assign_shards, jump_shard, write_shards

DOCS = "doc_id long, text string, shard string, size string, number string, piece string"
KEYS = [*range(-40, 400), 1 << 40, (1 << 63) - 1, -(1 << 63), 123456789012345]


def test_equals_published_loop(spark):
    frame = spark.createDataFrame([(k,) for k in KEYS], "k long")
    for n in (1, 2, 24, 25, 100):
        assert all(r.s == jump(r.k, n) for r in frame.select("k", jump_shard(F.col("k"), n).alias("s")).collect())
    with pytest.raises(ValueError):
        jump_shard(F.col("k"), 0)


def test_rows_of_the_contract(spark):
    rows = [(k, t, "a", "b", "c", "d") for k, t in zip(KEYS, ["x", None, "", "é中", "long " * 9000] * 100)] + [(None, "n", "", "", "", ""), (3, "x", "", "", "", ""), (3, "x", "", "", "", "")]
    got = assign_shards(spark.createDataFrame(rows, DOCS), 24).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.shard == jump(r.doc_id or 0, 24) and r.grown_shard in (r.shard, 24)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    one = sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got)
    assert one == sorted((k or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in rows)


def test_empty_table_and_files(spark, tmp_path):
    assert assign_shards(spark.createDataFrame([], DOCS), 24).collect() == []
    frame = spark.createDataFrame([(k, str(k)) for k in range(50)], "doc_id long, text string")
    write_shards(frame, f"file://{tmp_path}/out", 5)
    back = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(r.doc_id for r in back) == list(range(50)) and all(r.shard == jump(r.doc_id, 5) for r in back)
