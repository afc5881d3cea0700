"""Embedded payloads against Python's JSON reader and a plain walk."""

import json
import random

from pyspark.sql import functions as F

from hammerfield.sources import payloads as P


def walk(value, key):
    """Every object that has the key."""
    if isinstance(value, dict):
        if key in value:
            yield value
        for child in value.values():
            yield from walk(child, key)
    elif isinstance(value, list):
        for child in value:
            yield from walk(child, key)


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([1, "wanted", None, True, 2.5, "x\"y\\z\n", [], {}, "é中"])
    if rng.random() < 0.5:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(0, 4))]
    return {rng.choice(["a", "b", "wanted", "c d", "Wanted"]): tree(rng, depth - 1) for _ in range(rng.randrange(0, 4))}


def test_objects_at_any_depth_equal_a_plain_walk(spark):
    rng = random.Random(8)
    trees = [tree(rng, rng.randrange(0, 9)) for _ in range(150)] + [{"wanted": {"wanted": [{"wanted": 1}]}}]
    texts = [json.dumps(t) for t in trees] + ["no json", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, json string")
    got = {}
    for r in P.objects_with(frame, "wanted").select("i", F.to_json("object").alias("o")).collect():
        got.setdefault(r.i, []).append(json.dumps(json.loads(r.o), sort_keys=True))
    for i, t in enumerate(trees):
        assert sorted(got.get(i, [])) == sorted(json.dumps(o, sort_keys=True) for o in walk(t, "wanted")), texts[i]
    assert P.objects_with(frame.filter("i < 0"), "wanted").collect() == []


def test_containers_are_whole(spark):
    cases = {'{"a":1}': True, "[1]": True, " [] ": True, '"a":1}': False, '"text"': False, "1": False, "[1]]": False, "[1]}": False, '{"a":1},{"b":2}': False, '{"a":1': False, "": False, '[1] x': False}
    got = {r.t: r.w for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", P.is_container(F.col("t")).alias("w")).collect()}
    assert got == cases


def test_chunks_are_joined_wherever_they_are_cut(spark):
    value = {"auctionData": {"data": [{"_index": "x", "_source": {"id": 7, "t": 'a "quoted" \\ line\n2 15:[1]'}}]}}
    push = lambda s: f"<script>self.__next_f.push([1,{json.dumps(s)}])</script>"
    row = "1f:" + json.dumps(["$", "L", None, value])
    pages = [(k, "<p>" + push('0:I["m"]\n') + push(row[:k]) + push(row[k:]) + push('2:{"o":1}') + "</p>") for k in range(1, len(row), 7)]
    pages += [(10_000, push(row) + push(row)), (10_001, push(row[:30]) + push('2:["lost"]')), (10_002, None), (10_003, "<p>self.__next_f.push([1,x])</p>"), (10_004, push(row.replace('"x"', '"y"')))]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    got = P.embedded_records(frame, "auctionData", "x", {"id": "$.id", "t": "$.t"}).collect()
    assert sorted((r.page_id, r.id, r.t) for r in got) == [(k, "7", 'a "quoted" \\ line\n2 15:[1]') for k, _ in pages if k <= 10_000]
