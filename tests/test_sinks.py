"""Publishing all or nothing, distances and phrases against plain loops, counters and samples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hammerfield.operators import geo, ingest, pages, phrases
from hammerfield.sources import sinks


def names(path):
    return sorted(p.name for p in (path / "files").iterdir())


def test_a_failed_job_leaves_the_last_version(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.range(0, 100, 1, 4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("body"), F.lit(1).alias("more"))
    sinks.publish(rows, path, head="<", join=",", tail=">", most=10, suffix="x")
    first = sinks.manifest(path)
    assert first["rows"] == 100 and len(first["files"]) == 12 and [f["file"] for f in first["files"]] == names(tmp_path / "out")

    def fail(batches):
        from pyspark import TaskContext

        for k, batch in enumerate(batches):
            if TaskContext.get().partitionId() == 2:
                raise RuntimeError("lost")
            yield batch

    with pytest.raises(Exception, match="lost"):
        sinks.publish(rows.mapInArrow(fail, rows.schema), path, most=10)
    assert sinks.manifest(path) == first and {f["file"] for f in first["files"]} <= set(names(tmp_path / "out"))
    got = [b for r in sinks.published(spark, path).collect() for b in r.text.strip("<>").split(",")]
    assert sorted(got) == sorted(f"r{k}" for k in range(100)) and all(r.text[0] == "<" and r.text[-1] == ">" for r in sinks.published(spark, path).collect())
    sinks.publish(rows.filter("body = 'r7'").unionByName(rows.limit(1).select(F.lit(None).cast("string").alias("body"), "more")), path)
    assert sinks.manifest(path)["rows"] == 1 and len(names(tmp_path / "out")) == 1
    sinks.publish(rows.filter("false"), path)
    assert sinks.manifest(path) == {"files": [], "rows": 0} and sinks.published(spark, path).collect() == []
    assert sinks.manifest(f"file://{tmp_path}/none") == {"files": [], "rows": 0}


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_distances_equal_all_pairs(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]
    points += [(200 + i, rng.choice([89.5, -89.9, 60.0, 0.0]) + rng.uniform(-0.4, 0.4), rng.choice([179.9, -179.9, 0.0, 540.0]) + rng.uniform(-0.6, 0.6)) for i in range(150)]
    points += [(400, 90.0, 12.0), (401, 90.0, -100.0), (402, None, 1.0), (403, 1.0, None), (400, 90.0, 12.0)]
    frame = spark.createDataFrame(points, "id int, lat double, lng double")
    for limit in (65, 900):
        got = sorted((r.a, r.b) for r in geo.within_distance(frame, limit).collect())
        want = sorted((min(p[0], q[0]), max(p[0], q[0])) for i, p in enumerate(points) for q in points[i + 1 :] if None not in (*p, *q) and p[0] != q[0] and km(p[1:], q[1:]) < limit)
        assert got == want and want
    cells = geo.within_distance(frame, 65)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in cells and "BroadcastNestedLoopJoin" not in cells


def test_phrases_equal_a_plain_scan(spark):
    rng = random.Random(3)
    vocabulary = ["new", "delhi", "navi", "mumbai", "road", "mira", "a", "b"]
    names_ = sorted({" ".join(rng.choices(vocabulary, k=rng.randrange(1, 4))) for _ in range(25)})
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))) for _ in range(60)] + [None, "", "NEW-Delhi, & Navi!"]
    table = phrases.phrase_table(spark.createDataFrame([(n, n, i) for i, n in enumerate(names_)], "phrase string, name string, rank int"))
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = []
    for i, t in enumerate(texts):
        words = "".join(c.lower() if c.isalnum() or c == "&" else " " for c in (t or "")).split()
        plain += [(i, k, len(n.split()), n) for k in range(len(words)) for n in names_ if words[k : k + len(n.split())] == n.split()]
    assert sorted((r.id, r.start, r.n, r.name) for r in phrases.find_phrases(frame, table, 3).collect()) == sorted(plain)
    best = {(i, k): max(m for j, at, m, _ in plain if (j, at) == (i, k)) for i, k, _, _ in plain}
    assert sorted((r.id, r.start, r.n) for r in phrases.find_phrases(frame, table, 3, longest=True).collect()) == sorted((i, k, m) for (i, k), m in best.items())


def test_location_evidence_at_its_borders(spark):
    cases = [
        (("Kerala", None, "Pune", None, None, None), "reject", [], ['the property\'s state is "Kerala"']),
        ((" maharashtra ", None, None, None, None, "560001"), "review", ["state field says Maharashtra"], ["PIN 560001 is not a Maharashtra PIN but other evidence says Maharashtra"]),
        ((None, None, "Navi-Mumbai, East", None, "Pin code 403 001", None), "review", ['district / city "navi mumbai" is in Maharashtra'], ["PIN 403001 is not a Maharashtra PIN but other evidence says Maharashtra"]),
        ((None, None, "Aurangabad", None, None, "431001"), "accept", ["PIN 431001 is a Maharashtra PIN", '"aurangabad" is ambiguous but the PIN settles it'], []),
        ((None, None, "Aurangabad", None, None, None), "review", [], ['"aurangabad" exists in more than one state and no state or PIN settles it']),
        ((None, None, None, None, "Plot in Tamil  Nadu and Goa", None), "reject", [], ["the address names Goa, Tamil Nadu and not Maharashtra"]),
        ((None, None, None, None, "Tamil, Nadu", None), "review", [], ["the location text does not name a Maharashtra district, city or state, and there is no state field or PIN code"]),
        ((None, None, "", " ", None, None), "review", [], ["no location evidence"]),
        ((None, "Thane", None, None, "near Pune", None), "accept", ['district / city "thane" is in Maharashtra'], []),
    ]
    frame = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "id int, state string, district string, city string, area string, address string, pin string")
    got = {r.id: (r.verdict, r.basis, r.reasons) for r in phrases.location_evidence(frame).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_counters_equal_a_second_pass(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("row"), F.expr("CASE id % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'enrich' WHEN 2 THEN 'skip: no key' WHEN 3 THEN 'round' WHEN 4 THEN 'repeated' END").alias("outcome"))
    got = ingest.import_counted(rows, f"file://{tmp_path}/o")
    again = {r.o: r.n for r in spark.read.parquet(f"file://{tmp_path}/o").groupBy(F.split_part("outcome", F.lit(":"), F.lit(1)).alias("o")).agg(F.count("*").alias("n")).collect()}
    assert got == {"rows": 1000} | {k: v for k, v in again.items() if k}


def test_shapes_have_the_same_sample_however_rows_are_dealt(spark):
    house = "<p>A flat for auction, ₹ 45,00,000</p>"
    rows = [("s", f"/p/{k}", house if k % 2 else "<p>none</p>") for k in range(40)] + [("s", f"/q/{k}", "<p>about</p>") for k in range(5)] + [("s", "/r/1", house), ("s", "/r/2", house)] + [("s", f"/{c}/x/{k}", house) for c in "abcdef" for k in range(4)]
    rows += rows[:10]
    frame = spark.createDataFrame(rows, "site string, url string, html string")
    shape = F.regexp_replace("url", "[0-9]+", "#")
    got = [sorted(map(tuple, pages.shape_verdicts(f, ["site"], shape).collect())) for f in (frame.repartition(1), frame.repartition(7, "url"), frame.orderBy(F.desc("url")))]
    assert got[0] == got[1] == got[2]
    assert {r[1]: r[2] for r in got[0]} == {"/p/#": 40, "/q/#": 5, "/a/x/#": 4, "/b/x/#": 4}
    assert {r[1]: r[4] for r in got[0] if r[1] != "/p/#"} == {"/q/#": False, "/a/x/#": True, "/b/x/#": True}
