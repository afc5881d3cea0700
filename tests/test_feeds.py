"""Streams that resume, refuse changed files, and agree with the batch."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_health import GOOD, RUNS, START, random_runs

from hammerfield.operators import health as H
from hammerfield.operators import quality as Q
from hammerfield.sources.feed import FeedReader, outcome_of
from hammerfield.streaming import feeds as S
from hammerfield.streaming import ticks as T


def lines(a, b):
    return "".join(json.dumps({"id": k}) + "\n" for k in range(a, b))


def imported(spark, home):
    return sorted((r.file, r.n, r.outcome, r.record) for r in spark.read.parquet(f"file://{home}/out").collect())


def test_two_runs_over_a_growing_folder_equal_one(spark, tmp_path):
    feed = tmp_path / "feed"
    (feed / "sub").mkdir(parents=True)
    run = lambda: S.import_feed(S.read_feed(spark, f"file://{feed}", f"file://{tmp_path}/cursor/c", 4), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    (feed / "a.jsonl").write_text(lines(0, 10) + "\nno json\n[1]\n")
    (feed / "sub" / "b.jsonl").write_text(lines(0, 3) + '{"id": 3')
    (feed / "_skip").write_text("x\n")
    run()
    first = imported(spark, tmp_path)
    assert len(first) == 15 and ("a.jsonl", 11, "invalid", None) in first and len(spark.read.parquet(f"file://{tmp_path}/out").select("batch").distinct().collect()) >= 3
    with (feed / "sub" / "b.jsonl").open("a") as f:
        f.write("}\n" + lines(4, 9))
    (feed / "c.jsonl").write_text(lines(0, 1))
    run()
    both = imported(spark, tmp_path)
    assert len(both) == len(set(both)) == 22
    for name, n in (("sub/b.jsonl", 9), ("a.jsonl", 10), ("c.jsonl", 1)):
        assert [(r[1], json.loads(r[3])["id"]) for r in both if r[0] == name and r[2] == "ok"] == [(k + 1, k) for k in range(n)]
    text = (feed / "a.jsonl").read_text()
    (feed / "a.jsonl").write_text(text.replace('"id": 5', '"id": 6', 1) + lines(10, 11))
    with pytest.raises(Exception, match="has changed"):
        run()
    assert imported(spark, tmp_path) == both


def test_offsets(tmp_path):
    (tmp_path / "a").write_text("{}\n{}\n\n{}\n")
    reader = lambda: FeedReader(f"file://{tmp_path}", f"file://{tmp_path}/.cursor", 2)
    r = reader()
    one, two, same = r.latestOffset(), None, None
    two = r.latestOffset()
    same = r.latestOffset()
    assert [o["a"]["records"] for o in (one, two, same)] == [2, 3, 3] and two == same
    assert [(p.start, p.end, p.first, p.records) for p in r.partitions({}, one) + r.partitions(one, two)] == [(0, 6, 1, 2), (6, 10, 3, 1)]
    assert [x[1] for p in r.partitions({}, two) for x in r.read(p)] == [1, 2, 3]
    r.commit(one)
    assert reader().latestOffset()["a"]["records"] == 3  # goes on from the cursor
    (tmp_path / "a").write_text("{}\n")
    with pytest.raises(ValueError, match="shorter"):
        reader().latestOffset()
    with pytest.raises(ValueError, match="shorter"):
        reader().partitions({}, two)
    (tmp_path / "a").unlink()
    with pytest.raises(ValueError, match="gone"):
        reader().latestOffset()
    assert outcome_of(b'{"a": 1} ') == ("ok", '{"a": 1}') and outcome_of(b"\xff") == outcome_of(b"3") == ("invalid", None)


def in_order(spark, frame, path, parts, by):
    """The rows as files, in order of time, one after another."""
    n = frame.count()
    numbered = frame.toPandas().sort_values([*by]).reset_index(drop=True)
    for k in range(parts):
        part = numbered.iloc[k * n // parts : (k + 1) * n // parts]
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_health_stream_equals_the_batch(spark, tmp_path):
    runs = random_runs(12, 240)
    table = [(i, s, t, *({**dict.fromkeys(H.RUN), **GOOD, **change}[c] for c in H.RUN)) for i, (s, t, change) in enumerate(runs)]
    begin = START + timedelta(days=130)
    # a collapse whose request nobody answers: only a timer can tell
    alone = [(1000 + k, "alone", begin + timedelta(days=k), {**dict.fromkeys(H.RUN), **GOOD, "records": 1000.0 if k < 5 else 10.0}) for k in range(6)]
    table += [(i, s, t, *(run[c] for c in H.RUN)) for i, s, t, run in alone]
    table += [(2000, "later", begin + timedelta(days=20), *({**dict.fromkeys(H.RUN), **GOOD}[c] for c in H.RUN)), (2001, "later", begin + timedelta(days=21), *({**dict.fromkeys(H.RUN), **GOOD}[c] for c in H.RUN))]
    frame = spark.createDataFrame(table, RUNS)
    path = f"file://{tmp_path}/runs"
    in_order(spark, frame, path, 5, ["started_at", "id"])
    got = T.run_ticks(S.health_stream(stream_of(spark, path, frame.schema)), "health").drop("tick").collect()
    want = H.source_health(frame).collect()
    assert sorted(map(tuple, (r for r in got if r.id is not None))) == sorted(map(tuple, want))
    late = [r for r in got if r.id is None]
    assert {r.action for r in late} == {"OVERDUE"}
    assert [r.started_at for r in late if r.source == "alone"] == [begin + timedelta(days=6, milliseconds=1)]


def test_sightings_placed_by_a_stream_give_the_same_sweep(spark, tmp_path):
    import random

    rng = random.Random(7)
    at = lambda h: START + timedelta(hours=h)
    passes = [(s, at(h), at(h + rng.choice([1, 3, 5])), "HEALTHY", True) for s in "ab" for h in range(5, 200, 6)]
    sightings = [(s, f"i{k}", at(h + rng.random())) for s in "ab" for k in range(25) for h in range(200) if rng.random() < (0.5 if k < 22 else 0.02)]
    seen = spark.createDataFrame(sightings, "source string, item string, seen_at timestamp_ntz")
    done = spark.createDataFrame(passes, "source string, pass_at timestamp_ntz, done_at timestamp_ntz, verdict string, complete boolean")
    want = sorted(map(tuple, Q.last_seen_sweep(seen, done).collect()))
    # a last row of each side lets the watermark pass the others
    end = at(1000)
    instants = lambda f, *cols: f.withColumns({c: F.col(c).cast("timestamp") for c in cols})
    more_seen = instants(seen.unionByName(spark.createDataFrame([("z", "end", end)], seen.schema)), "seen_at")
    more_done = instants(done.unionByName(spark.createDataFrame([("z", end, end, "HEALTHY", True)], done.schema)), "pass_at", "done_at")
    in_order(spark, more_seen, f"file://{tmp_path}/seen", 4, ["seen_at"])
    in_order(spark, more_done, f"file://{tmp_path}/done", 4, ["done_at"])
    joined = S.placed_sightings(stream_of(spark, f"file://{tmp_path}/seen", more_seen.schema), stream_of(spark, f"file://{tmp_path}/done", more_done.schema))
    placed = T.run_ticks(joined, "placed", "append").drop("tick").filter("source <> 'z'").cache()
    assert placed.count() == len(sightings)
    inside = {(s, i, t) for s, i, t in sightings if any(p[0] == s and p[1] <= t <= p[2] for p in passes)}
    assert {(r.source, r.item, r.seen_at) for r in placed.filter("pass_at IS NOT NULL").collect()} == inside
    got = Q.last_seen_sweep(placed.select("source", "item", F.col("seen_at").cast("timestamp_ntz").alias("seen_at")), done)
    assert sorted(map(tuple, got.collect())) == want
    assert datetime.min < end


def test_the_sweep_of_the_stream_follows_where_the_stream_has_placed_sightings(spark, monkeypatch):
    from hammerfield.plans.registry import QUERIES, load

    load()
    sf = "/root/testdata/sf0.001"
    rows = lambda name: {(r.source, r.item): r.missed for r in QUERIES[name](spark, sf).collect()}
    whole = rows("st25_last_seen")
    assert rows("st25_last_seen_stream") == whole
    real = S.placed_sightings
    nowhere = lambda *a, **b: real(*a, **b).withColumns({c: F.when(F.col("source") < "src4", F.col(c)) for c in ("pass_at", "done_at")})
    monkeypatch.setattr(S, "placed_sightings", nowhere)
    got = rows("st25_last_seen_stream")
    changed = {k[0] for k in whole if got[k] != whole[k]}
    assert got.keys() == whole.keys() and changed and min(changed) >= "src4"
