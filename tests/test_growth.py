"""Steps whose work must not outgrow their input: their results against plain loops, and the shape of their plans."""

import hashlib
import random
import re
from statistics import median

import pandas as pd

from pyspark.sql import functions as F

from hammerfield.functions import dates as D
from hammerfield.functions.text import SPACE, collapse, first_of_each
from hammerfield.operators import health as H
from hammerfield.operators import notices as N
from hammerfield.operators import phrases as P
from hammerfield.operators import quality as Q
from hammerfield.operators import rollups as R
from hammerfield.plans.registry import QUERIES, load
from hammerfield.sources.details import labelled_values
from hammerfield.sources.feed import FeedReader
from hammerfield.sources.rendered import rendered_records
from hammerfield.streaming import feeds as S

load()
SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_trailing_sums_equal_a_plain_scan(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(-30, 60, 3)]), rng.choice([None, 1, 5, -2])) for i in range(200)] + [(200, "c", 5, None), (201, "c", 15, 4)]
    frame = spark.createDataFrame(rows, "id int, k string, at long, v int")
    got = {r.id: r.used for r in R.trailing_sums(frame, "k", "at", "v", 10).collect()}
    for i, k, at, _ in rows:
        span = [v for _, kk, a, v in rows if kk == k and v is not None and (a is None if at is None else a is not None and at - 10 < a <= at)]
        assert got[i] == (sum(span) if span else None), (i, k, at)


def test_the_budget_has_no_frame_that_is_summed_again_for_each_row(spark):
    assert "RangeFrame" not in plan(QUERIES["ag27_budget"](spark, SF))


def test_token_sets_are_joined_in_tasks_that_the_pairs_need(spark):
    text = plan(QUERIES["so03_token_sets"](spark, SF))
    assert "REPARTITION_BY_NUM" in text and "BroadcastHashJoin" not in text


def test_the_sweep_counts_passes_without_lists_of_them(spark):
    rows = lambda n, *cols: spark.range(n).selectExpr("'s' AS source", *cols)
    seen = rows(40, "cast(id % 3 AS string) AS item", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 7) AS seen_at")
    passes = rows(60, "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 5) AS pass_at", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 5 + 3) AS done_at", "'HEALTHY' AS verdict", "true AS complete")
    swept = Q.last_seen_sweep(seen, passes)
    assert "filter(passes#" not in plan(swept)
    want = {}
    for m in range(3):
        at = [7 * i for i in range(40) if i % 3 == m]
        last = max([t // 5 + 1 for t in at if t % 5 <= 3], default=0)
        n = 0
        for k in range(max(last + 1, 1), 61):
            n += 1
            if n >= 2 and any(t // 5 + 1 == k and t % 5 > 3 for t in at):
                n = 0
        want[str(m)] = n
    assert {r.item: r.missed for r in swept.collect()} == want


def test_sightings_meet_the_passes_of_their_slice_alone(spark):
    at = lambda c: f"timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, {c}) AS"
    seen = spark.range(60).selectExpr("'s' AS source", "cast(id AS string) AS item", f"{at('id * 30')} seen_at")
    done = spark.createDataFrame([("s", 0, 5), ("s", 50, 70), ("s", 100, 900), ("t", 0, 1800), ("s", 1500, 1400)], "source string, a int, b int").selectExpr("source", f"{at('a')} pass_at", f"{at('b')} done_at")
    placed = S.placed_sightings(seen, done)
    assert "place#" in plan(placed)
    spans = [(0, 5), (50, 70), (100, 900)]
    got = {int(r.item): r.pass_at and (r.pass_at.minute * 60 + r.pass_at.second) for r in placed.collect()}
    assert got == {i: next((a for a, b in spans if a <= 30 * i <= b), None) for i in range(60)} and placed.count() == 60


def test_neither_side_of_near_points_is_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(QUERIES["jn14_within_distance"](spark, SF))


def test_no_row_of_the_dictionary_holds_the_phrases_that_begin_alike(spark):
    names = spark.range(500).selectExpr("concat('the w', id, ' x') AS phrase", "id AS name")
    table = P.phrase_table(names)
    assert table.count() == 500
    texts = spark.createDataFrame([(1, "The w7 x the w499 x the w500 x the"), (2, None)], "id int, text string")
    assert sorted((r.id, r.start, r.n, r.name) for r in P.find_phrases(texts, table, 3).collect()) == [(1, 0, 3, 7), (1, 3, 3, 499)]


def test_runs_of_a_source_are_put_in_order_in_stretches():
    rng = random.Random(3)
    rows = [(rng.randrange(40), i, None if rng.random() < 0.2 else float(i % 7), rng.choice([None, True, False])) for i in range(300)]
    rng.shuffle(rows)
    frame = lambda part: pd.DataFrame([{**dict.fromkeys(H.RUN), "id": i, "started_at": pd.Timestamp(at, unit="s"), "records": n, "complete": c} for at, i, n, c in part])
    got = list(S.runs_in_order((frame(rows[k : k + 20]) for k in range(0, 300, 20)), most=50))
    assert [(r["at"] // 1_000_000, r["id"], r["records"], r["complete"]) for r in got] == sorted(rows, key=lambda r: r[:2])
    assert not list(S.runs_in_order(iter(())))


def test_sizes_hold_few_numbers_and_their_median_is_that_of_a_plain_list():
    rng, sizes, rows = random.Random(5), H.Sizes(7), []
    for k in range(5000):
        now = k * H.HOUR // 3
        rows = [(at, v) for at, v in rows if at >= now - 7 * H.DAY]
        assert sizes.at(now).median == (median(v for _, v in rows) if rows else None) and len(sizes) == len(rows)
        if k == 2500:
            sizes = H.Sizes.load(7, *sizes.dump())
        if k % 1700 > 600:
            value = float(rng.choice([rng.randrange(5), rng.randrange(1000)]))
            sizes.add(now, value)
            rows.append((now, value))
    assert len(sizes.times) < 2000 and len(sizes.sorted) == len({v for _, v in rows})


def test_a_line_is_stripped_once_for_all_labels(spark):
    pages = spark.createDataFrame([(1, "u", "", "City:\nPune\nBank Name: A")], "page_id int, url string, html string, text string")
    records = rendered_records(pages)
    assert 0 < records._jdf.queryExecution().analyzed().toString().count(", :$,") < 5
    assert [(r.city, r.bank) for r in records.collect()] == [("Pune", "A")]


def test_a_date_is_searched_once_and_a_table_row_read_once(spark):
    day = spark.range(1).select(D.notice_date(F.upper(F.col("id").cast("string"))).alias("d"))
    assert day._jdf.queryExecution().analyzed().toString().count("upper(") == 1
    row = spark.range(1).select(N._labelled(F.upper(F.col("id").cast("string")), F.array(F.lit("reserve"))).alias("r"))
    assert row._jdf.queryExecution().analyzed().toString().count("(?:st|nd|rd|th)") == 7  # one search and the six parts of what it found


def test_the_first_date_is_that_of_two_plain_searches(spark):
    rng = random.Random(2)
    bits = ["12", "3", "31", "31.02.2026", "1-1-19", "05/11/2030", "2 / 3 / 2024", "12th November 2026", "1st  may, 2031", "30-Sep-2101", "7 jun", "2026", " ", "x", "\n", ".", "-"]
    texts = [None, ""] + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()

    def plain(text):
        a = re.search(r"([0-9]{1,2})[ \n]*[./-][ \n]*([0-9]{1,2})[ \n]*[./-][ \n]*([0-9]{4})", text)
        b = re.search(r"(?i)([0-9]{1,2})(?:st|nd|rd|th)?[ \n-]+(" + "|".join(months) + r")[a-z]*[ \n,.-]+([0-9]{4})", text)
        if not a and not b:
            return None
        numeric = a and (not b or a.start() <= b.start())
        d, m, y = (a if numeric else b).groups()
        at = pd.to_datetime(f"{y}-{int(m) if numeric else months.index(m.lower()) + 1}-{int(d)}", format="%Y-%m-%d", errors="coerce")
        return at.strftime("%Y-%m-%d") if 2020 <= int(y) <= 2100 and not pd.isna(at) else "invalid"

    got = {r.i: r.d for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", D.notice_date(F.col("t")).alias("d")).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_even_space_is_left_alone(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(" \t\n\xa0ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", collapse(F.col("t")).alias("a"), F.trim(F.regexp_replace("t", SPACE, " ")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def feed_of(tmp_path, batch=None):
    return FeedReader(f"file://{tmp_path}", f"file://{tmp_path}/.cursor", batch)


def test_a_feed_takes_a_file_in_few_batches_and_hashes_it_once(tmp_path, monkeypatch):
    data = b"".join(b'{"id": %d}\n%s' % (k, b" \n" * (k % 3 == 0)) for k in range(5000))
    (tmp_path / "a").write_bytes(data + b'{"id"')
    whole = feed_of(tmp_path)
    end = whole.latestOffset()
    assert end["a"] == {"bytes": len(data), "records": 5000, "sha256": hashlib.sha256(data).hexdigest()} == whole.latestOffset()["a"]
    monkeypatch.setattr(FeedReader, "CHUNK", 1000)
    monkeypatch.setattr(FeedReader, "STRETCH", 20_000)
    opened = []
    monkeypatch.setattr(FeedReader, "_open", lambda self, info, offset, real=FeedReader._open: opened.append(offset["bytes"]) or real(self, info, offset))
    for reader in (feed_of(tmp_path), feed_of(tmp_path, 700)):
        opened.clear()
        at, got, batches = {}, [], 0
        while at != end:
            to = reader.latestOffset()
            got += [row for part in reader.partitions(at, to) for row in reader.read(part)]
            assert reader.batch is None or to["a"]["records"] == min(5000, 700 * (batches + 1))
            at, batches = to, batches + 1
        assert [(n, record) for _, n, _, record in got] == [(k + 1, '{"id": %d}' % k) for k in range(5000)]
        assert opened == [0] and batches in (4, 8)


def test_ranges_of_all_statuses_read_the_rounds_once(spark):
    text = QUERIES["fl05_status_ranges"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 2 and "Union" not in text


def test_a_page_is_cut_at_its_labels_once(spark):
    values = labelled_values(F.upper(F.col("id").cast("string")))
    page = spark.range(1).select(values.alias("v"), first_of_each(F.array(F.lower(F.col("id").cast("string"))), lambda x: x).alias("f"))
    text = page._jdf.queryExecution().analyzed().toString()
    assert text.count("upper(") == 1 and text.count("lower(cast(id") == 1 and text.count("|section|") == 1
    html = "<ul><strong>A<span>1</span><strong> B :</strong> <b>2</b></li>x<strong>C</strong><a>3<br>4</a> 5</ul><strong>D"
    assert [tuple(p) for p in spark.range(1).select(labelled_values(F.lit(html)).alias("v")).first().v] == [("", "1"), ("b", "2"), ("c", "3 4"), ("", ">D")]


def test_points_of_a_place_are_listed_and_its_distances_found_once(spark, monkeypatch):
    from hammerfield.operators import geo

    monkeypatch.setattr(geo, "LISTED", 3)
    rng = random.Random(9)
    spots = [(10.0, 20.0), (10.1, 20.1), (-10.0, 179.99), (-10.0, -179.99), (50.0, 0.0)]
    rows = [(rng.randrange(40), *rng.choice(spots)) for _ in range(60)] + [(41, None, 1.0)]
    points = spark.createDataFrame(rows, "id long, lat double, lng double")
    near = geo.within_distance(points, 30, digits=1)
    text = near._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("explode(ks_q") < text.index("explode(ks_p") < text.index("ASIN")
    km = lambda p, q: 0.0 if p == q else {20: 15.6, 179: 2.2}[20 if 10.0 in p + q else 179]
    meet = lambda p, q: p == q or {p, q} in ({spots[0], spots[1]}, {spots[2], spots[3]})
    at = [(k, (lat, lng)) for k, lat, lng in rows[:60]]
    want = sorted((a, b, km(p, q)) for a, p in at for b, q in at if a < b and meet(p, q))
    assert sorted(map(tuple, near.collect())) == want
