"""Verdicts, protection, recovery and sightings: against the rules worked out anew for each run, and at their boundaries."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from hammerfield.operators import health as H
from hammerfield.operators import quality as Q

START = datetime(2026, 1, 1)
RUNS = "id long, source string, started_at timestamp_ntz, " + ", ".join(f"{c} {t}" for c, (t, _) in H.RUN.items())
GOOD = {"records": 1000.0, "complete": True}


def rows(spark, runs):
    """runs: (source, time, changes to an ordinary run)."""
    table = [(i, s, t, *({**dict.fromkeys(H.RUN), **GOOD, **change}[c] for c in H.RUN)) for i, (s, t, change) in enumerate(runs)]
    return spark.createDataFrame(table, RUNS)


def folded(spark, runs):
    return {r.id: r for r in H.source_health(rows(spark, runs)).collect()}


def days(*sizes, **more):
    return [("s", START + timedelta(days=k), {"records": None if x is None else float(x), **more}) for k, x in enumerate(sizes)]


# -- the same rules, from the whole history of a source at every run ----------------------------------------------------


def drop(now, before):
    if now is None or not before:
        return None
    lost = max(0, (before - now) / before)
    return "CRITICAL" if lost >= 0.6 else "INCOMPLETE" if lost >= 0.3 else "WARNING" if lost >= 0.1 else "HEALTHY"


def worked_out(runs):
    """(baseline, page baseline, verdict, protect) of each run of one source, looking back over all judged runs each time."""
    past = []
    for at, run in runs:
        history = list(reversed(past))
        accepted = next((i for i, h in enumerate(history) if h["run"]["accepted"]), None)
        history = history if accepted is None else history[: accepted + 1]
        evidence = [h for h in history if h["run"]["eligible"] and (h["verdict"] == "HEALTHY" or (h["verdict"] == "RECOVERING" and not h["protect"] and not h["run"]["blocked"] and not h["run"]["structure_changed"] and not h["run"]["failed"] and h["run"]["complete"] is not False))]
        told = [h for h in history if h["verdict"] != "RECOVERING" or h["protect"]]
        flagged = []
        for h in told:
            if not h["protect"]:
                break
            flagged.append(h)
        open_ = any(h["verdict"] == "RECOVERING" or h["health"] != (None, None) for h in flagged)
        within = lambda k, d: [h["run"][k] for h in evidence if h["run"][k] is not None and h["at"] >= at - timedelta(days=d)]
        counts, pages = {d: within("records", d) for d in (7, 30)}, {d: within("pages", d) for d in (7, 30)}
        all_counts = [h["run"]["records"] for h in evidence if h["run"]["records"] is not None]
        base = median(counts[7]) if counts[7] else median(counts[30]) if counts[30] else all_counts[1] if len(all_counts) > 1 else None
        page_base = median(pages[7]) if pages[7] else median(pages[30]) if pages[30] else None
        samples = len(pages[7]) if len(pages[7]) >= 2 else len(pages[30])
        if not page_base or samples < 2 or (pages[7] and min(pages[7]) and max(pages[7]) / min(pages[7]) > 2):
            page_base = None
        n, health = run["records"], (None, None)
        if run["accepted"]:
            verdict, protect, health = "HEALTHY", False, ("HEALTHY", None)
        elif not run["eligible"]:
            verdict, protect = drop(run["index_size"], run["index_before"]), True
            health = (verdict, None)
            if verdict in (None, "HEALTHY"):
                verdict, protect, health = "RECOVERING", False, (None, None)
        elif run["blocked"]:
            verdict, protect = "BLOCKED", True
        elif run["structure_changed"]:
            verdict, protect = "CRITICAL", True
        elif run["failed"] and n is None:
            verdict, protect = "FAILED", True
        elif run["complete"] is False:
            verdict, protect = "INCOMPLETE", True
        elif n == 0 and base:
            verdict, protect, health = "CRITICAL", True, ("CRITICAL", None)
        elif n is None:
            verdict, protect = "RECOVERING", open_
        elif not base or not (counts[7] or counts[30]):
            verdict, protect = ("RECOVERING", True) if open_ else ("NO_DATA", True) if n == 0 else ("RECOVERING", False)
        else:
            health = (drop(n, base), drop(run["pages"], page_base))
            order = ["HEALTHY", "WARNING", "INCOMPLETE", "CRITICAL"]
            verdict = max((h for h in health if h), key=order.index)
            protect = verdict != "HEALTHY"
            if not protect and n and run["rejected"] / n >= 0.3:
                verdict, protect = "WARNING", True
        past.append({"at": at, "run": run, "verdict": verdict, "protect": protect, "health": health})
        yield base, page_base, verdict, protect, *health


def random_runs(seed, n, sources=3):
    rng = random.Random(seed)
    runs = []
    for i in range(n):
        change = {
            "records": rng.choice([None, 0.0, 1000.0, 950.0, 800.0, 600.0, 300.0, 1050.0, 1000.0, 980.0]), "pages": rng.choice([None, None, 10.0, 10.0, 9.5, 5.0]), "rejected": float(rng.choice([0, 0, 0, 500])),
            "blocked": rng.random() < 0.05, "complete": rng.choice([True] * 15 + [False, None]), "eligible": rng.random() < 0.85, "structure_changed": rng.random() < 0.03, "failed": rng.random() < 0.06,
            "accepted": rng.random() < 0.02, "index_size": rng.choice([None, 100.0, 95.0, 50.0]), "index_before": rng.choice([None, 100.0]),
        }
        runs.append((f"s{i % sources}", START + timedelta(minutes=rng.randrange(60 * 24 * 120)), change))
    return runs


def test_verdicts_equal_those_worked_out_from_the_whole_history(spark):
    runs = random_runs(5, 600)
    got = folded(spark, runs)
    seen = set()
    for source in ("s0", "s1", "s2"):
        own = sorted((t, i) for i, (s, t, _) in enumerate(runs) if s == source)
        full = [(t, {k: H.RUN[k][1] if x is None else x for k, x in {**dict.fromkeys(H.RUN), **GOOD, **runs[i][2]}.items()}) for t, i in own]
        for (_, i), want in zip(own, worked_out(full)):
            r = got[i]
            assert (r.baseline, r.page_baseline, r.verdict, r.protect, r.record_health, r.page_health) == want
            seen.add(want[2])
    assert seen >= {"HEALTHY", "WARNING", "INCOMPLETE", "CRITICAL", "BLOCKED", "FAILED", "RECOVERING"}


@pytest.mark.parametrize("size,verdict", [(1000, "HEALTHY"), (901, "HEALTHY"), (900, "WARNING"), (701, "WARNING"), (700, "INCOMPLETE"), (401, "INCOMPLETE"), (400, "CRITICAL"), (0, "CRITICAL"), (5000, "HEALTHY")])
def test_drops_at_their_boundaries(spark, size, verdict):
    got = folded(spark, days(1000, 1000, 1000, size))
    assert (got[3].verdict, got[3].protect) == (verdict, verdict != "HEALTHY")


def test_a_long_collapse_never_becomes_the_baseline(spark):
    """Ten good days, then a collapse that outlasts the good runs' 30 days: protected until the size is accepted."""
    runs = days(*[1000] * 10, *[50] * 60)
    got = folded(spark, runs)
    assert {got[k].verdict for k in range(10, 39)} == {"CRITICAL"}
    assert {(got[k].verdict, got[k].protect) for k in range(45, 70)} == {("RECOVERING", True)}
    runs += [("s", START + timedelta(days=70), {"records": 50.0, "accepted": True}), ("s", START + timedelta(days=71), {"records": 50.0})]
    got = folded(spark, runs)
    assert [(got[k].verdict, got[k].protect, got[k].baseline) for k in (70, 71)] == [("HEALTHY", False, 1000.0), ("HEALTHY", False, 50.0)]


def test_first_runs_slices_and_the_index(spark):
    got = folded(spark, days(0) + [("t", START, {}), ("u", START, {"blocked": True}), ("u", START + timedelta(days=1), {}), ("u", START + timedelta(days=2), {})])
    assert [(got[k].verdict, got[k].protect) for k in range(5)] == [("NO_DATA", True), ("RECOVERING", False), ("BLOCKED", True), ("RECOVERING", False), ("HEALTHY", False)]
    part = {"eligible": False, "records": 3.0}
    index = [(None, None, "RECOVERING"), (91.0, 100.0, "RECOVERING"), (90.0, 100.0, "WARNING"), (70.0, 100.0, "INCOMPLETE"), (40.0, 100.0, "CRITICAL"), (140.0, 100.0, "RECOVERING"), (5.0, None, "RECOVERING")]
    got = folded(spark, [(str(k), START, {**part, "index_size": a, "index_before": b}) for k, (a, b, _) in enumerate(index)])
    assert [got[k].verdict for k in range(len(index))] == [x[2] for x in index]


def test_pages_are_compared_with_pages(spark):
    base = [("s", START + timedelta(days=k), {"pages": 40.0}) for k in range(3)]
    for pages, verdict in ((40, "HEALTHY"), (20, "INCOMPLETE"), (2, "CRITICAL"), (None, "HEALTHY")):
        assert folded(spark, [*base, ("s", START + timedelta(days=3), {"pages": None if pages is None else float(pages)})])[3].verdict == verdict
    wild = [("s", START + timedelta(days=k), {"pages": p}) for k, p in enumerate((10.0, 21.0, 15.0, 1.0))]
    assert (folded(spark, wild)[3].page_baseline, folded(spark, wild)[3].verdict) == (None, "HEALTHY")


# -- recovery -----------------------------------------------------------------------------------------------------------


def recovery(spark, *events):
    """Actions after ten good days; events: (hours after the tenth day, changes)."""
    begin = START + timedelta(days=10)
    got = folded(spark, days(*[1000] * 10) + [("s", begin + timedelta(hours=h), change) for h, change in events])
    return [got[10 + k].action for k in range(len(events))]


BAD, PART = {"records": 100.0}, {"records": 100.0, "eligible": False}


def test_recovery_step_by_step(spark):
    assert recovery(spark, (0, BAD), (1, PART), (2, {})) == ["QUEUED", None, "DONE"]
    assert recovery(spark, (0, BAD), (1, BAD), (2, BAD), (13, BAD), (14, BAD), (25, BAD), (26, BAD), (40, BAD), (60, BAD)) == ["QUEUED", "FAILED_ATTEMPT", None, "QUEUED", "FAILED_ATTEMPT", "QUEUED", "FAILED_ATTEMPT", "EXHAUSTED", None]
    # a request of which no complete pass comes expires a day after it was queued, and may then be made again
    assert recovery(spark, (0, BAD), (24, PART), (24.01, PART), (24.02, PART)) == ["QUEUED", None, "EXPIRED", "QUEUED"]
    # a pass that is not complete is none; one that comes late still counts
    assert recovery(spark, (0, BAD), (30, {})) == ["QUEUED", "DONE"]
    assert recovery(spark, (0, BAD), (1, {"accepted": True, "complete": None, "records": 100.0})) == ["QUEUED", "CANCELLED"]
    assert recovery(spark, (0, {"blocked": True}), (1, {"records": 800.0}), (2, {"failed": True, "records": None})) == [None, None, None]
    # what a healed collapse used up does not count for the next one
    assert recovery(spark, (0, BAD), (1, BAD), (13, BAD), (14, {}), (15, BAD)) == ["QUEUED", "FAILED_ATTEMPT", "QUEUED", "DONE", "QUEUED"]


def test_state_survives_being_written(spark):
    source = H.Source()
    twin = H.Source()
    for k, (_, at, change) in enumerate(sorted(random_runs(9, 200, 1), key=lambda r: r[1])):
        run = {c: H.RUN[c][1] if x is None else x for c, x in {**dict.fromkeys(H.RUN), **GOOD, **change}.items()}
        moment = int((at - START).total_seconds() * 1e6)
        assert H.advance(source, run, moment) == H.advance(twin, run, moment), k
        twin = H.Source.load(twin.dump())


# -- protection, acceptance, leases ---------------------------------------------------------------------------------------


def verdicts(spark, *runs):
    frame = [(k, s, START + timedelta(hours=k), v, p) for k, (s, v, p) in enumerate(runs)]
    return spark.createDataFrame(frame, "id long, source string, started_at timestamp_ntz, verdict string, protect boolean")


def test_protection(spark):
    told = verdicts(spark, ("a", "CRITICAL", True), ("a", "RECOVERING", False), ("b", "CRITICAL", None), ("c", "HEALTHY", None), ("c", "RECOVERING", True), ("d", "CRITICAL", True), ("d", "HEALTHY", False), ("e", None, None), ("f", "WARNING", False), ("g", "HEALTHY", False))
    got = {r.source: (r.status, r.protected, r.basis, r.may_disappear) for r in Q.protection(told, F.col("source") != "g").collect()}
    assert got == {
        "a": ("CRITICAL", True, "verdict", False), "b": ("CRITICAL", True, "verdict", False), "c": ("RECOVERING", True, "verdict", False), "d": ("HEALTHY", False, "verdict", True),
        "e": (None, False, "none", False), "f": ("WARNING", False, "verdict", False), "g": (None, True, "unreadable", False),
    }
    assert {r.source: r.streak for r in Q.anomaly_streak(told).collect()} == {"a": 1, "b": 1, "c": 1}


def test_acceptance(spark):
    cases = [("CRITICAL", {}, "accepted"), ("HEALTHY", {}, "nothing to accept"), ("BLOCKED", {}, "not trustworthy"), ("FAILED", {}, "not trustworthy"), ("NO_DATA", {"records": 0.0}, "not trustworthy"), ("CRITICAL", {"structure_changed": True}, "not clean"), ("WARNING", {"eligible": False}, "a slice"), ("INCOMPLETE", {"complete": False}, "not complete"), ("CRITICAL", {"records": 0.0}, "empty"), ("CRITICAL", {"records": None}, "empty")]
    runs = rows(spark, [(str(k), START, change) for k, (_, change, _) in enumerate(cases)])
    told = spark.createDataFrame([(k, v, v != "HEALTHY") for k, (v, _, _) in enumerate(cases)], "id long, verdict string, protect boolean")
    got = {r.source: r.outcome for r in Q.acceptance(runs.join(told, "id")).collect()}
    assert got == {str(k): outcome for k, (_, _, outcome) in enumerate(cases)}


def test_lease(spark):
    now = datetime(2026, 1, 1, 12)
    marks = [("a", 1, "claim", 5.99), ("a", 2, "claim", 5.99), ("b", 3, "claim", 6), ("c", 4, "claim", 3), ("c", 5, "claim_done", 1), ("d", 6, "tick", 2.99), ("e", 7, "tick", 3), ("f", 8, "claim", 4), ("f", 9, "claim_done", 2), ("f", 10, "claim", 1)]
    frame = spark.createDataFrame([(k, i, kind, now - timedelta(minutes=m)) for k, i, kind, m in marks], "key string, id long, kind string, at timestamp_ntz")
    got = {r.key: (r.winner, r.blocked) for r in Q.lease(frame, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {"a": (1, "another tick is running"), "b": (None, None), "c": (None, None), "d": (None, "a tick just ran"), "e": (None, None), "f": (10, "another tick is running")}


# -- sightings ------------------------------------------------------------------------------------------------------------


def swept(spark, sightings, passes):
    at = lambda h: START + timedelta(hours=h)
    seen = spark.createDataFrame([(s, i, at(h)) for s, i, h in sightings], "source string, item string, seen_at timestamp_ntz")
    done = spark.createDataFrame([(s, at(a), at(b), v, c) for s, a, b, v, c in passes], "source string, pass_at timestamp_ntz, done_at timestamp_ntz, verdict string, complete boolean")
    return {(r.source, r.item): (r.missed, r.flagged) for r in Q.last_seen_sweep(seen, done).collect()}


def test_items_are_flagged_after_two_missed_passes_in_a_row(spark):
    ok = lambda *hours: [("s", h, h + 1, "HEALTHY", True) for h in hours]
    keep = [("s", "keep", h) for h in (0, 10.5, 20.5, 30.5)]
    assert swept(spark, [*keep, ("s", "x", 0)], ok(10))["s", "x"] == (1, False)
    assert swept(spark, [*keep, ("s", "x", 0)], ok(10, 20))["s", "x"] == (2, True)
    assert swept(spark, [*keep, ("s", "x", 0), ("s", "x", 20.2)], ok(10, 20, 30))["s", "x"] == (1, False)
    assert swept(spark, [*keep, ("s", "x", 9.9)], ok(10))["s", "x"] == (1, False)  # before the pass began
    assert swept(spark, [*keep, ("s", "x", 0)], [("s", 10, 11, "WARNING", True), ("s", 20, 21, "HEALTHY", False), ("s", 30, 31, "HEALTHY", None)])["s", "x"] == (0, False)
    assert swept(spark, [("t", "x", 0)], ok(10)) == {("t", "x"): (0, False)}


def test_a_pass_that_misses_too_many_counts_for_none(spark):
    many = [("s", f"i{k}", 0) for k in range(20)]
    seen = lambda n, h: [("s", f"i{k}", h) for k in range(n)]
    passes = [("s", h, h + 1, "HEALTHY", True) for h in (10, 20, 30)]
    got = swept(spark, many + seen(16, 10.5) + seen(15, 20.5) + seen(16, 30.5), passes)
    assert got["s", "i17"] == (2, True) and got["s", "i15"] == (0, False)  # the second misses a quarter and is passed over
    few = [x for x in many if int(x[1][1:]) < 19]
    assert swept(spark, few + seen(5, 10.5), passes[:1])["s", "i7"] == (1, False)


def test_a_sighting_between_passes_clears_only_a_flag(spark):
    passes = [("s", h, h + 1, "HEALTHY", True) for h in (10, 20, 30)]
    keep = [("s", "keep", h) for h in (0, 10.5, 20.5, 30.5)]
    assert swept(spark, [*keep, ("s", "x", 0), ("s", "x", 15)], passes[:2])["s", "x"] == (2, True)
    assert swept(spark, [*keep, ("s", "x", 0), ("s", "x", 25)], passes)["s", "x"] == (1, False)


def test_sweep_equals_a_walk_through_time(spark):
    rng = random.Random(6)
    passes = [(s, h, h + rng.choice([1, 3, 5]), rng.choice(["HEALTHY"] * 4 + ["CRITICAL"]), rng.random() < 0.9) for s in "ab" for h in range(5, 200, 6)]
    sightings = [(s, f"i{k}", h + rng.random()) for s in "ab" for k in range(30) for h in range(0, 200) if rng.random() < (0.5 if k < 26 else 0.02)]
    got = swept(spark, sightings, passes)
    for s in "ab":
        missed = {}
        events = sorted([(h, 1, i) for x, i, h in sightings if x == s] + [(b, 2, (a, b)) for x, a, b, v, c in passes if x == s and v == "HEALTHY" and c], key=lambda e: e[:2])
        last = {}
        for h, kind, what in events:
            if kind == 1:
                last[what] = h
                if missed.get(what, 0) >= 2:
                    missed[what] = 0
                continue
            gone = [i for i, at in last.items() if at < what[0]]
            guard = len(last) >= 20 and len(gone) / len(last) > 0.2
            for i in last:
                missed[i] = 0 if i not in gone else missed.get(i, 0) + (not guard)
        assert {i: (missed[i], missed[i] >= 2) for i in last} == {i: r for (x, i), r in got.items() if x == s}
