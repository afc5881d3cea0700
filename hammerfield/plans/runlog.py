"""Queries: run log, coverage, quality and stream-shaped operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import health as H
from ..operators import lifecycle as L
from ..operators import quality as Q
from ..operators import rollups as R
from ..operators import search as S
from .proxies import Views
from .registry import query
from .search import now_col, _OVER


def at_():
    return F.lit("2024-01-25").cast("timestamp_ntz")

def rows_():
    return F.count(F.lit(1))
_FLAGS = f"""f AS (SELECT id, bank_id, current, current AND coalesce(reserve_price > 0, false) AND auction_start IS NOT NULL AS actionable FROM (
  SELECT a.*, p.status = 'PUBLISHED' AND ((a.status IN ('UPCOMING', 'LIVE', 'AUCTION_TODAY') AND NOT ({_OVER})) OR a.status = 'POSTPONED') AS current FROM auction a JOIN property p ON p.id = a.property_id))"""


@query("ag18_coverage", f"WITH {_FLAGS} SELECT bank_id, count(*) AS total, count(*) FILTER (WHERE current) AS current, count(*) FILTER (WHERE actionable) AS actionable, round(count(*) FILTER (WHERE actionable) / nullif(sum(count(*) FILTER (WHERE actionable)) OVER (), 0), 6) AS share FROM f GROUP BY bank_id")
def ag18(v: Views):
    flags = Q.coverage_flags(v.auction, v.property, L.is_over(F.col("auction_start"), F.col("auction_end"), now_col()))
    out = flags.groupBy("bank_id").agg(rows_().alias("total"), F.count_if("current").alias("current"), F.count_if("actionable").alias("actionable"))
    whole = out.agg(F.sum("actionable").alias("whole"))
    return out.join(F.broadcast(whole)).select("bank_id", "total", "current", "actionable", F.round(F.col("actionable") / F.nullif("whole", F.lit(0)), 6).alias("share"))


@query("ag19_overlap", "SELECT source, CASE WHEN c + d + r > 0 THEN c / (c + d + r) END AS created, CASE WHEN c + d + r > 0 THEN d / (c + d + r) END AS duplicates FROM (SELECT source, sum(created) FILTER (WHERE kind = 'click')::DOUBLE AS c, sum(created) FILTER (WHERE kind = 'view')::DOUBLE AS d, sum(created) FILTER (WHERE kind = 'error')::DOUBLE AS r FROM run_log GROUP BY source)")
def ag19(v: Views):
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.greatest(F.lit(0), F.col("created")))), F.lit(0)).cast("double")
    sums = v.run_log.groupBy("source").agg(part("click").alias("c"), part("view").alias("d"), part("error").alias("r"))
    all_ = F.col("c") + F.col("d") + F.col("r")
    return sums.select("source", R.ratio(F.col("c"), all_).alias("created"), R.ratio(F.col("d"), all_).alias("duplicates"))


@query("ag20_largest_pass", "SELECT source, id, created FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created DESC, started_at, id) AS n FROM run_log) WHERE n = 1")
def ag20(v: Views):
    return S.latest(v.run_log, ["source"], F.col("created").desc(), F.col("started_at").asc(), F.col("id").asc()).select("source", "id", "created")


def _base(days: int) -> str:
    c = f"created) FILTER (WHERE status = 'ok' AND started_at > timestamp '2024-01-25' - interval {days} day AND started_at <= timestamp '2024-01-25')"
    return f"median({c} AS median_{days}, min({c} AS least_{days}, max({c} AS most_{days}, count({c} AS runs_{days}"


@query("ag21_baselines", f"SELECT source, {_base(7)}, {_base(30)} FROM run_log GROUP BY source")
def ag21(v: Views):
    return Q.baselines(v.run_log, at_())


@query("ag21_trend", """WITH r AS (SELECT source, max((started_at, id)) AS reset FROM run_log WHERE id % 101 = 100 GROUP BY source), g AS (SELECT l.*, row_number() OVER (PARTITION BY l.source ORDER BY started_at DESC, id DESC) AS n FROM run_log l LEFT JOIN r USING (source) WHERE (reset IS NULL OR (started_at, id) >= reset) AND (status = 'ok' OR id % 101 = 100) AND created IS NOT NULL)
SELECT source, max(created) FILTER (WHERE n = 1)::DOUBLE AS latest, max(created) FILTER (WHERE n = 2)::DOUBLE AS previous, (max(created) FILTER (WHERE n = 1) - max(created) FILTER (WHERE n = 2)) / nullif(max(created) FILTER (WHERE n = 2), 0)::DOUBLE AS trend FROM g GROUP BY source""")  # fmt: skip
def ag21_trend(v: Views):
    """The trend of each source since a run of it was last accepted as its baseline."""
    rows = v.run_log.select("id", "source", "started_at", F.col("created").cast("double").alias("records"), (F.col("status") == "ok").alias("good"), (F.col("id") % 101 == 100).alias("accepted"))
    return Q.baseline_trend(rows)


@query("ag18_coverage_totals", f"WITH {_FLAGS} SELECT CASE WHEN grouping(bank_id) = 1 THEN 'all' ELSE coalesce(bank_id::VARCHAR, 'none') END AS scope, count(*) AS total, count(*) FILTER (WHERE current) AS current, count(*) FILTER (WHERE actionable) AS actionable FROM f GROUP BY GROUPING SETS ((), (bank_id))")
def ag18_totals(v: Views):
    """Coverage by source and over all."""
    flags = Q.coverage_flags(v.auction, v.property, L.is_over(F.col("auction_start"), F.col("auction_end"), now_col()))
    out = flags.rollup("bank_id").agg(F.grouping("bank_id").alias("g"), rows_().alias("total"), F.count_if("current").alias("current"), F.count_if("actionable").alias("actionable"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce(F.col("bank_id").cast("string"), F.lit("none"))).alias("scope"), "total", "current", "actionable")


@query("wn03_tick_gaps", "SELECT source, count(*) AS n, max(started_at) AS last, max(gap)::BIGINT AS longest, count(*) FILTER (WHERE gap > 20) AS long_gaps FROM (SELECT *, floor((floor(epoch(started_at)) - floor(epoch(lag(started_at) OVER (PARTITION BY source ORDER BY started_at, id)))) / 60 + 0.5) AS gap FROM run_log) GROUP BY source")
def wn03(v: Views):
    return Q.tick_gaps(v.run_log)


@query("wn04_changes_only", "SELECT id FROM (SELECT id, created % 3 AS x, lag(created % 3) OVER w AS p, row_number() OVER w AS n FROM run_log WINDOW w AS (PARTITION BY source ORDER BY started_at, id)) WHERE n = 1 OR x IS DISTINCT FROM p")
def wn04(v: Views):
    return R.changes_only(v.run_log, ["source"], ["started_at", "id"], F.col("created") % 3).select("id")


@query("sd11_scheduler_health", "SELECT source, CASE WHEN max(started_at) < timestamp '2024-01-30 23:00:00' - interval 60 minute THEN 'late' ELSE 'ok' END AS health FROM run_log GROUP BY source")
def sd11(v: Views):
    last = F.max("started_at")
    now = F.lit("2024-01-30 23:00:00").cast("timestamp_ntz")
    return v.run_log.groupBy("source").agg(F.when(last.isNull(), "never").when(last < now - F.expr("INTERVAL 60 MINUTES"), "late").otherwise("ok").alias("health"))


@query("st08_scan_order", "SELECT source, row_number() OVER (ORDER BY CASE WHEN max(started_at) < timestamp '2024-01-30 20:00:00' THEN 0 ELSE 1 END, max(started_at), source) AS place FROM run_log GROUP BY source")
def st08(v: Views):
    last = v.run_log.groupBy("source").agg(F.max("started_at").alias("last"))
    starved = F.when(F.col("last") < F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"), 0).otherwise(1)
    return last.select("source", F.row_number().over(Window.orderBy(starved, "last", "source")).cast("long").alias("place"))


@query("st23_dedup_state", "SELECT source, message, min(id) AS id FROM run_log GROUP BY source, message")
def st23(v: Views):
    return S.latest(v.run_log, ["source", "message"], F.col("id").asc()).select("source", "message", "id")


@query("st30_daily_snapshot", "SELECT CAST(started_at + interval 330 minute AS DATE) AS day, source, arg_max(created, (started_at, id)) AS reading FROM run_log GROUP BY ALL")
def st30(v: Views):
    return v.run_log.groupBy(L.ist_date(F.col("started_at")).alias("day"), "source").agg(F.max_by("created", F.struct("started_at", "id")).alias("reading"))


@query("st31_late_observation", "SELECT count(*) AS observations, count(DISTINCT source || created) AS distinct_values FROM run_log")
def st31(v: Views):
    return v.run_log.agg(rows_().alias("observations"), F.countDistinct("source", "created").alias("distinct_values"))


@query("pg01_problem_runs", "SELECT id, kind FROM (SELECT * FROM run_log ORDER BY started_at DESC, id DESC LIMIT 150) WHERE status = 'error'")
def pg01(v: Views):
    """The newest 150 first, then the filter."""
    return v.run_log.orderBy(F.desc("started_at"), F.desc("id")).limit(150).filter("status = 'error'").select("id", "kind")


@query("pg26_open_request", """SELECT e.event_id FROM events e WHERE e.event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.ts < e.ts AND x.ts >= e.ts - interval 7 day)""")
def pg26(v: Views):
    """First of its kind in seven days: the one before decides."""
    rows = v.events.filter("event_type = 'signup'").withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.filter("before IS NULL OR before < ts - INTERVAL 7 DAYS").select("event_id")


@query("src05_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def src05(v: Views):
    return v.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


@query("src07_field_map", "SELECT 'src:events:' || event_id AS external_id, event_type AS title, json_extract_string(props, '$.k') AS price FROM events WHERE event_type <> 'error' AND json_extract_string(props, '$.k') IS NOT NULL")
def src07(v: Views):
    """A configured map of names to paths; records without what is required, or of a kind left out, are dropped."""
    paths = {"price": "$.k"}
    rows = v.events.select(F.concat(F.lit("src:events:"), F.col("event_id").cast("string")).alias("external_id"), F.col("event_type").alias("title"), *[F.get_json_object("props", p).alias(n) for n, p in paths.items()])
    return rows.filter("title <> 'error' AND price IS NOT NULL")


@query("sj08_state_merge", "SELECT event_id, json_merge_patch(props, '{\"done\":1}') AS state FROM events")
def sj08(v: Views):
    merged = F.map_concat(F.map_filter(F.from_json("props", "map<string,int>"), lambda k, _: k != "done"), F.create_map(F.lit("done"), F.lit(1)))
    return v.events.select("event_id", F.to_json(merged).alias("state"))


# -- source health -----------------------------------------------------------------------------------------------

_RUNS = "SELECT id, source, kind AS channel, started_at, CASE WHEN created % 3 = 0 THEN 0 ELSE created END AS discovered, CASE WHEN id % 4 = 0 THEN 0 ELSE created % 5 END AS created, CASE WHEN id % 4 = 0 THEN 0 ELSE created % 2 END AS duplicates, created % 7 AS rejected FROM run_log"
_YIELD = f"""WITH q AS ({_RUNS}), e AS (SELECT *, discovered <= 0 AS empty, discovered > 0 AND created + duplicates = 0 AND rejected > 0 AS bad FROM q),
i AS (SELECT *, sum(CASE WHEN empty THEN 0 ELSE 1 END) OVER w AS i1, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER w AS i2 FROM e WINDOW w AS (PARTITION BY source, channel ORDER BY started_at, id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, sum(empty::INT) OVER a AS zero_streak, sum(bad::INT) OVER b AS reject_streak, min(CASE WHEN empty THEN started_at END) OVER a AS first_zero FROM i
  WINDOW a AS (PARTITION BY source, channel, i1 ORDER BY started_at, id ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY source, channel, i2 ORDER BY started_at, id ROWS UNBOUNDED PRECEDING)),
y AS (SELECT id, source, channel, started_at, zero_streak::BIGINT AS zero_streak, reject_streak::BIGINT AS reject_streak, CASE WHEN NOT empty AND reject_streak >= 3 THEN 'ALL_REJECTED' WHEN NOT empty THEN 'PRODUCTIVE' WHEN i1 > 0 THEN 'DROPPED'
  WHEN zero_streak >= 3 AND started_at - interval 6 hour >= first_zero THEN 'ZERO_YIELD' ELSE 'EMPTY' END AS verdict FROM z)"""


def _runs(v: Views):
    created = F.col("created")
    busy = F.col("id") % 4 != 0
    return v.run_log.select(
        "id", "source", F.col("kind").alias("channel"), "started_at", F.when(created % 3 == 0, 0).otherwise(created).alias("discovered"),
        F.when(busy, created % 5).otherwise(0).alias("created"), F.when(busy, created % 2).otherwise(0).alias("duplicates"), (created % 7).alias("rejected"),
    )


@query("wn05_streaks", f"{_YIELD} SELECT * FROM y")
def wn05(v: Views):
    return Q.yield_states(_runs(v))


@query("st24_yield_machine", f"""{_YIELD}, l AS (SELECT source, channel, arg_max(verdict, (started_at, id)) AS verdict, max(started_at) AS newest FROM y GROUP BY ALL)
SELECT source, CASE WHEN bool_or(verdict = 'PRODUCTIVE' AND newest > timestamp '2024-01-25' - interval 14 day) THEN 'PRODUCTIVE' ELSE ['PRODUCTIVE', 'EMPTY', 'ALL_REJECTED', 'ZERO_YIELD', 'DROPPED'][max(list_position(['PRODUCTIVE', 'EMPTY', 'ALL_REJECTED', 'ZERO_YIELD', 'DROPPED'], verdict))] END AS verdict, count(*) AS channels FROM l GROUP BY source""")  # fmt: skip
def st24(v: Views):
    return Q.overall_yield(Q.yield_states(_runs(v)), at_())


_VERDICT = "CASE created % 9 WHEN 0 THEN NULL WHEN 1 THEN 'RECOVERING' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'WARNING' WHEN 4 THEN 'BLOCKED' ELSE CASE WHEN status = 'ok' THEN 'HEALTHY' ELSE 'FAILED' END END"
_PROTECT = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN created % 9 <> 1 ELSE created % 2 = 0 END"
#: What the deciding runs say: those without a verdict, and RECOVERING ones that do not protect, are passed over.
_TOLD = f"j AS (SELECT *, {_VERDICT} AS verdict, {_PROTECT} AS protect FROM run_log), k AS (SELECT *, coalesce(protect, verdict <> 'HEALTHY') AS flagged FROM j WHERE verdict IS NOT NULL AND (verdict <> 'RECOVERING' OR coalesce(protect, false)))"
_DECIDING = f"{_TOLD}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS n FROM k) WHERE n = 1), r AS (SELECT DISTINCT source FROM run_log)"


def _judged(v: Views):
    return v.run_log.selectExpr("id", "source", "started_at", f"{_VERDICT} AS verdict", f"{_PROTECT} AS protect")


@query("wn06_latest_evaluated", f"WITH {_DECIDING} SELECT source, id, verdict, protect FROM d")
def wn06(v: Views):
    return Q.deciding(_judged(v))


@query("wn07_anomaly_streak", f"WITH {_TOLD} SELECT source, count(*) AS streak FROM (SELECT *, sum(CASE WHEN flagged THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY started_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS ok FROM k) WHERE ok = 0 GROUP BY source")
def wn07(v: Views):
    return Q.anomaly_streak(_judged(v))


@query("st28_protection", f"""WITH {_DECIDING} SELECT r.source, CASE WHEN r.source <> 'src3' THEN verdict END AS status, CASE WHEN r.source = 'src3' THEN true ELSE coalesce(flagged, false) END AS protected, CASE WHEN r.source = 'src3' THEN 'unreadable' WHEN verdict IS NULL THEN 'none' ELSE 'verdict' END AS basis,
coalesce(r.source <> 'src3' AND NOT flagged AND verdict = 'HEALTHY', false) AS may_disappear FROM r LEFT JOIN d USING (source)""")  # fmt: skip
def st28(v: Views):
    """The history of one source cannot be read: it is protected."""
    return Q.protection(_judged(v), F.col("source") != "src3")


def _measured(v: Views):
    """Runs with what they measured: one in 31 has no count, some are slices, incomplete, blocked or see another structure."""
    return v.run_log.select(
        "id", "source", "started_at", F.when(F.col("id") % 31 > 0, F.col("created").cast("double")).alias("records"), F.when(F.col("id") % 5 > 0, F.floor(F.col("created") / 10).cast("double")).alias("pages"),
        (F.col("created") % 40).cast("double").alias("rejected"), ((F.col("status") == "error") & (F.col("id") % 3 == 0)).alias("blocked"), (F.col("id") % 37 > 0).alias("complete"), (F.col("id") % 11 > 0).alias("eligible"),
        (F.col("id") % 97 == 1).alias("structure_changed"), ((F.col("id") % 31 == 0) & (F.col("id") % 2 == 0)).alias("failed"), (F.col("id") % 101 == 100).alias("accepted"),
        F.col("created").cast("double").alias("index_size"), F.when(F.col("id") % 2 == 0, F.lit(300.0)).alias("index_before"),
    )


@query("st26_recovery")
def st26(v: Views):
    return H.source_health(_measured(v)).select("id", "source", "action", "state", "attempts")


@query("st27_completeness")
def st27(v: Views):
    return H.source_health(_measured(v)).select("id", "source", "baseline", "page_baseline", "verdict", "protect", "record_health", "page_health")


_ITEM = "cast(id % CASE WHEN source < 'src4' THEN 7 ELSE 60 END AS {string})"


LAST_SEEN = f"""WITH RECURSIVE s AS (SELECT source, {_ITEM.replace("{string}", "VARCHAR")} AS item, started_at AS t FROM run_log WHERE kind <> 'error'),
p AS (SELECT id, source, started_at AS a, coalesce(lead(started_at) OVER (PARTITION BY source ORDER BY started_at, id) - interval 1 microsecond, started_at + interval 6 hour) AS b FROM run_log WHERE kind = 'error'),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY a, b) AS k FROM (SELECT DISTINCT source, a, b FROM p WHERE id % 3 <> 0 AND id % 7 <> 0)),
x AS (SELECT s.source, item, t, count(q.a) AS k, coalesce(t <= arg_max(q.b, q.k), false) AS inside FROM s LEFT JOIN q ON q.source = s.source AND q.a <= t GROUP BY s.source, item, t),
y AS (SELECT DISTINCT source, item, k, inside FROM x), i AS (SELECT f.source, item, f.f AS f, count(q.a) + 1 AS since FROM (SELECT source, item, min(t) AS f FROM s GROUP BY ALL) f LEFT JOIN q ON q.source = f.source AND q.b < f.f GROUP BY f.source, item, f.f),
e AS (SELECT source, k, (SELECT count(*) FROM i WHERE i.source = q.source AND i.f <= q.b) AS known, (SELECT count(*) FROM y WHERE y.source = q.source AND y.k = q.k AND inside) AS found FROM q),
g AS (SELECT source, k, NOT (known >= 20 AND (known - found) / known > 0.2) AS counts FROM e),
r AS (SELECT source, item, since - 1 AS k, 0::BIGINT AS n FROM i UNION ALL SELECT r.source, r.item, g.k, CASE WHEN o.item IS NOT NULL AND m >= 2 THEN 0 ELSE m END FROM r JOIN g ON g.source = r.source AND g.k = r.k + 1
  LEFT JOIN y z ON z.source = r.source AND z.item = r.item AND z.k = g.k AND z.inside LEFT JOIN y o ON o.source = r.source AND o.item = r.item AND o.k = g.k AND NOT o.inside, LATERAL (SELECT CASE WHEN z.item IS NOT NULL THEN 0 WHEN counts THEN r.n + 1 ELSE r.n END AS m))
SELECT source, item, n AS missed, n >= 2 AS flagged FROM r QUALIFY row_number() OVER (PARTITION BY source, item ORDER BY k DESC) = 1"""  # fmt: skip


@query("st25_last_seen", LAST_SEEN)
def st25(v: Views):
    return Q.last_seen_sweep(*sightings_and_passes(v))


def sightings_and_passes(v: Views):
    """Every run is a sighting of its item, or a pass that lasts until the next one; some passes are not healthy or not complete."""
    seen = v.run_log.filter("kind <> 'error'").selectExpr("source", f"{_ITEM.replace('{string}', 'string')} AS item", "started_at AS seen_at")
    following = F.lead("started_at").over(Window.partitionBy("source").orderBy("started_at", "id"))
    done = F.coalesce(following - F.expr("INTERVAL '0.000001' SECOND"), F.col("started_at") + F.expr("INTERVAL 6 HOURS"))
    passes = v.run_log.filter("kind = 'error'").select("id", "source", F.col("started_at").alias("pass_at"), done.alias("done_at"))
    passes = passes.select("source", "pass_at", "done_at", F.when(F.col("id") % 3 != 0, "HEALTHY").otherwise("WARNING").alias("verdict"), (F.col("id") % 7 != 0).alias("complete"))
    return seen, passes


@query("st29_accept_baseline", f"""WITH {_DECIDING} SELECT r.source, id, CASE WHEN NOT coalesce(flagged, false) THEN 'nothing to accept' WHEN verdict IN ('BLOCKED', 'FAILED', 'NO_DATA') THEN 'not trustworthy' WHEN (status = 'error' AND id % 3 = 0) OR id % 97 = 1 OR (id % 31 = 0 AND id % 2 = 0) THEN 'not clean'
WHEN id % 11 = 0 THEN 'a slice' WHEN id % 37 = 0 THEN 'not complete' WHEN id % 31 = 0 OR created <= 0 THEN 'empty' ELSE 'accepted' END AS outcome FROM r LEFT JOIN d USING (source)""")  # fmt: skip
def st29(v: Views):
    """Whether the size of each source's deciding run may become its baseline."""
    return Q.acceptance(_measured(v).join(_judged(v).select("id", "verdict", "protect"), "id"))


@query("snk04_retention", "SELECT source, kind, count(*) AS kept FROM run_log WHERE CASE WHEN kind = 'view' THEN started_at >= timestamp '2025-02-20' - interval 400 day ELSE started_at >= timestamp '2024-03-15' - interval 60 day END GROUP BY ALL")
def snk04(v: Views):
    """Runs are kept for 60 days, snapshots (here: views) for 400."""
    at = F.col("started_at")
    snapshot = at >= F.lit("2025-02-20").cast("timestamp_ntz") - F.expr("INTERVAL 400 DAYS")
    kept = F.when(F.col("kind") == "view", snapshot).otherwise(at >= F.lit("2024-03-15").cast("timestamp_ntz") - F.expr("INTERVAL 60 DAYS"))
    return v.run_log.filter(kept).groupBy("source", "kind").agg(rows_().alias("kept"))


@query("st22_lease", """WITH m AS (SELECT CAST(started_at AS DATE) AS key, id, started_at AS t, CASE kind WHEN 'click' THEN 'claim' WHEN 'signup' THEN 'claim_done' WHEN 'view' THEN 'tick' END AS kind FROM run_log),
n AS (SELECT key, max(t) AS now, max(t) FILTER (WHERE kind = 'claim_done') AS released FROM m GROUP BY key),
l AS (SELECT m.*, coalesce(kind = 'claim', false) AND t > now - interval 6 minute AND coalesce(t >= released, true) AS live, coalesce(kind = 'tick', false) AND t > now - interval 3 minute AS ticked FROM m JOIN n USING (key))
SELECT key, arg_min(id, (t, id)) FILTER (WHERE live) AS winner, count(*) FILTER (WHERE live) AS waiting, CASE WHEN count(*) FILTER (WHERE live) > 0 THEN 'another tick is running' WHEN bool_or(ticked) THEN 'a tick just ran' END AS blocked FROM l GROUP BY key""")  # fmt: skip
def st22(v: Views):
    """The lease of each day's ticks, as it stands at the day's last event."""
    kind = F.when(F.col("kind") == "click", "claim").when(F.col("kind") == "signup", "claim_done").when(F.col("kind") == "view", "tick")
    rows = v.run_log.select(F.col("started_at").cast("date").alias("key"), "id", F.col("started_at").alias("at"), kind.alias("kind"))
    last = rows.groupBy("key").agg(F.max("at").alias("now"))
    return Q.lease(rows.join(last, "key"), F.col("now"))


@query("wn02_trend", """SELECT scope, date, value, value - lag(value) OVER w AS change, greatest(0, date_diff('day', lag(date) OVER w, date) - 1)::INT AS gap_days FROM (
  SELECT source || kind AS scope, CAST(started_at + interval 330 minute AS DATE) AS date, arg_max(created, (started_at, id)) AS value FROM run_log GROUP BY ALL) WINDOW w AS (PARTITION BY scope ORDER BY date)""")  # fmt: skip
def wn02(v: Views):
    rows = v.run_log.select(F.concat("source", "kind").alias("scope"), L.ist_date(F.col("started_at")).alias("date"), F.struct("started_at", "id").alias("at"), F.col("created").alias("value"))
    return R.trend(rows)


@query("sj04_header", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(CASE WHEN length(f) <= 60 THEN f ELSE s END)::INT AS n FROM (SELECT *, '[DATA_ENGINE_V1] {\"k\":' || json_extract_string(props, '$.k') || ',\"baseline\":' || value || '}\n' AS h, '[DATA_ENGINE_V1] {\"k\":' || json_extract_string(props, '$.k') || '}\n' AS g, repeat('read ', (event_id % 9)::INT) AS t, h || t AS f, substr(g || t, 1, 60) AS s FROM events)")
def sj04(v: Views):
    """A header of metrics before a message: the baseline goes first where the whole is too long, then the text is cut."""
    k = F.get_json_object("props", "$.k")
    text = F.repeat(F.lit("read "), (F.col("event_id") % 9).cast("int"))
    made = Q.with_header(F.concat(F.lit('{"k":'), k, F.lit(',"baseline":'), F.col("value").cast("string"), F.lit("}")), F.concat(F.lit('{"k":'), k, F.lit("}")), text, 60)
    return v.events.select("event_id", F.get_json_object(Q.header(made), "$.k").alias("k"), F.length(made).alias("n"))


#: Weights of sources in the time shares; fixed values in seconds: least and most of a share, for importing and plain sources.
SHARES = {True: (20, 150, 3), False: (10, 60, 1)}


@query("st09_time_shares", """WITH RECURSIVE s AS (SELECT source, source IN ('src1', 'src4') AS importing, row_number() OVER (ORDER BY source) AS n, count(*) OVER () AS many FROM (SELECT DISTINCT source FROM run_log)),
w AS (SELECT *, CASE WHEN importing THEN 3 ELSE 1 END AS weight, CASE WHEN importing THEN 20 ELSE 10 END AS least, CASE WHEN importing THEN 150 ELSE 60 END AS most FROM s),
t AS (SELECT *, sum(weight) OVER (ORDER BY n DESC) AS rest FROM w),
r AS (SELECT 0::BIGINT AS n, ''::VARCHAR AS source, NULL::BIGINT AS seconds, 262::BIGINT AS remaining UNION ALL
  SELECT t.n, t.source, g, r.remaining - coalesce(g, 0) FROM r JOIN t ON t.n = r.n + 1, LATERAL (SELECT CASE WHEN r.remaining >= t.least THEN least(r.remaining, greatest(t.least, least(t.most, floor(r.remaining * t.weight / t.rest)::BIGINT))) END AS g))
SELECT source, seconds FROM r WHERE n > 0""")  # fmt: skip
def st09(v: Views):
    """Shares of a tick of 262 seconds for the sources in turn; null is put off. One fold over the sources, which are few."""
    sources = v.run_log.select("source").distinct().groupBy().agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return sources.select(F.explode(Q.time_shares(F.col("sources"), lambda s: s.isin("src1", "src4"), SHARES, 262)).alias("r")).select("r.*")


@query("st32_scan_order", """SELECT source, row_number() OVER (ORDER BY starved DESC, CASE WHEN starved THEN last END, importing DESC, last, source) AS place FROM (SELECT source, max(started_at) AS last, source IN ('src1', 'src4') AS importing, max(started_at) < timestamp '2024-01-30 22:00:00' AS starved FROM run_log GROUP BY source)""")
def st32(v: Views):
    """Starved sources first, the longest waiting before; then importing ones; then by waiting time."""
    last = v.run_log.groupBy("source").agg(F.max("started_at").alias("last"))
    starved, importing = F.col("last") < F.lit("2024-01-30 22:00:00").cast("timestamp_ntz"), F.col("source").isin("src1", "src4")
    return last.select("source", F.row_number().over(Window.orderBy(starved.desc(), F.when(starved, F.col("last")), importing.desc(), "last", "source")).cast("long").alias("place"))
