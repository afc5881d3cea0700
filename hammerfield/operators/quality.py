"""Run-log analytics: baselines, verdicts that depend on earlier verdicts, streaks, sightings, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .health import PROTECTIVE
from .rollups import streaks
from .staging import stage


def baselines(runs: DataFrame, now) -> DataFrame:
    """For each source the exact median, least and most records of its good runs, over 7 and 30 days before now."""
    age = lambda days: (F.col("started_at") > now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("started_at") <= now) & (F.col("status") == "ok")
    out = []
    for days in (7, 30):
        value = F.when(age(days), F.col("created"))
        out += [F.median(value).alias(f"median_{days}"), F.min(value).alias(f"least_{days}"), F.max(value).alias(f"most_{days}"), F.count(value).alias(f"runs_{days}")]
    return runs.groupBy("source").agg(*out)


def baseline_trend(runs: DataFrame) -> DataFrame:
    """source, latest, previous and trend of the good runs (id, started_at, records, good, accepted) since a baseline was last accepted.

    An accepted run starts the history anew and is part of it. trend is the change from the run before as a share of it;
    null without one, or where it was empty.
    """
    at = F.struct("started_at", "id")
    reset = runs.filter("accepted").groupBy("source").agg(F.max(at).alias("reset"))
    rows = runs.join(reset, "source", "left").filter(F.col("reset").isNull() | (at >= F.col("reset"))).filter("(good OR accepted) AND records IS NOT NULL")
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id")))).filter("_n <= 2")
    pick = lambda n: F.max(F.when(F.col("_n") == n, F.col("records")))
    out = ranked.groupBy("source").agg(pick(1).alias("latest"), pick(2).alias("previous"))
    return out.select("source", "latest", "previous", ((F.col("latest") - F.col("previous")) / F.nullif("previous", F.lit(0))).alias("trend"))


#: Runs and hours before an empty source is called so, and days that a productive channel vouches for it.
EMPTY_RUNS, EMPTY_HOURS, REJECTED_RUNS, FRESH_DAYS = 3, 6, 3, 14
YIELD_SEVERITY = ["PRODUCTIVE", "EMPTY", "ALL_REJECTED", "ZERO_YIELD", "DROPPED"]


def yield_states(runs: DataFrame) -> DataFrame:
    """State of each (source, channel) after each run (id, started_at, discovered, created, duplicates, rejected).

    A run that shows nothing lengthens the zero streak: DROPPED where the channel was productive before, ZERO_YIELD after
    EMPTY_RUNS such runs over EMPTY_HOURS, else EMPTY. A run that shows something is PRODUCTIVE, or ALL_REJECTED at the
    third in a row without one valid record.
    """
    keys, order = ["source", "channel"], ["started_at", "id"]
    empty = F.coalesce(F.col("discovered"), F.lit(0)) <= 0
    rejected = ~empty & (F.col("created") + F.col("duplicates") == 0) & (F.col("rejected") > 0)
    rows = streaks(streaks(runs, keys, order, empty).withColumnRenamed("streak", "zero_streak"), keys, order, rejected).withColumnRenamed("streak", "reject_streak")
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last_good = F.last(F.when(~empty, F.col("started_at")), ignorenulls=True).over(before)
    # the zero streak began with the first run after the last productive one
    first_zero = F.min(F.when(empty, F.col("started_at"))).over(Window.partitionBy(*keys, "_good").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("last_productive", last_good).withColumn("_good", F.sum(F.when(empty, 0).otherwise(1)).over(before)).withColumn("_first_zero", first_zero)
    long = F.col("started_at") - F.expr(f"INTERVAL {EMPTY_HOURS} HOURS") >= F.col("_first_zero")
    verdict = (
        F.when(~empty, F.when(F.col("reject_streak") >= REJECTED_RUNS, "ALL_REJECTED").otherwise("PRODUCTIVE"))
        .when(F.col("last_productive").isNotNull(), "DROPPED")
        .when((F.col("zero_streak") >= EMPTY_RUNS) & long, "ZERO_YIELD")
        .otherwise("EMPTY")
    )
    return rows.select("id", "source", "channel", "started_at", "zero_streak", "reject_streak", verdict.alias("verdict"))


def overall_yield(states: DataFrame, now) -> DataFrame:
    """One verdict a source: PRODUCTIVE while one of its channels was within FRESH_DAYS, else the worst of its channels."""
    last = states.groupBy("source", "channel").agg(F.max_by("verdict", F.struct("started_at", "id")).alias("verdict"), F.max("started_at").alias("at"))
    fresh = (F.col("verdict") == "PRODUCTIVE") & (F.col("at") > now - F.expr(f"INTERVAL {FRESH_DAYS} DAYS"))
    severity = F.array_position(F.array(*[F.lit(x) for x in YIELD_SEVERITY]), F.col("verdict"))
    worst = F.max_by("verdict", severity)
    return last.groupBy("source").agg(F.when(F.bool_or(fresh), "PRODUCTIVE").otherwise(worst).alias("verdict"), F.count(F.lit(1)).alias("channels"))


def tick_gaps(runs: DataFrame, limit_minutes: int = 20) -> DataFrame:
    """Runs, the last of them, the longest gap in whole minutes and the number of gaps over the limit."""
    gap = (F.unix_timestamp(F.col("started_at").cast("timestamp")) - F.unix_timestamp(F.lag("started_at").over(Window.partitionBy("source").orderBy("started_at", "id")).cast("timestamp"))) / 60
    rows = runs.select("source", "started_at", F.floor(gap + 0.5).cast("long").alias("gap"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("started_at").alias("last"), F.max("gap").alias("longest"), F.count_if(F.col("gap") > limit_minutes).alias("long_gaps"))


def deciding(verdicts: DataFrame) -> DataFrame:
    """Per source the run that decides about its protection: the newest with a verdict; a RECOVERING one only if it protects."""
    told = verdicts.filter("verdict IS NOT NULL AND (verdict <> 'RECOVERING' OR coalesce(protect, false))")
    last = told.groupBy("source").agg(F.max_by(F.struct("id", "verdict", "protect"), F.struct("started_at", "id")).alias("r"))
    return last.select("source", "r.*")


def _flag() -> Column:
    """Whether a run protects: its own word, else its verdict's (rows older than the flag)."""
    return F.coalesce("protect", F.col("verdict").isin(*PROTECTIVE))


def protection(verdicts: DataFrame, readable: Column | None = None) -> DataFrame:
    """source, status, protected, basis and may_disappear of each source's runs (id, started_at, verdict, protect).

    basis: verdict, none (no run decides: nothing to protect from) or unreadable: where `readable`, a condition on the
    source, does not hold, the source is protected whatever its runs say. may_disappear: whether a listing that the
    source no longer shows may be acted on, for which only a HEALTHY verdict will do.
    """
    rows = verdicts.select("source").distinct().join(deciding(verdicts), "source", "left")
    known = F.col("verdict").isNotNull()
    read = F.lit(True) if readable is None else F.coalesce(readable, F.lit(False))
    guarded = F.when(~read, True).when(known, _flag()).otherwise(False)
    status = F.when(read, F.col("verdict"))
    return rows.select(
        "source", status.alias("status"), guarded.alias("protected"), F.when(~read, "unreadable").when(known, "verdict").otherwise("none").alias("basis"),
        F.coalesce(~guarded & (status == "HEALTHY"), F.lit(False)).alias("may_disappear"),
    )


def anomaly_streak(verdicts: DataFrame) -> DataFrame:
    """source and the flagged runs since its last unflagged verdict; RECOVERING runs that do not protect neither count nor end it."""
    told = verdicts.filter("verdict IS NOT NULL AND (verdict <> 'RECOVERING' OR coalesce(protect, false))").withColumn("flagged", _flag())
    newest = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    open_ = told.withColumn("ended", F.sum(F.when(F.col("flagged"), 0).otherwise(1)).over(newest)).filter("ended = 0")
    return open_.groupBy("source").agg(F.count(F.lit(1)).alias("streak"))


#: Passes missed before an item is flagged, and the share of missed items from which a pass of so many counts for none.
MISSED_PASSES, GUARD_SHARE, GUARD_LEAST = 2, 0.2, 20


def counted_passes(passes: DataFrame) -> DataFrame:
    """source, pass_at and done_at of the complete HEALTHY passes."""
    return passes.filter("verdict = 'HEALTHY' AND coalesce(complete, false) AND source IS NOT NULL AND pass_at IS NOT NULL").select("source", "pass_at", "done_at").distinct()


def last_seen_sweep(sightings: DataFrame, passes: DataFrame, placed: bool = False) -> DataFrame:
    """source, item, missed and flagged: the passes in a row that each item was not seen in, flagged from the second on.

    sightings: source, item, seen_at. passes: source, pass_at, done_at, and the gate: verdict, complete; only complete
    HEALTHY passes are counted, and passes of a source do not overlap. An item is seen in a pass when a sighting lies
    between its start and its end; that, or any sighting of a flagged item, starts its count anew. A pass that misses
    more than GUARD_SHARE of the GUARD_LEAST or more items known by its end counts for none of them: it is the source
    that failed. Starts, sightings and ends are counted in order of time within each day of a source, from what the days
    before leave; a count of missed passes is a difference of running totals, so work grows with sightings and passes.
    Where sightings are placed, pass_at tells the counted pass that each lies in (null: none) and nothing else does; of
    those in one pass the first is enough.
    """
    inside = F.lit(None).cast("boolean").alias("inside")
    if placed:
        between = F.when(F.col("pass_at").isNull(), F.col("seen_at")).alias("between")
        sightings = sightings.groupBy("source", "item", "pass_at", between).agg(F.min("seen_at").alias("seen_at"))
    good = counted_passes(passes)
    none = lambda frame, column: F.lit(None).cast(frame.schema[column].dataType)
    # at one time starts come before sightings and ends after them
    starts = good.select("source", none(sightings, "item").alias("item"), F.col("pass_at").alias("at"), F.lit(0).alias("kind"), F.struct("pass_at", "done_at").alias("pass"), inside)
    no_pass = F.lit(None).cast(starts.schema["pass"].dataType).alias("pass")
    seen = sightings.select("source", "item", F.col("seen_at").alias("at"), F.lit(1).alias("kind"), no_pass, F.col("pass_at").isNotNull().alias("inside") if placed else inside)
    ends = good.filter("done_at IS NOT NULL").select("source", none(sightings, "item").alias("item"), F.col("done_at").alias("at"), F.lit(2).alias("kind"), no_pass, inside)
    rows = starts.unionByName(seen).unionByName(ends).withColumn("day", F.to_date("at"))
    days = rows.groupBy("source", "day").agg(F.count_if(F.col("kind") == 0).alias("starts"), F.count_if(F.col("kind") == 2).alias("ends"), F.max("pass").alias("pass"))
    past = Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("source", "day", F.sum("starts").over(past).alias("starts0"), F.sum("ends").over(past).alias("ends0"), F.max("pass").over(past).alias("pass0"))
    so_far = Window.partitionBy("source", "day").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"starts": F.count_if(F.col("kind") == 0).over(so_far), "ends": F.count_if(F.col("kind") == 2).over(so_far), "pass": F.max("pass").over(so_far)})
    rows = rows.filter("kind = 1").join(days, ["source", "day"], "left")
    total = lambda c: (F.col(c) + F.coalesce(F.col(f"{c}0"), F.lit(0))).cast("long")
    in_pass = F.col("inside") if placed else F.coalesce(F.col("at") <= F.coalesce("pass", "pass0")["done_at"], F.lit(False))
    # one row for an item and a pass, or the time until the next; before: passes over before the first sighting
    seen = rows.groupBy("source", "item", total("starts").alias("k"), in_pass.alias("in_pass")).agg(F.min(total("ends")).alias("before"))
    seen = stage(seen, "placed")
    items = seen.groupBy("source", "item").agg((F.min("before") + 1).alias("known_from"), F.coalesce(F.max(F.when(F.col("in_pass"), F.col("k"))), F.lit(0)).alias("last"))
    found = seen.filter("in_pass").groupBy("source", "k").agg(F.count(F.lit(1)).alias("found"))
    added = items.groupBy("source", F.col("known_from").alias("k")).agg(F.count(F.lit(1)).alias("added"))
    each = good.select("source", F.row_number().over(Window.partitionBy("source").orderBy("pass_at", "done_at")).cast("long").alias("k"))
    each = each.join(found, ["source", "k"], "left").join(added, ["source", "k"], "left")
    running = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("source", "k", F.coalesce("found", F.lit(0)).alias("found"), F.sum(F.coalesce("added", F.lit(0))).over(running).alias("known"))
    counts = ~((F.col("known") >= GUARD_LEAST) & ((F.col("known") - F.col("found")) / F.col("known") > GUARD_SHARE))
    each = each.select("source", "k", F.sum(counts.cast("long")).over(running).alias("counted"))  # passes that count, up to the k-th

    items = items.select("source", "item", F.greatest(F.col("last") + 1, F.col("known_from")).alias("after"))
    again = seen.filter("NOT in_pass").select(F.col("source").alias("s"), F.col("item").alias("i"), "k")
    again = again.join(items, (F.col("s") == F.col("source")) & F.col("i").eqNullSafe(F.col("item"))).filter("k >= after").select("source", "item", "k").join(each, ["source", "k"])
    again = again.groupBy(F.col("source").alias("s"), F.col("item").alias("i")).agg(F.sort_array(F.collect_set("counted")).alias("again"))
    whole = each.groupBy("source").agg(F.max("counted").alias("whole"))
    rows = items.join(again, (F.col("s") == F.col("source")) & F.col("i").eqNullSafe(F.col("item")), "left").drop("s", "i").join(whole, "source", "left")
    rows = rows.join(each.select("source", (F.col("k") + 1).alias("after"), F.col("counted").alias("passed")), ["source", "after"], "left")
    # a sighting between passes starts a flagged item's count anew
    base = F.aggregate(F.coalesce("again", F.array().cast("array<bigint>")), F.coalesce("passed", F.lit(0).cast("long")), lambda b, c: F.when(c - b >= MISSED_PASSES, c).otherwise(b))
    missed = F.coalesce(F.col("whole") - base, F.lit(0)).cast("long")
    return rows.select("source", "item", missed.alias("missed")).withColumn("flagged", F.col("missed") >= MISSED_PASSES)


def coverage_flags(auctions: DataFrame, properties: DataFrame, over) -> DataFrame:
    """current and actionable for each round: published and open or postponed; with a price, a start and an address too."""
    rows = auctions.join(properties.select(F.col("id").alias("property_id"), F.col("status").alias("property_status"), "address_text", "geo_city"), "property_id")
    open_ = F.col("status").isin("UPCOMING", "LIVE", "AUCTION_TODAY") & ~over
    current = (F.col("property_status") == "PUBLISHED") & (open_ | (F.col("status") == "POSTPONED"))
    actionable = current & (F.col("reserve_price") > 0) & F.col("auction_start").isNotNull() & (F.col("address_text").isNotNull() | F.col("geo_city").isNotNull())
    return rows.select("id", "bank_id", current.alias("current"), F.coalesce(actionable, F.lit(False)).alias("actionable"))


def acceptance(verdicts: DataFrame) -> DataFrame:
    """source, id and outcome: may the size of a source's deciding run become its baseline? Only where that run is flagged
    and measured the whole source cleanly. verdicts: id, source, started_at, verdict, protect, records, blocked,
    structure_changed, failed, eligible, complete.
    """
    details = verdicts.select("source", "id", "records", "blocked", "structure_changed", "failed", "eligible", "complete")
    rows = verdicts.select("source").distinct().join(deciding(verdicts), "source", "left").join(details, ["source", "id"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = (
        F.when(~F.coalesce(_flag(), F.lit(False)), "nothing to accept")
        .when(F.col("verdict").isin("BLOCKED", "FAILED", "NO_DATA"), "not trustworthy")
        .when(yes("blocked") | yes("structure_changed") | yes("failed"), "not clean")
        .when(~F.coalesce("eligible", F.lit(True)), "a slice")
        .when(~F.coalesce("complete", F.lit(True)), "not complete")
        .when(F.coalesce("records", F.lit(0)) <= 0, "empty")
        .otherwise("accepted")
    )
    return rows.select("source", "id", outcome.alias("outcome"))


#: Minutes after which a claim is stale, and between the starts of two ticks.
CLAIM_STALE, TICK_GAP = 6, 3


def lease(markers: DataFrame, now: Column) -> DataFrame:
    """key, winner, waiting and blocked of the claims of each key (key, id, kind, at): claim, claim_done or tick.

    Of the claims that are neither stale nor released (by a later claim_done) the earliest holds the lease, ties by id.
    No tick may start while one holds it, nor within TICK_GAP minutes of the start of the last.
    """
    age = lambda minutes: F.col("at") > now - F.expr(f"INTERVAL {minutes} MINUTES")
    released = markers.filter("kind = 'claim_done'").groupBy("key").agg(F.max("at").alias("released"))
    rows = markers.filter(F.col("at") <= now).join(released, "key", "left")
    live = (F.col("kind") == "claim") & age(CLAIM_STALE) & F.coalesce(F.col("at") >= F.col("released"), F.lit(True))
    ticked = (F.col("kind") == "tick") & age(TICK_GAP)
    out = rows.groupBy("key").agg(F.min_by(F.when(live, F.col("id")), F.when(live, F.struct("at", "id"))).alias("winner"), F.count_if(live).alias("waiting"), F.bool_or(ticked).alias("ticked"))
    return out.select("key", "winner", "waiting", F.when(F.col("waiting") > 0, "another tick is running").when(F.col("ticked"), "a tick just ran").alias("blocked"))


HEADER = "[DATA_ENGINE_V1] "


def header(message: Column) -> Column:
    """The JSON of a message's first line, null without one."""
    return F.nullif(F.regexp_extract(message, r"^\[DATA_ENGINE_V1\] (\{[^\n]*\})\n", 1), F.lit(""))


def with_header(full: Column, short: Column, text: Column, most: int = 2000) -> Column:
    """A message with its metrics before it: in full, or where that is too long the short ones and as much text as fits."""
    whole = F.concat(F.lit(HEADER), full, F.lit("\n"), text)
    return F.when(F.length(whole) <= most, whole).otherwise(F.substring(F.concat(F.lit(HEADER), short, F.lit("\n"), text), 1, most))


def time_shares(sources: Column, importing, limits: dict[bool, tuple[int, int, int]], seconds: int) -> Column:
    """array of struct(source, seconds) for an array of sources in turn: a weighted share of the time left, between a least and a most.

    limits: least, most and weight of importing and of other sources. A source for which less than its least is left
    gets null.
    """
    pick = lambda s, k: F.when(importing(s), limits[True][k]).otherwise(limits[False][k]).cast("long")
    empty = F.array().cast("array<struct<source:string,seconds:bigint>>")
    start = F.struct(F.lit(seconds).cast("long").alias("left"), F.aggregate(sources, F.lit(0).cast("long"), lambda a, s: a + pick(s, 2)).alias("weights"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        share = F.floor(acc["left"] * pick(s, 2) / acc["weights"]).cast("long")
        given = F.when(acc["left"] >= pick(s, 0), F.least(acc["left"], F.greatest(pick(s, 0), F.least(pick(s, 1), share))))
        return F.struct(
            (acc["left"] - F.coalesce(given, F.lit(0).cast("long"))).alias("left"), (acc["weights"] - pick(s, 2)).alias("weights"),
            F.concat(acc["out"], F.array(F.struct(s.alias("source"), given.alias("seconds")))).alias("out"),
        )

    return F.aggregate(sources, start, step, lambda acc: acc["out"])
