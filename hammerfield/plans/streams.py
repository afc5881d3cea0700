"""Queries: streams that resume, keep state with timers, or join two streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..streaming import feeds as S
from ..streaming import ticks as D
from .proxies import Views
from .registry import query
from .runlog import LAST_SEEN, sightings_and_passes


@query("st21_feed_resume", "SELECT id, source, kind, created FROM run_log")
def st21_feed(v: Views):
    """Runs as files of JSON lines of each source, read by a stream in two runs, the second after more files have come."""
    home = D.new_dir(v.spark, "feed")
    rows = v.run_log.select("source", F.col("id") % 3 == 0, F.to_json(F.struct("id", "kind", "created")).alias("value")).toDF("source", "late", "value")
    for late in (False, True):
        rows.filter(F.col("late") == late).select("source", "value").write.mode("append").partitionBy("source").text(f"{home}/in")
        S.import_feed(S.read_feed(v.spark, f"{home}/in", f"{home}/cursor/at"), f"{home}/out", f"{home}/state")
    found = v.spark.read.parquet(f"{home}/out").select(F.regexp_extract("file", "source=([^/]+)/", 1).alias("source"), F.from_json("record", "id long, kind string, created int").alias("r"))
    return found.select("r.id", "source", "r.kind", "r.created")


@query("st26_recovery_stream")
def st26_stream(v: Views):
    """The verdicts and recovery of the run log as a stream; rows without an id are timers."""
    runs = D.read_runs(v.spark, f"{v.sf_dir}/events.parquet").withColumn("started_at", F.col("ts"))
    source = F.concat(F.lit("src"), (F.col("user_id") % 8).cast("string"))
    runs = runs.select(F.col("event_id").alias("id"), source.alias("source"), "started_at", F.floor("value").cast("double").alias("records"), (F.col("event_id") % 37 > 0).alias("complete"), (F.col("event_type") == "error").alias("blocked"))
    return D.run_ticks(S.health_stream(runs), "health").select("id", "source", "verdict", "protect", "action", "state", "attempts")


@query("st25_last_seen_stream", LAST_SEEN)
def st25_stream(v: Views):
    """The sweep of the whole log from sightings that a join of two streams has placed in the passes that count."""
    seen, passes = sightings_and_passes(v)
    home = D.new_dir(v.spark, "sightings")
    instants = lambda f, *cols: f.withColumns({c: F.col(c).cast("timestamp") for c in cols})
    none = F.lit("")  # not null: a join drops null keys before they can move a watermark
    instants(seen, "seen_at").write.parquet(f"{home}/seen")
    instants(Q.counted_passes(passes), "pass_at", "done_at").write.parquet(f"{home}/done")
    # rows of a later time let the watermarks pass all others
    end = v.run_log.agg((F.max("started_at") + F.expr("INTERVAL 90 DAYS")).cast("timestamp").alias("t"))
    for _ in range(2):
        end.select(none.alias("source"), none.alias("item"), F.col("t").alias("seen_at")).write.mode("append").parquet(f"{home}/seen")
        end.select(none.alias("source"), F.col("t").alias("pass_at"), F.col("t").alias("done_at")).write.mode("append").parquet(f"{home}/done")
    open_ = lambda name: v.spark.readStream.schema(v.spark.read.parquet(f"{home}/{name}").schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/{name}")
    placed = D.run_ticks(S.placed_sightings(open_("seen"), open_("done"), longest="60 days"), "placed", "append").filter("source <> ''")
    return Q.last_seen_sweep(placed.select("source", "item", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), "pass_at"), passes, placed=True)
