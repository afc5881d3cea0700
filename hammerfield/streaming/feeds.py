"""Streams over record feeds, source health and sightings."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import health as H
from ..sources.feed import RecordFeed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_feed(spark: SparkSession, path: str, cursor: str, batch: int | None = None) -> DataFrame:
    """Stream of the records of a folder of JSON lines files; it resumes where it stopped. batch: records of a file a batch."""
    spark.dataSource.register(RecordFeed)
    rows = spark.readStream.format("record_feed").option("path", path).option("cursor", cursor)
    return (rows if batch is None else rows.option("batch", str(batch))).load()


def import_feed(rows: DataFrame, out: str, state: str) -> None:
    """Write all records that a feed has at the moment as batches under `out`, one folder a batch, and stop.

    A batch that runs again overwrites its own folder, and `state`, the stream's checkpoint, makes the next call go on
    after the last one, so calling this twice on a growing folder gives what one call at the end gives.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.option("checkpointLocation", state).foreachBatch(write).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


# -- source health ---------------------------------------------------------------------------------------------------


def runs_in_order(frames: Iterator[pd.DataFrame], most: int = 100_000) -> Iterator[dict]:
    """The runs of frames (id, started_at and RUN's columns) by time, then id: RUN's values, id and `at` in microseconds.

    No more than about `most` rows are held: sorted stretches of that size wait in temporary files until they are merged.
    """
    kinds = {"double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([("at", pa.int64()), ("id", pa.int64()), *((c, kinds[kind]) for c, (kind, _) in H.RUN.items())])

    def rows(batches) -> Iterator[dict]:
        return (row for batch in batches for row in batch.to_pylist())

    def table(frame: pd.DataFrame) -> pa.Table:
        # microseconds, as everywhere in the fold
        at = frame["started_at"].to_numpy().astype("datetime64[us]").astype("int64")
        return pa.Table.from_arrays([pa.array(at), *(pa.array(frame[c], schema.field(c).type, from_pandas=True) for c in schema.names[1:])], schema=schema)

    def in_order(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).sort_by([("at", "ascending"), ("id", "ascending")])

    with tempfile.TemporaryDirectory() as home:
        files, held = [], []
        for frame in frames:
            held.append(table(frame))
            if sum(map(len, held)) >= most:
                files.append(f"{home}/{len(files)}")
                with pa.OSFile(files[-1], "wb") as f, pa.ipc.new_file(f, schema) as out:
                    out.write_table(in_order(held), max_chunksize=1000)
                held = []
        stretches = [rows(map(f.get_batch, range(f.num_record_batches))) for f in (pa.ipc.open_file(pa.OSFile(path)) for path in files)]
        if held:
            stretches.append(rows(in_order(held).to_batches(max_chunksize=1000)))
        yield from heapq.merge(*stretches, key=lambda row: (row["at"], row["id"] is None, row["id"] or 0))


class HealthProcessor(StatefulProcessor):
    """The fold of operators/health.py as the state of each source.

    Timers in event time: one tells when an open request for a recovery pass is a day old (a row with the action OVERDUE
    and no id; the request itself ends with the source's next run, as in the batch), one forgets sources that have had no
    run for KEPT_DAYS.
    """

    KEPT_DAYS = 60
    ROWS = 10_000  # of a frame that is given out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("source", "state string, last long, told long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, last, told = self.held.get() if self.held.exists() else (None, 0, 0)
        source = H.Source.load(text) if text else H.Source()
        out = []
        for run in runs_in_order(rows):
            out.append((run["id"], key[0], run["at"], *H.advance(source, run, run["at"])))
            last = max(last, run["at"])
            if len(out) == self.ROWS:
                yield self._frame(out)
                out = []
        self._update(source, last, told)
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in H.OUT.split(", ")])
        frame["started_at"] = pd.to_datetime(frame["started_at"], unit="us")
        return frame.astype({"id": "Int64", "baseline": "float64", "page_baseline": "float64", "attempts": "int32"})

    def _update(self, source: H.Source, last: int, told: int) -> None:
        self.held.update((source.dump(), last, told))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if source.open_at is not None and source.open_at != told:
            self.handle.registerTimer(self._overdue(source))
        self.handle.registerTimer((last + self.KEPT_DAYS * H.DAY) // 1000)

    @staticmethod
    def _overdue(source: H.Source) -> int:
        return (source.open_at + H.EXPIRY_HOURS * H.HOUR) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, last, told = self.held.get()
        source, at = H.Source.load(text), expiredTimerInfo.getExpiryTimeInMs()
        if source.open_at is not None and source.open_at != told and at == self._overdue(source):
            self.held.update((text, last, source.open_at))
            row = (None, key[0], pd.Timestamp(at, unit="ms"), None, None, None, None, None, None, "OVERDUE", source.state, len(source.queued))
            yield pd.DataFrame([row], columns=[x.split()[0] for x in H.OUT.split(", ")]).astype({"id": "Int64", "baseline": "float64", "page_baseline": "float64", "protect": "boolean", "attempts": "int32"})
        elif at >= (last + self.KEPT_DAYS * H.DAY) // 1000:
            self.held.clear()

    def close(self) -> None:
        pass


def health_stream(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """The rows of operators.health.source_health for a stream of runs that come in order of time, and OVERDUE rows.

    runs as there, with started_at as an instant. State is kept in RocksDB, which this sets for the session.
    """
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = H.run_rows(runs).withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late)
    out = ", ".join(f"{n} {t}" for n, t in (x.split() for x in H.OUT.split(", ")))
    return rows.groupBy("source").transformWithStateInPandas(HealthProcessor(), outputStructType=out, outputMode="Update", timeMode="EventTime")


# -- sightings ---------------------------------------------------------------------------------------------------------


def placed_sightings(sightings: DataFrame, passes: DataFrame, late: str = "1 day", longest: str = "2 days", slice_seconds: int = 60) -> DataFrame:
    """Each sighting (source, item, seen_at) with the pass (source, pass_at, done_at) that it lies in, nulls where none does.

    Both are streams, passes end within `longest` and rows come within `late`; an outer join of streams keeps a sighting
    until no pass can come that it could lie in. A pass is kept for each slice of time that it touches and a sighting for
    its own, so a row meets the rows of a source's slice and not all of the source. State is in RocksDB, which this sets
    for the session.
    """
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    place = lambda c: F.floor(F.unix_micros(c) / (slice_seconds * 1_000_000))
    seen = sightings.withWatermark("seen_at", late).withColumn("place", place(F.col("seen_at")))
    done = passes.select(F.col("source").alias("of"), "pass_at", "done_at").withWatermark("done_at", late)
    first = F.greatest(F.col("pass_at"), F.col("done_at") - F.expr(f"INTERVAL {longest}"))  # no sighting before is in reach
    done = done.filter("pass_at <= done_at").withColumn("at", F.explode(F.sequence(place(first), place(F.col("done_at")))))
    near: Column = (F.col("source") == F.col("of")) & (F.col("place") == F.col("at"))
    inside = (F.col("seen_at") >= F.col("pass_at")) & (F.col("seen_at") <= F.col("done_at")) & (F.col("done_at") <= F.col("seen_at") + F.expr(f"INTERVAL {longest}"))
    return seen.join(done, near & inside, "left_outer").drop("of", "place", "at")
