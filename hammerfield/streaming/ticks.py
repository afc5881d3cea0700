"""Structured Streaming over the run log: micro-batches, event-time windows, deduplication and change-only state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.staging import shared_dir


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_runs(spark: SparkSession, path: str, files_per_tick: int = 1) -> DataFrame:
    """Stream of the files of path's folder that have path's name (a pattern), with ts as an instant, which watermarks need."""
    schema, (folder, _, name) = spark.read.parquet(path).schema, path.rpartition("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_tick).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_ticks(rows: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there; its batches as written, with their number in `tick`.

    Each batch overwrites its own folder, so a batch that runs again leaves the same rows.
    """
    spark = rows.sparkSession
    out = new_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/tick={number}")

    stream = rows.writeStream.outputMode(mode).option("checkpointLocation", new_dir(spark, f"{name}-state")).trigger(availableNow=True)
    stream.foreachBatch(write).start().awaitTermination()
    return spark.read.option("basePath", out).schema(T.StructType([*rows.schema.fields, T.StructField("tick", T.IntegerType())])).parquet(out)


def latest_tick(rows: DataFrame, *keys: str) -> DataFrame:
    """The newest version of each key that update-mode ticks have given."""
    newest = Window.partitionBy(*keys).orderBy(F.col("tick").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "tick")


def daily_counts(runs: DataFrame, late: str = "60 days") -> DataFrame:
    """Runs of each kind in each day by event time; days older than the watermark are closed and their state dropped."""
    day = F.window("ts", "1 day")
    counted = runs.withWatermark("ts", late).groupBy(day.alias("w"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("date").cast("string").alias("day"), "kind", "n")


def first_seen(runs: DataFrame, key: str, late: str = "60 days") -> DataFrame:
    """One row for each key within the watermark."""
    return runs.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]).select(key)


def changes_only(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the number of value changes so far, from a state of one value and one count for each key."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows[value]:
            if last is None or v != last:
                last, n = v, n + 1
        state.update((last, n))
        yield pd.DataFrame({"key": [k[0]], "changes": [n]})

    rows = runs.select(F.col(key).cast("long").alias(key), value, "ts", "event_id")
    return rows.groupBy(key).applyInPandasWithState(fold, "key long, changes long", "last string, n long", "update", GroupStateTimeout.NoTimeout)
