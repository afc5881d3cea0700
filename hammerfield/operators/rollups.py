"""Grouped counts, roll-ups of places, top rows of groups, trends and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents with the number of their children, 0 without any."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return parents.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def city_summary(active: DataFrame, everything: DataFrame, priority: Sequence[str]) -> DataFrame:
    """city, active and total of rows with a city; the cities of the list first, then by active count, then by name."""
    a = active.filter("city IS NOT NULL").groupBy("city").agg(F.count(F.lit(1)).alias("active"))
    t = everything.filter("city IS NOT NULL").groupBy("city").agg(F.count(F.lit(1)).alias("total"))
    listed = F.array(*[F.lit(x) for x in priority])
    out = t.join(a, "city", "full_outer").select("city", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("total", F.lit(0)).alias("total"))
    rank = F.coalesce(F.nullif(F.array_position(listed, F.col("city")), F.lit(0)), F.lit(999))
    return out.withColumn("place", F.row_number().over(Window.orderBy(rank, F.desc("active"), "city")).cast("long"))


def places_rollup(df: DataFrame) -> DataFrame:
    """Counts by state, by state and city, and over all, in one pass."""
    return df.rollup("state", "city").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def areas_by_city(df: DataFrame) -> DataFrame:
    """city and its distinct areas apart from case: the first spelling by preference, sorted."""
    first = Window.partitionBy("city", F.lower("area")).orderBy("preference", "area")
    one = df.filter("city IS NOT NULL AND area IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return one.groupBy("city").agg(F.array_sort(F.collect_list("area")).alias("areas"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def trend(readings: DataFrame) -> DataFrame:
    """scope, date, value of the last reading of each date, its change to the date before and the days left out between."""
    last = readings.groupBy("scope", "date").agg(F.max_by("value", "at").alias("value"))
    w = Window.partitionBy("scope").orderBy("date")
    gap = F.greatest(F.lit(0), F.datediff("date", F.lag("date").over(w)) - 1)
    return last.select("scope", "date", "value", (F.col("value") - F.lag("value").over(w)).alias("change"), gap.alias("gap_days"))


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """df with streak: how many rows up to this one, in order, meet the condition without a break."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_hit", F.coalesce(condition, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.col("_hit").cast("long")).over(inside)).drop("_hit", "_island")


def changes_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Rows whose value differs from the one before in their series; the first row of each."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_keep", (n == 1) | ~value.eqNullSafe(before)).filter("_keep").drop("_keep")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is not positive."""
    return F.when(b > 0, a / b)


def trailing_sums(rows: DataFrame, key: str, at: str, value: str, span: int) -> DataFrame:
    """rows with `used`, the sum of whole numbers `value` over the rows of the key in (at - span, at]; at are whole numbers.

    What a row adds it takes away again `span` later, so the sum is a running one over the key's distinct times, whatever
    a span holds. It runs within stretches of one span, beginning with what all stretches before leave. Null where the
    span holds no value; rows with a null time are each other's span.
    """
    once = rows.groupBy(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at")).agg(F.sum(value).cast("long").alias("v"), F.count(value).alias("n"))
    ends = once.filter("_at IS NOT NULL").select("_key", F.col("_at") + span, -F.col("v"), -F.col("n"))
    steps = once.union(ends).groupBy("_key", "_at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).withColumn("part", F.floor(F.col("_at") / span))
    before = Window.partitionBy("_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = steps.filter("part IS NOT NULL").groupBy("_key", "part").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    parts = parts.select(F.col("_key").alias("k"), F.col("part").alias("p"), F.sum("v").over(before).alias("v0"), F.sum("n").over(before).alias("n0"))
    inside = Window.partitionBy("_key", "part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select("_key", "_at", "part", F.sum("v").over(inside).alias("v"), F.sum("n").over(inside).alias("n"))
    sums = sums.join(parts, F.col("_key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")), "left")
    total = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    sums = sums.select("_key", "_at", F.when(total("n", "n0") > 0, total("v", "v0")).alias("used"))
    return rows.join(sums, F.col(key).eqNullSafe(F.col("_key")) & F.col(at).cast("long").eqNullSafe(F.col("_at")), "left").drop("_key", "_at")
