"""Staged, set-based import: reasons, merges, upserts, change rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .resolution import alike_sets


def reasons(**conditions: Column) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n.replace("_", " "))) for n, c in conditions.items()]))


def first_reason(**conditions: Column) -> Column:
    return F.get(reasons(**conditions), F.lit(0))


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """stored with the rows of incoming in place of those of the same key; a later incoming row of a key wins by seq."""
    newest = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).filter("_n = 1").drop("_n", "seq")
    return stored.join(newest.select(*key), list(key), "left_anti").unionByName(newest)


def insert_absent(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of incoming whose key is not stored, once each."""
    return incoming.join(stored.select(*key), list(key), "left_anti").dropDuplicates(list(key))


def fill_only(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """stored with empty columns filled from incoming; a value that is there is never changed."""
    new = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = stored.join(new, key, "left")
    return joined.select(key, *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.col(f"_{c}").cast("string")).alias(c) for c in columns])


def change_rows(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, field, old, new of each column that differs, nulls compared as values."""
    joined = old.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in columns]).join(new.select(key, *[F.col(c).cast("string").alias(f"n_{c}") for c in columns]), key)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new")) for c in columns])
    return joined.select(key, F.explode(F.filter(rows, lambda r: ~r["old"].eqNullSafe(r["new"]))).alias("r")).select(key, "r.field", "r.old", "r.new")


def import_outcomes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """row, outcome, known: what a staged import does with each row (row, key, start, price), set by set.

    Rows of one key and start in the batch count once, the first of them; a known key is a new round when it starts more
    than 36 hours after the stored one, otherwise it enriches; an unknown key is created; rows with reasons are skipped.
    """
    why = reasons(no_key=F.col("key").isNull(), no_price=F.col("price").isNull() | (F.col("price") <= 0), no_start=F.col("start").isNull())
    staged = incoming.withColumn("why", why)
    w = Window.partitionBy("key", "start").orderBy("row")
    staged = staged.withColumn("_first", F.when(F.size("why") == 0, F.row_number().over(w) == 1).otherwise(F.lit(True)))
    known = stored.select("key", F.col("id").alias("known"), F.col("start").alias("stored_start"))
    out = staged.join(known, "key", "left")
    outcome = (
        F.when(F.size("why") > 0, F.concat(F.lit("skip: "), F.array_join("why", ", ")))
        .when(~F.col("_first"), "repeated")
        .when(F.col("known").isNull(), "create")
        .when(F.col("start") > F.col("stored_start") + F.expr("INTERVAL 36 HOURS"), "round")
        .otherwise("enrich")
    )
    return out.select("row", outcome.alias("outcome"), "known")


def match_known(incoming: DataFrame, known: DataFrame, block: Sequence[str], least: float = 0.8) -> DataFrame:
    """row, known and method of each incoming row (row, ext_id, key, tokens and the block columns): the known listing (id and
    the same columns) of its own external id, else of its key, else the first of its block that is alike; null without one.

    Each step joins what the steps before left over. Likeness is told between distinct token sets.
    """
    first = lambda rows, *by: rows.groupBy(*by).agg(F.min("id").alias("known"))
    told = lambda rows, method: rows.select("row", "known", F.lit(method).alias("method"))
    by_id = incoming.join(first(known.filter("ext_id IS NOT NULL"), "ext_id"), "ext_id")
    rest = incoming.join(by_id.select("row"), "row", "left_anti")
    by_key = rest.join(first(known.filter("key IS NOT NULL"), "key"), "key")
    rest = rest.join(by_key.select("row"), "row", "left_anti").withColumn("words", F.array_sort(F.array_distinct("tokens")))
    known_sets = first(known.withColumn("words", F.array_sort(F.array_distinct("tokens"))), *block, "words")
    both = known_sets.select(*block, "words", F.lit(1).alias("n")).unionByName(rest.select(*block, "words", F.lit(1).alias("n"))).distinct()
    # sets are named by a hash of their words
    sets = both.filter(F.size("words") > 0).withColumn("first", F.sha2(F.to_json("words"), 256))
    near = alike_sets(sets, list(block), least).select(*block, "a", "b")
    pairs = near.unionByName(near.select(*block, F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(sets.select(*block, F.col("first").alias("a"), F.col("first").alias("b")))
    named = known_sets.withColumn("b", F.sha2(F.to_json("words"), 256)).select(*block, "b", "known")
    best = pairs.join(named, [*block, "b"]).groupBy(*block, "a").agg(F.min("known").alias("known"))
    alike = rest.withColumn("a", F.sha2(F.to_json("words"), 256)).join(best, [*block, "a"])
    found = told(by_id, "id").unionByName(told(by_key, "key")).unionByName(told(alike, "alike"))
    return incoming.select("row").join(found, "row", "left")


def import_counted(outcomes: DataFrame, path: str, kind: str = "outcome") -> dict[str, int]:
    """Write import outcomes as Parquet and return how many rows had each, counted in the write itself.

    The counters are metrics of the job that writes: rows are not read twice, and a task that runs again counts once.
    """
    seen = Observation("import")
    names = ["create", "enrich", "round", "repeated", "skip"]
    is_ = lambda n: F.col(kind).startswith("skip") if n == "skip" else F.col(kind) == n
    metrics = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(is_(n), F.lit(False))).alias(n) for n in names]]
    outcomes.observe(seen, *metrics).write.parquet(path)
    return dict(seen.get)
