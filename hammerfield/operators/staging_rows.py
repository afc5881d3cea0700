"""Rows of a crawl on their way in: staging, outcomes, file plans, the next page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage


def staging_rows(cards: DataFrame, staged: DataFrame, stored: DataFrame, known: DataFrame, needed: Sequence[str]) -> DataFrame:
    """key, state and missing of the first card (page_id) of each key that is not staged yet.

    state: in database, known, or new; missing: the needed fields that the card lacks.
    """
    first = cards.groupBy("key").agg(F.min_by(F.struct(*needed), "page_id").alias("card")).join(staged.select("key").distinct(), "key", "left_anti")
    marked = first.join(stored.select("key").distinct().withColumn("_stored", F.lit(True)), "key", "left").join(known.select("key").distinct().withColumn("_known", F.lit(True)), "key", "left")
    state = F.when(F.col("_stored"), "in database").when(F.col("_known"), "known").otherwise("new")
    missing = F.array_compact(F.array(*[F.when(F.col(f"card.{c}").isNull(), F.lit(c)) for c in needed]))
    return marked.select("key", state.alias("state"), missing.alias("missing"))


def until_streak(rows: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column, most: int) -> DataFrame:
    """The rows of each key up to the one that completes `most` in a row that meet the condition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_hit", F.coalesce(condition, F.lit(False)))
    last = w.rowsBetween(1 - most, 0)
    full = (F.sum(F.col("_hit").cast("int")).over(last) == most)
    marked = marked.withColumn("_full", full.cast("int"))
    return marked.withColumn("_ended", F.coalesce(F.max("_full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("_ended = 0").drop("_hit", "_full", "_ended")


def file_plan(files: DataFrame, stored: DataFrame, state: str, most: int) -> DataFrame:
    """file and plan of each file (file, id, state): the first of an id counts, of these at most so many, of one state."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("file"))
    judged = files.withColumn("_n", first).withColumn("plan", F.when(F.col("_n") > 1, "duplicate").when(F.col("state") != state, "invalid"))
    # only those within the limit need a place; the limit bounds them
    chosen = judged.filter("plan IS NULL").orderBy("file").limit(most).select("file", F.lit(True).alias("_in"))
    marked = judged.join(chosen, "file", "left").join(stored.select("id", F.lit(True).alias("_stored")), "id", "left")
    plan = F.coalesce("plan", F.when(F.col("_in").isNull(), "over limit").when(F.col("_stored"), "already stored").otherwise("new"))
    return marked.select("file", plan.alias("plan"))


def next_pages(rows: DataFrame, visited: DataFrame) -> DataFrame:
    """page_id and next: u of each row (page_id, url, u), null unless it is another page of the same host, by https, not visited."""
    host = lambda c: F.regexp_extract(F.lower(c), "^[a-z]+://([^/?#:]+)", 1)
    good = F.col("u").startswith("https://") & (host(F.col("u")) == host(F.col("url"))) & (F.col("u") != F.col("url"))
    marked = rows.join(visited.select("u", F.lit(True).alias("_seen")), "u", "left")
    return marked.select("page_id", F.when(good & F.col("_seen").isNull(), F.col("u")).alias("next"))


def crawl(links: DataFrame, start: DataFrame, weights: dict[str, int], per_round: int, most_of_kind: int, rounds: int) -> DataFrame:
    """url, kind, depth and round of the pages that a crawl takes, over known links (source, url, kind, bonus).

    From the frontier each round takes the per_round pages of highest priority (the weight of the kind, less the depth,
    plus the link's bonus; ties by url), at most most_of_kind of a kind in all. Of several links to a page the first to
    be seen counts. It ends with an empty frontier or after the rounds.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("kind")), F.lit(0))
    frontier = stage(start.select("url", "kind", F.lit(0).alias("depth"), F.lit(0).alias("bonus")), "frontier")
    taken = stage(frontier.select("url", "kind", "depth", F.lit(0).alias("round")).filter("false"), "taken")
    for k in range(1, rounds + 1):
        left = taken.groupBy("kind").agg((F.lit(most_of_kind) - F.count(F.lit(1))).alias("left"))
        open_ = frontier.join(left, "kind", "left").withColumn("priority", weight - F.col("depth") + F.col("bonus"))
        place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("priority"), "url"))
        able = open_.withColumn("place", place).filter(F.col("place") <= F.coalesce("left", F.lit(most_of_kind)))
        now = stage(able.orderBy(F.desc("priority"), "url").limit(per_round).select("url", "kind", "depth", F.lit(k).alias("round")), "round")
        if now.isEmpty():
            break
        found = links.join(now.select(F.col("url").alias("source"), F.col("depth").alias("from")), "source").groupBy("url").agg(F.min_by(F.struct("kind", (F.col("from") + 1).alias("depth"), "bonus"), F.struct("from", "source")).alias("l"))
        taken = stage(taken.unionByName(now), "taken")
        rest = frontier.join(now.select("url"), "url", "left_anti")
        fresh = found.select("url", "l.kind", "l.depth", "l.bonus").join(taken.select("url"), "url", "left_anti").join(rest.select("url"), "url", "left_anti")
        frontier = stage(rest.unionByName(fresh), "frontier")
    return taken
