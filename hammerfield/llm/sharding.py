"""Sharding by jump consistent hashing, in DataFrame functions only.

The shard of a row depends on its key and the shard count alone: no ring table is kept, and with one more shard
a row either stays or moves into the new shard. The generator of the published method is a 64-bit linear
congruential one; its products are built from 32-bit halves because SQL integers are signed and checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64, in halves."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    low16, high16 = lo.bitwiseAND(F.lit(0xFFFF)), F.shiftright(lo, 16)
    a = low16 * F.lit(m_lo) + F.lit(1)  # under 2^49
    b = high16 * F.lit(m_lo)  # under 2^48
    low = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(low, 32) + F.shiftright(b, 16)

    def cross(x: Column, m: int) -> Column:
        """x * m modulo 2^32 without leaving 63 bits."""
        return (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(m) + F.shiftleft((F.shiftright(x, 16) * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))

    high = (cross(lo, m_hi) + cross(hi, m_lo) + carry).bitwiseAND(F.lit(_LOW))
    return high, low.bitwiseAND(F.lit(_LOW))


def jump_shard(key: Column, shards: int) -> Column:
    """Jump consistent hash of a long key (null counts as 0) over the given number of shards; int."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    # b: the last bucket jumped to, j: the next candidate; j grows by one at least, so `shards` steps are enough.
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW)).alias("lo"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )

    def step(acc: Column, _: Column) -> Column:
        hi, lo = _next(acc["hi"], acc["lo"])
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"), acc["j"].alias("b"),
            F.floor((acc["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double"))).cast("long").alias("j"),
        )
        return F.when(acc["j"] < F.lit(shards), moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["b"].cast("int"))


#: Sub-lists in which each shard is numbered; the slots follow from this number, not from the cluster's settings.
PIECES = 512


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", pieces: int = PIECES) -> DataFrame:
    """Every row of df with size, text_crc32, law, shard, slot and grown_shard.

    size: UTF-8 bytes of the text plus 8; a null text counts 0 bytes and has the CRC-32 of no bytes. A null key is
    sharded as 0. Repeated rows are kept, each with its own slot. Slots are numbered from 0 without gaps in each shard.
    Columns of df other than key and text are dropped, so their names cannot clash. An empty table gives an empty one.

    A shard is numbered in pieces: its rows are dealt into sub-lists by a hash of the row, counted, and each sub-list
    is numbered from the sum of the counts before it, so no task holds a whole shard.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumn("shard", jump_shard(F.col("doc_id"), shards)).withColumn("grown_shard", jump_shard(F.col("doc_id"), shards + 1))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(pieces)).cast("int"))
    counts = rows.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32"))
    # at most shards x pieces rows, whatever the input
    out = rows.withColumn("number", number).join(F.broadcast(starts), ["shard", "piece"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("number") - F.lit(1)).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write df as one folder of Parquet files for each shard, moving no row between tasks."""
    (df.withColumn("shard", jump_shard(F.col(key), shards)).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))
