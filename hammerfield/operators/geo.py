"""Joins by distance on the earth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import haversine_km

#: Fixed value: keys of a place that are one row.
LISTED = 1000
#: Kilometres of a degree on the sphere of haversine_km.
DEGREE = 2 * math.pi * 6371 / 360


def _columns(band: Column, height: float) -> Column:
    """Cells around the earth in a band of latitude: each at least as wide, anywhere in the band and its neighbours, as a band is high.

    One cell where that reaches a pole.
    """
    far = F.greatest(F.abs(band), F.abs(band + 1)) + 1  # bands from the equator to the far side of the neighbour
    return F.when(far * height >= 89, 1).otherwise(F.greatest(F.lit(1), F.floor(360 / (F.lit(height * 1.0005) / F.cos(F.radians(far * height)))))).cast("int")


def within_distance(points: DataFrame, km: float, key: str = "id", digits: int | None = None) -> DataFrame:
    """a, b, km: the pairs of points (key, lat, lng) less than `km` apart, a < b; km is rounded to `digits`.

    Points of one place are listed together, about LISTED to a row, and the distance is found once for two lists. Lists
    meet only in adjoining cells of a grid: bands of latitude `km` high, cut into cells at least as wide. A list
    is stored in its own cell and asks for its neighbours in three bands, so work grows with the points and the pairs
    that are near, not with all pairs; the pairs of near lists are dealt out before they are written out. Neither side is
    sent whole to the driver, however small its files are. Longitudes wrap around. Points with a null are near nothing;
    points of one key are no pair; a pair of keys comes once for each pair of their points.
    """
    spark = points.sparkSession
    height = km * 1.0005 / DEGREE
    at = points.select(F.col(key).alias("k"), F.col("lat").cast("double").alias("lat"), (F.pmod(F.col("lng").cast("double") + 180, F.lit(360.0))).alias("east")).dropna()
    lists = F.ceil(F.count(F.lit(1)) / LISTED)
    places = at.groupBy(F.col("lat").alias("lat_p"), F.col("east").alias("east_p")).agg(lists.alias("lists"))
    at = at.join(places.hint("merge"), (F.col("lat") == F.col("lat_p")) & (F.col("east") == F.col("east_p")))
    at = at.groupBy("lat", "east", F.pmod(F.xxhash64("k"), F.col("lists")).alias("list")).agg(F.collect_list("k").alias("ks"))
    band = F.floor(F.col("lat") / height).cast("int")

    def cell(columns: Column) -> Column:
        return F.least(F.floor(F.col("east") / 360 * columns).cast("int"), columns - 1)

    stored = at.withColumn("band", band).withColumn("cell", cell(_columns(F.col("band"), height)))
    asked = at.withColumn("band", F.explode(F.sequence(band - 1, band + 1))).withColumn("n", _columns(F.col("band"), height)).withColumn("c", cell(F.col("n")))
    asked = asked.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(F.col("c") + d, F.col("n"))))))
    side = lambda frame, s: frame.select("band", "cell", F.struct("lat", "east", "list").alias(s), F.col("ks").alias(f"ks_{s}"))
    apart = haversine_km(F.col("p.lat"), F.col("p.east"), F.col("q.lat"), F.col("q.east"))
    near = side(asked, "p").join(side(stored, "q").hint("merge"), ["band", "cell"]).filter("p <= q").select("p", "q", "ks_p", "ks_q", apart.alias("km")).filter(F.col("km") < km)
    near = near if digits is None else near.withColumn("km", F.round("km", digits))
    near = near.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "p", "q")
    pairs = near.select((F.col("p") == F.col("q")).alias("same"), "ks_q", "km", F.explode("ks_p").alias("x")).select("same", "km", "x", F.explode("ks_q").alias("y"))
    # within one list each pair would come both ways
    return pairs.filter("x < y OR (x > y AND NOT same)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "km")
