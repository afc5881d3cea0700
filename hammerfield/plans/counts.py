"""Queries: aggregations, windows and set operations over listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import rollups as R
from ..operators import search as S
from .proxies import Views
from .registry import query
from .search import EFFECTIVE, now_col, _ACTIVE


def rows_():
    return F.count(F.lit(1))


def active(v: Views):
    return v.auction.filter(L.status_predicate(set(L.OPEN), F.col("status"), F.col("auction_start"), F.col("auction_end"), now_col()))


@query("ag01_count", "SELECT count(*) AS n FROM property WHERE status = 'PUBLISHED'")
def ag01(v: Views):
    return v.property.filter("status = 'PUBLISHED'").agg(rows_().alias("n"))


@query("ag02_group_one", "SELECT category, count(*) AS n FROM property GROUP BY category")
def ag02(v: Views):
    return R.grouped_count(v.property, "category")


@query("ag03_group_many", "SELECT geo_state, geo_city, category, count(*) AS n FROM property GROUP BY ALL")
def ag03(v: Views):
    return R.grouped_count(v.property, "geo_state", "geo_city", "category")


@query("ag04_run_sums", "SELECT source, sum(created)::BIGINT AS created, count(*) AS runs FROM run_log WHERE started_at >= timestamp '2024-01-10' AND kind NOT IN ('error', 'view') GROUP BY source")
def ag04(v: Views):
    rows = v.run_log.filter((F.col("started_at") >= F.lit("2024-01-10").cast("timestamp_ntz")) & ~F.col("kind").isin("error", "view"))
    return rows.groupBy("source").agg(F.sum("created").alias("created"), rows_().alias("runs"))


@query("ag05_global", "SELECT coalesce(sum(created), 0)::BIGINT AS total, count(*) AS n FROM run_log WHERE kind = 'no such kind'")
def ag05(v: Views):
    return v.run_log.filter("kind = 'no such kind'").agg(F.coalesce(F.sum("created"), F.lit(0)).alias("total"), rows_().alias("n"))


@query("ag06_having", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def ag06(v: Views):
    return R.grouped_count(v.documents, "text").filter("n > 1")


@query("ag07_distinct_groups", "SELECT count(DISTINCT address_text) AS n FROM property WHERE geo_city IS NOT NULL")
def ag07(v: Views):
    return v.property.filter("geo_city IS NOT NULL").agg(F.countDistinct("address_text").alias("n"))


@query("ag08_parents_with_child", f"SELECT count(*) AS n FROM bank b WHERE EXISTS (SELECT 1 FROM auction WHERE bank_id = b.id AND {_ACTIVE})")
def ag08(v: Views):
    return v.bank.join(active(v).select(F.col("bank_id").alias("id")), "id", "left_semi").agg(rows_().alias("n"))


@query("ag09_child_counts", "SELECT b.id, b.name, count(a.id) AS n FROM bank b LEFT JOIN auction a ON a.bank_id = b.id AND a.status = 'LIVE' GROUP BY b.id, b.name")
def ag09(v: Views):
    return R.child_counts(v.bank, v.auction.filter("status = 'LIVE'"), "id", "bank_id")


@query("ag10_conditional", "SELECT count(*) AS total, count(*) FILTER (WHERE bank_id IS NULL) AS no_bank, count(*) FILTER (WHERE auction_end < auction_start) AS reversed FROM auction")
def ag10(v: Views):
    return v.auction.agg(rows_().alias("total"), F.count_if(F.col("bank_id").isNull()).alias("no_bank"), F.count_if(F.col("auction_end") < F.col("auction_start")).alias("reversed"))


@query("ag11_distinct_buckets", "SELECT CASE WHEN reserve_price < 50000 THEN 'low' WHEN reserve_price < 200000 THEN 'mid' ELSE 'high' END AS bucket, count(DISTINCT property_id) AS properties FROM auction GROUP BY 1")
def ag11(v: Views):
    bucket = F.when(F.col("reserve_price") < 50000, "low").when(F.col("reserve_price") < 200000, "mid").otherwise("high")
    return v.auction.groupBy(bucket.alias("bucket")).agg(F.countDistinct("property_id").alias("properties"))


@query("ag12_by_day", "SELECT date_trunc('day', started_at) AS day, count(*) AS n FROM run_log GROUP BY 1")
def ag12(v: Views):
    return v.run_log.groupBy(F.date_trunc("day", "started_at").cast("timestamp_ntz").alias("day")).agg(rows_().alias("n"))


@query("ag13_regex_key", "SELECT regexp_extract(title, '([0-9]{3})[0-9]$', 1) AS pin, geo_state, count(*) AS n FROM property p WHERE NOT EXISTS (SELECT 1 FROM auction a WHERE a.property_id = p.id AND a.bank_id IS NULL) GROUP BY ALL ORDER BY n DESC, pin, geo_state LIMIT 300")
def ag13(v: Views):
    rows = v.property.join(v.auction.filter("bank_id IS NULL").select(F.col("property_id").alias("id")), "id", "left_anti")
    return rows.groupBy(F.regexp_extract("title", "([0-9]{3})[0-9]$", 1).alias("pin"), "geo_state").agg(rows_().alias("n")).orderBy(F.desc("n"), "pin", "geo_state").limit(300)


@query("ag14_missing_most_first", "SELECT city, geo_state, count(*) AS n FROM property WHERE geo_city IS NULL GROUP BY ALL ORDER BY n DESC, city LIMIT 20")
def ag14(v: Views):
    return v.property.filter("geo_city IS NULL").groupBy("city", "geo_state").agg(rows_().alias("n")).orderBy(F.desc("n"), "city").limit(20)


@query("ag15_city_summary", f"""WITH act AS (SELECT geo_city AS city, count(*) AS active FROM property p WHERE geo_city IS NOT NULL AND EXISTS (SELECT 1 FROM (SELECT *, {EFFECTIVE} AS eff FROM auction) a WHERE a.property_id = p.id AND eff IN ('UPCOMING', 'LIVE', 'AUCTION_TODAY')) GROUP BY 1),
tot AS (SELECT geo_city AS city, count(*) AS total FROM property WHERE geo_city IS NOT NULL GROUP BY 1)
SELECT city, coalesce(active, 0) AS active, coalesce(total, 0) AS total, row_number() OVER (ORDER BY coalesce(list_position(['NATION_9', 'NATION_3'], city), 999), coalesce(active, 0) DESC, city) AS place FROM tot FULL OUTER JOIN act USING (city)""")  # fmt: skip
def ag15(v: Views):
    some = v.property.join(active(v).select(F.col("property_id").alias("id")), "id", "left_semi")
    return R.city_summary(some.select(F.col("geo_city").alias("city")), v.property.select(F.col("geo_city").alias("city")), ["NATION_9", "NATION_3"])


@query("ag16_places_rollup", "SELECT geo_state AS state, coalesce(geo_city, city) AS city, count(*) AS n, grouping(geo_state, coalesce(geo_city, city)) AS level FROM property GROUP BY ROLLUP (geo_state, coalesce(geo_city, city))")
def ag16(v: Views):
    return R.places_rollup(v.property.select(F.col("geo_state").alias("state"), F.coalesce("geo_city", "city").alias("city")))


@query("ag17_areas", "SELECT city, list_sort(list(area)) AS areas FROM (SELECT DISTINCT ON (p_brand, lower(p_name)) p_brand AS city, p_name AS area FROM part ORDER BY p_brand, lower(p_name), p_partkey % 2, p_name) GROUP BY city")
def ag17(v: Views):
    rows = v.part.select(F.col("p_brand").alias("city"), F.col("p_name").alias("area"), (F.col("p_partkey") % 2).alias("preference"))
    return R.areas_by_city(rows)


@query("ag23_reasons", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN bank_id IS NULL THEN 'no bank' END, CASE WHEN auction_end IS NULL THEN 'no end' END, CASE WHEN reserve_price < 10000 THEN 'low price' END], lambda x: x IS NOT NULL)) AS reason FROM auction) GROUP BY reason")
def ag23(v: Views):
    reasons = F.array_compact(F.array(F.when(F.col("bank_id").isNull(), "no bank"), F.when(F.col("auction_end").isNull(), "no end"), F.when(F.col("reserve_price") < 10000, "low price")))
    return v.auction.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(rows_().alias("n"))


@query("ag24_missing_fields", """SELECT field, missing, round(100.0 * missing / total, 1)::DOUBLE AS percent FROM (
  SELECT count(*) AS total, count(*) FILTER (WHERE bank_id IS NULL) AS bank_id, count(*) FILTER (WHERE auction_end IS NULL) AS auction_end, count(*) FILTER (WHERE reserve_price IS NULL) AS reserve_price FROM auction)
  UNPIVOT (missing FOR field IN (bank_id, auction_end, reserve_price))""")  # fmt: skip
def ag24(v: Views):
    fields = ["bank_id", "auction_end", "reserve_price"]
    one = v.auction.agg(rows_().alias("total"), *[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    return one.unpivot(["total"], fields, "field", "missing").select("field", "missing", F.round(100.0 * F.col("missing") / F.col("total"), 1).alias("percent"))


@query("ag26_premium", """WITH stop AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, max(e.ts + interval 10 day) AS until, max(e.ts + interval 10 day) > timestamp '2024-02-05' AS premium FROM events e LEFT JOIN stop s USING (user_id)
WHERE e.event_type = 'purchase' AND (s.t IS NULL OR s.t < e.ts) GROUP BY user_id""")  # fmt: skip
def ag26(v: Views):
    """Paid intervals that no later stop cancels; the latest end counts."""
    stops = v.events.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("stop"))
    paid = v.events.filter("event_type = 'purchase'").join(stops, "user_id", "left").filter("stop IS NULL OR stop < ts")
    until = F.max(F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    return paid.groupBy("user_id").agg(until.alias("until"), (until > F.lit("2024-02-05").cast("timestamp_ntz")).alias("premium"))


@query("ag28_key_sets", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)) AS keys, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated")
def ag28(v: Views):
    keys = v.orders.filter("o_orderkey % 3 = 0").select("o_orderkey").union(v.lineitem.filter("l_linenumber = 7").select("l_orderkey")).distinct().agg(rows_().alias("keys"))
    return keys.join(v.orders.groupBy("o_custkey").count().filter("count > 1").agg(rows_().alias("repeated")))


@query("wn01_latest_row", "SELECT source, arg_max(id, (started_at, id)) AS id FROM run_log GROUP BY source")
def wn01(v: Views):
    return S.latest(v.run_log, ["source"], F.col("started_at").desc(), F.col("id").desc()).select("source", "id")


@query("wn08_reauction", """SELECT id, property_id, round(100 * (reserve_price - prev) / prev, 1) + 0.0 AS price_change, start > prev_start + interval 36 hour AS new_round FROM (
  SELECT id, property_id, reserve_price, auction_start AS start, lag(reserve_price) OVER w AS prev, lag(auction_start) OVER w AS prev_start FROM auction WINDOW w AS (PARTITION BY property_id ORDER BY auction_start, id)) WHERE prev IS NOT NULL""")  # fmt: skip
def wn08(v: Views):
    w = Window.partitionBy("property_id").orderBy("auction_start", "id")
    rows = v.auction.select("id", "property_id", "reserve_price", "auction_start", F.lag("reserve_price").over(w).alias("prev"), F.lag("auction_start").over(w).alias("prev_start")).filter("prev IS NOT NULL")
    return rows.select("id", "property_id", (F.round(100 * (F.col("reserve_price") - F.col("prev")) / F.col("prev"), 1) + 0.0).alias("price_change"), (F.col("auction_start") > F.col("prev_start") + F.expr("INTERVAL 36 HOURS")).alias("new_round"))


@query("wn09_keeper", "SELECT property_id, id FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY auction_start DESC NULLS LAST, created_at, id) AS n FROM auction) WHERE n = 1")
def wn09(v: Views):
    return S.latest(v.auction, ["property_id"], F.col("auction_start").desc_nulls_last(), F.col("created_at").asc(), F.col("id").asc()).select("property_id", "id")


@query("wn10_tabs", """WITH t AS (SELECT a.id, a.property_id, p.category, a.auction_start, row_number() OVER (PARTITION BY p.category ORDER BY a.auction_start, a.id) AS n FROM auction a JOIN property p ON p.id = a.property_id WHERE a.status = 'UPCOMING')
SELECT id, property_id, category FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY category NULLS LAST, auction_start, id) AS k FROM t WHERE n <= 24) WHERE k = 1""")  # fmt: skip
def wn10(v: Views):
    rows = v.auction.filter("status = 'UPCOMING'").select("id", "property_id", "auction_start").join(v.property.select(F.col("id").alias("property_id"), "category"), "property_id")
    tabs = R.top_per_group(rows, ["category"], [F.col("auction_start"), F.col("id")], 24)
    return S.latest(tabs, ["property_id"], F.col("category").asc_nulls_last(), F.col("auction_start").asc(), F.col("id").asc()).select("id", "property_id", "category")


@query("wn11_similar", """SELECT id, tier, rank FROM (SELECT *, row_number() OVER (ORDER BY tier, id DESC) AS rank FROM (
  SELECT id, CASE WHEN geo_city = 'NATION_3' AND category = 'RESIDENTIAL' THEN 0 ELSE 1 END AS tier FROM property WHERE status = 'PUBLISHED' AND id <> 1003 AND category = 'RESIDENTIAL' AND (geo_city = 'NATION_3' OR geo_state = 'EUROPE'))) WHERE rank <= 8""")  # fmt: skip
def wn11(v: Views):
    rows = v.property.filter("status = 'PUBLISHED' AND id <> 1003 AND category = 'RESIDENTIAL' AND (geo_city = 'NATION_3' OR geo_state = 'EUROPE')")
    tier = F.when(F.coalesce(F.col("geo_city") == "NATION_3", F.lit(False)), 0).otherwise(1)
    ranked = rows.select("id", tier.alias("tier")).orderBy("tier", F.desc("id")).limit(8)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("id"))).cast("long"))


@query("wn12_rings", """SELECT c_custkey, 1 + n // 8 AS ring, round(0.004 * (1 + n // 8) * cos(2 * pi() * (n % 8) / 8), 9) + 0.0 AS dlat, round(0.004 * (1 + n // 8) * sin(2 * pi() * (n % 8) / 8), 9) + 0.0 AS dlng
FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)""")  # fmt: skip
def wn12(v: Views):
    """Points at one place spread on rings of eight."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = v.customer.select("c_custkey", n.alias("n"))
    ring, angle = (1 + F.floor(F.col("n") / 8)), 2 * F.pi() * (F.col("n") % 8) / 8
    return rows.select("c_custkey", ring.cast("long").alias("ring"), (F.round(0.004 * ring * F.cos(angle), 9) + 0.0).alias("dlat"), (F.round(0.004 * ring * F.sin(angle), 9) + 0.0).alias("dlng"))


@query("so03_token_sets", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND list_sort(list_distinct(string_split(a.p_name, ' '))) = list_sort(list_distinct(string_split(b.p_name, ' ')))")
def so03(v: Views):
    """Equal token sets: an equi-join on the sorted set. The pairs outgrow the parts, so the tasks are not fitted to the size of these."""
    key = F.array_sort(F.array_distinct(F.split("p_name", " ")))
    tasks = 8 * v.spark.sparkContext.defaultParallelism
    rows = v.part.select("p_brand", key.alias("tokens"), "p_partkey").repartition(tasks, "p_brand", "tokens")
    a, b = rows.withColumnRenamed("p_partkey", "a"), rows.withColumnRenamed("p_partkey", "b")
    return a.join(b.hint("merge"), ["p_brand", "tokens"]).filter("a < b").select("a", "b")


@query("so04_merge_lists", "SELECT id FROM (SELECT id, source, started_at FROM run_log WHERE created > 50 UNION SELECT id, source, started_at FROM run_log WHERE kind = 'click') ORDER BY started_at DESC, id LIMIT 100")
def so04(v: Views):
    both = v.run_log.filter("created > 50").select("id", "source", "started_at").unionByName(v.run_log.filter("kind = 'click'").select("id", "source", "started_at"))
    return both.distinct().orderBy(F.desc("started_at"), "id").limit(100).select("id")


@query("ag25_pins", "SELECT round(c_acctbal / 1000, 1) AS spot, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY 1")
def ag25(v: Views):
    """Pins by rounded place: how many, and the first and last seen; the members stay in their table, whatever a spot holds."""
    return v.customer.groupBy(F.round(F.col("c_acctbal") / 1000, 1).alias("spot")).agg(rows_().alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


@query("ag27_budget", """SELECT id, used, CASE WHEN source = 'src0' THEN 'none' WHEN used >= 2000 THEN 'exceeded' WHEN used >= 1600 THEN 'warning' ELSE 'ok' END AS level FROM (
  SELECT id, source, sum(created) OVER (PARTITION BY source ORDER BY floor(epoch(started_at)) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)::BIGINT AS used FROM run_log)""")  # fmt: skip
def ag27(v: Views):
    """What the last 24 hours used at each run, against a cap; one source has none."""
    rows = v.run_log.select("id", "source", F.unix_timestamp(F.col("started_at").cast("timestamp")).alias("at"), "created")
    used = R.trailing_sums(rows, "source", "at", "created", 86_400)
    cap = F.when(F.col("source") != "src0", 2000)
    return used.select("id", "used", F.when(cap.isNull(), "none").when(F.col("used") >= cap, "exceeded").when(F.col("used") >= 0.8 * cap, "warning").otherwise("ok").alias("level"))


@query("ag29_verified", """SELECT file, declared, read, accounted, declared = read AND read = accounted AS verified FROM (SELECT o_custkey % 7 AS file, count(*) + CASE WHEN o_custkey % 7 = 3 THEN 1 ELSE 0 END AS declared, count(*) AS read, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O') OR o_custkey % 7 <> 5) AS accounted FROM orders GROUP BY o_custkey % 7)""")
def ag29(v: Views):
    """Exports of orders with the totals they declare: verified where these, the rows read and the rows accounted for are one."""
    orders = v.orders.withColumn("file", F.col("o_custkey") % 7)
    declared = orders.groupBy("file").agg((rows_() + F.when(F.first("file") == 3, 1).otherwise(0)).alias("declared"))
    accounted = F.count_if(F.col("o_orderstatus").isin("F", "O") | (F.col("file") != 5))
    totals = orders.groupBy("file").agg(rows_().alias("read"), accounted.alias("accounted")).join(declared, "file")
    return totals.select("file", "declared", "read", "accounted", ((F.col("declared") == F.col("read")) & (F.col("read") == F.col("accounted"))).alias("verified"))
