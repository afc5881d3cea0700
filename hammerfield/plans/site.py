"""Queries: directories, dashboards and page-level lists; streams run over what is there."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..operators import lifecycle as L
from ..operators import rollups as R
from ..operators import search as S
from ..streaming import ticks as T
from .proxies import Views
from .registry import query
from .search import EFFECTIVE, now_col


def rows_():
    return F.count(F.lit(1))


@query("pg02_user_search", "SELECT c_custkey, c_name, coalesce(n, 0) AS orders, coalesce(s, 0)::BIGINT AS searches FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS s FROM events GROUP BY 1) e ON user_id = c_custkey WHERE contains(lower(c_name), '00001') ORDER BY c_custkey DESC LIMIT 200")
def pg02(v: Views):
    users = v.customer.filter(S.contains_ci(F.col("c_name"), "00001")).select("c_custkey", "c_name")
    # each child is counted before it is joined, so two children do not multiply
    orders = v.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(rows_().alias("orders"))
    searches = v.events.groupBy(F.col("user_id").alias("c_custkey")).agg(rows_().alias("searches"))
    out = users.join(orders, "c_custkey", "left").join(searches, "c_custkey", "left").fillna(0, ["orders", "searches"])
    return out.orderBy(F.desc("c_custkey")).limit(200)


@query("pg03_payments", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey")
def pg03(v: Views):
    return v.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), rows_().alias("n"), F.max("o_orderdate").alias("latest"))


@query("pg10_cities_by_state", "SELECT geo_state, city, n, count(*) OVER (PARTITION BY city) > 1 AS shared, row_number() OVER (PARTITION BY geo_state ORDER BY n DESC, city) AS place FROM (SELECT geo_state, city, count(*) AS n FROM property GROUP BY ALL)")
def pg10(v: Views):
    cities = R.grouped_count(v.property, "geo_state", "city")
    shared = F.count(F.lit(1)).over(Window.partitionBy("city")) > 1
    return cities.select("geo_state", "city", "n", shared.alias("shared"), F.row_number().over(Window.partitionBy("geo_state").orderBy(F.desc("n"), "city")).alias("place"))


@query("pg11_city_search", "SELECT DISTINCT geo_state, city FROM property WHERE contains(lower(geo_state), 'asia') OR contains(lower(city), 'asia') OR contains(lower(city), 'an')")
def pg11(v: Views):
    hit = S.any_of([S.contains_ci(F.col("geo_state"), "asia"), S.contains_ci(F.col("city"), "asia"), S.contains_ci(F.col("city"), "an")])
    return v.property.filter(hit).select("geo_state", "city").distinct()


@query("pg13_saved", "SELECT e.event_id, p.id, p.title FROM events e JOIN property p ON p.id = e.user_id WHERE e.event_type = 'view' AND p.status = 'PUBLISHED' ORDER BY e.ts DESC, e.event_id LIMIT 100")
def pg13(v: Views):
    saved = v.events.filter("event_type = 'view'").select("event_id", "ts", F.col("user_id").alias("id"))
    listed = v.property.filter("status = 'PUBLISHED'").select("id", "title")
    return saved.join(listed, "id").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "id", "title")


@query("pg15_related", "SELECT doc_id, lang, greatest(1, round(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) / 200))::INT AS minutes FROM documents WHERE doc_id <> 0 ORDER BY lang = (SELECT lang FROM documents WHERE doc_id = 0) DESC, doc_id DESC LIMIT 3")
def pg15(v: Views):
    docs = v.documents
    one = docs.filter("doc_id = 0").select(F.col("lang").alias("own"))  # the row of one id
    count = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    near = docs.filter("doc_id <> 0").join(F.broadcast(one.limit(1)), F.lit(True), "left").orderBy((F.col("lang") == F.col("own")).desc(), F.desc("doc_id")).limit(3)
    return near.select("doc_id", "lang", F.greatest(F.lit(1), F.round(count / 200)).cast("int").alias("minutes"))


@query("pg16_suggest", "SELECT label, kind FROM (SELECT r_name AS label, 0 AS kind FROM region UNION ALL SELECT n_name, 1 FROM nation) WHERE contains(lower(label), 'a') ORDER BY starts_with(lower(label), 'a') DESC, kind, label LIMIT 8")
def pg16(v: Views):
    both = v.region.select(F.col("r_name").alias("label"), F.lit(0).alias("kind")).unionByName(v.nation.select(F.col("n_name").alias("label"), F.lit(1).alias("kind")))
    return both.filter(S.contains_ci(F.col("label"), "a")).orderBy(F.lower("label").startswith("a").desc(), "kind", "label").limit(8)


@query("pg18_countdown_tabs", "SELECT tab, id, n FROM (SELECT tab, id, row_number() OVER (PARTITION BY tab ORDER BY id) AS n FROM (SELECT id, CASE WHEN category IS NULL OR category = 'LAND_PLOT' THEN 'Other' ELSE category END AS tab FROM property)) WHERE n <= 8")
def pg18(v: Views):
    tab = F.when(F.col("category").isNull() | (F.col("category") == "LAND_PLOT"), "Other").otherwise(F.col("category"))
    rows = v.property.select("id", tab.alias("tab"))
    return rows.select("tab", "id", F.row_number().over(Window.partitionBy("tab").orderBy("id")).alias("n")).filter("n <= 8")


@query("pg20_slices", "SELECT o_orderpriority AS kind, CASE WHEN total >= 3000 THEN o_orderstatus END AS part, sum(n)::BIGINT AS n, sum(n) >= 3000 AS capped FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_orderpriority) AS total FROM orders GROUP BY 1, 2) GROUP BY 1, 2")
def pg20(v: Views):
    parts = v.orders.groupBy("o_orderpriority", "o_orderstatus").agg(rows_().alias("n"))
    total = F.sum("n").over(Window.partitionBy("o_orderpriority"))
    slices = parts.withColumn("part", F.when(total >= 3000, F.col("o_orderstatus"))).groupBy(F.col("o_orderpriority").alias("kind"), "part")
    return slices.agg(F.sum("n").alias("n")).withColumn("capped", F.col("n") >= 3000)


@query("pg24_dashboard", f"SELECT count(*) AS rounds, count(*) FILTER (WHERE s = 'LIVE') AS live, count(*) FILTER (WHERE s = 'AUCTION_TODAY') AS today, count(*) FILTER (WHERE s = 'COMPLETED') AS completed FROM (SELECT {EFFECTIVE} AS s FROM auction)")
def pg24(v: Views):
    s = L.effective_status(F.col("status"), F.col("auction_start"), F.col("auction_end"), now_col())
    rows = v.auction.select(s.alias("s"))
    return rows.agg(rows_().alias("rounds"), *[F.count_if(F.col("s") == k).alias(n) for k, n in (("LIVE", "live"), ("AUCTION_TODAY", "today"), ("COMPLETED", "completed"))])


@query("pg27_new_urls", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 1)")
def pg27(v: Views):
    seen, stored = (v.pages.filter(F.col("page_id") % 3 == k).select("url") for k in (0, 1))
    return v.pages.join(seen, "url", "left_anti").join(stored, "url", "left_anti").select("page_id")


@query("pg28_other_source", "SELECT a.doc_id FROM documents a WHERE EXISTS (SELECT 1 FROM documents b WHERE b.text = a.text AND b.source <> a.source)")
def pg28(v: Views):
    # one row for each hash with two sources, so a common text makes no pairs
    docs = v.documents.select("doc_id", F.sha2("text", 256).alias("h"), "source")
    shared = docs.groupBy("h").agg(F.min("source").alias("a"), F.max("source").alias("b")).filter("a <> b").select("h")
    return docs.join(shared, "h", "left_semi").select("doc_id")


@query("pg34_map_point", "SELECT id, CASE WHEN k < 4 THEN lat END AS lat, CASE WHEN k < 4 THEN lng END AS lng, k < 4 AND lat BETWEEN 6 AND 37.6 AND lng BETWEEN 68 AND 97.5 AS inside FROM (SELECT id, id % 6 AS k, (id % 40 - 2 + 0.25)::DOUBLE AS lat, (60 + id % 45 + 0.5)::DOUBLE AS lng FROM listing)")
def pg34(v: Views):
    """Points of map links of two shapes, inside the country's box or not; others have none."""
    i = F.col("id")
    pair = F.concat((i % 40 - 2 + 0.25).cast("decimal(8,2)").cast("string"), F.lit(","), (60 + i % 45 + 0.5).cast("decimal(8,1)").cast("string"))
    link = F.when(i % 6 < 2, F.concat(F.lit("https://maps.example.org/?q="), pair)).when(i % 6 < 4, F.concat(F.lit("https://maps.example.org/@"), pair, F.lit(",15z"))).when(i % 6 == 4, "https://maps.example.org/place/x")
    part = lambda k: F.nullif(F.regexp_extract("u", r"(?:q=|@)(-?[0-9.]+),(-?[0-9.]+)", k), F.lit("")).cast("double")
    rows = v.listing.select("id", link.alias("u")).select("id", part(1).alias("lat"), part(2).alias("lng"))
    return rows.withColumn("inside", M.valid_point(F.col("lat"), F.col("lng")))


def _runs(v: Views):
    return T.read_runs(v.spark, f"{v.sf_dir}/events.parquet")


@query("st20_daily_ticks", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def st20(v: Views):
    return T.latest_tick(T.run_ticks(T.daily_counts(_runs(v)), "daily"), "day", "kind")


@query("st21_first_seen_ticks", "SELECT DISTINCT user_id FROM events")
def st21(v: Views):
    return T.run_ticks(T.first_seen(_runs(v), "user_id"), "seen", "append").select("user_id")


@query("wn04_change_ticks", "SELECT user_id::BIGINT AS key, count(*) FILTER (WHERE was IS NULL OR was <> event_type) AS changes FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) GROUP BY user_id")
def wn04_stream(v: Views):
    return T.latest_tick(T.run_ticks(T.changes_only(_runs(v), "user_id", "event_type"), "changes"), "key")
