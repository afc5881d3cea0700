"""Queries: scans, predicates, joins, sorts, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import search as S
from .proxies import NOW, Views
from .registry import query


def now_col():
    return F.lit(NOW).cast("timestamp_ntz")
_NOW = f"timestamp '{NOW}'"
_TODAY = "timestamp '1998-06-14 18:30:00'"
_TOMORROW = "timestamp '1998-06-15 18:30:00'"
_OPEN = "('UPCOMING', 'LIVE', 'AUCTION_TODAY')"
_OVER = f"coalesce(auction_end < {_NOW}, date_trunc('day', auction_start + interval 330 minute) - interval 330 minute + interval 1 day <= {_NOW}, false)"
EFFECTIVE = f"""CASE WHEN status NOT IN {_OPEN} THEN status WHEN {_OVER} THEN 'COMPLETED' WHEN status = 'LIVE' OR auction_start IS NULL THEN status
  WHEN auction_start <= {_NOW} THEN CASE WHEN auction_end IS NOT NULL THEN 'LIVE' ELSE 'AUCTION_TODAY' END
  WHEN auction_start < {_TOMORROW} THEN 'AUCTION_TODAY' ELSE status END"""
_ACTIVE = f"({EFFECTIVE}) IN {_OPEN}"


@query(
    "q_flagship_search",
    f"""
SELECT p.id, p.title, p.geo_city, a.id AS auction_id, a.reserve_price, {EFFECTIVE.replace('status', 'a.status').replace('auction_start', 'a.auction_start').replace('auction_end', 'a.auction_end')} AS effective_status, b.name AS bank
FROM property p
JOIN (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY created_at DESC NULLS FIRST, id DESC) AS n FROM auction) a ON a.property_id = p.id AND a.n = 1
LEFT JOIN bank b ON b.id = a.bank_id
WHERE p.status = 'PUBLISHED' AND EXISTS (SELECT 1 FROM auction x WHERE x.property_id = p.id AND {_ACTIVE.replace('status', 'x.status').replace('auction_start', 'x.auction_start').replace('auction_end', 'x.auction_end')})
ORDER BY a.created_at DESC NULLS FIRST, p.id DESC LIMIT 24
""",
)
def flagship(v: Views):
    """First page of active listings, newest round first, with that round, its bank and its status now."""
    newest = S.latest(v.auction, ["property_id"], F.col("created_at").desc_nulls_first(), F.col("id").desc())
    a = newest.select(F.col("property_id").alias("id"), F.col("id").alias("auction_id"), "reserve_price", "bank_id", "created_at", L.effective_status(F.col("status"), F.col("auction_start"), F.col("auction_end"), now_col()).alias("effective_status"))
    found = S.published(v.property, v.auction, S.Filters(group="active"), now_col()).join(a, "id")
    top = found.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()).limit(24)
    return top.join(v.bank.select(F.col("id").alias("bank_id"), F.col("name").alias("bank")), "bank_id", "left").select("id", "title", "geo_city", "auction_id", "reserve_price", "effective_status", "bank")


@query("src01_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def src01(v: Views):
    return v.orders.filter((F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@query("fl01_predicates", "SELECT id, title FROM property WHERE status IN ('PUBLISHED', 'PENDING_REVIEW') AND category NOT IN ('INDUSTRIAL') AND geo_city IS NULL AND starts_with(title, 'Customer') AND contains(lower(address_text), 'a')")
def fl01(v: Views):
    parts = [F.col("status").isin("PUBLISHED", "PENDING_REVIEW"), ~F.col("category").isin("INDUSTRIAL"), F.col("geo_city").isNull(), F.col("title").startswith("Customer"), None, S.contains_ci(F.col("address_text"), "A")]
    return v.property.filter(S.all_of(parts)).select("id", "title")


_FL02 = f"""SELECT id, title FROM property p WHERE status = 'PUBLISHED' AND category = 'RESIDENTIAL' AND EXISTS (
  SELECT 1 FROM (SELECT *, {EFFECTIVE} AS eff FROM auction) a WHERE a.property_id = p.id AND a.reserve_price BETWEEN 50000 AND 250000 AND a.eff IN {_OPEN})"""


@query("fl02_published", _FL02)
def fl02(v: Views):
    return S.published(v.property, v.auction, S.Filters(category="RESIDENTIAL", min_price=50000, max_price=250000, group="active"), now_col()).select("id", "title")


@query("fl03_effective_status", f"SELECT id, {EFFECTIVE} AS effective_status FROM auction")
def fl03(v: Views):
    return v.auction.select("id", L.effective_status(F.col("status"), F.col("auction_start"), F.col("auction_end"), now_col()).alias("effective_status"))


@query("fl04_over", f"SELECT id, {_OVER} AS is_over FROM auction")
def fl04(v: Views):
    return v.auction.select("id", L.is_over(F.col("auction_start"), F.col("auction_end"), now_col()).alias("is_over"))


@query("fl05_status_ranges", f"SELECT id, s AS wanted FROM (SELECT id, {EFFECTIVE} AS s FROM auction) WHERE s IN ('UPCOMING', 'LIVE', 'AUCTION_TODAY', 'COMPLETED')")
def fl05(v: Views):
    """The rounds of each wanted status by its own predicate, all of them over one reading of the rounds."""
    within = lambda w: F.when(L.status_predicate({w}, F.col("status"), F.col("auction_start"), F.col("auction_end"), now_col()), w)
    wanted = F.array_compact(F.array(*map(within, ("UPCOMING", "LIVE", "AUCTION_TODAY", "COMPLETED"))))
    return v.auction.select("id", F.explode(wanted).alias("wanted"))


@query("fl06_groups", f"SELECT id, {_ACTIVE} AS active FROM auction")
def fl06(v: Views):
    return v.auction.select("id", L.status_predicate(set(L.OPEN), F.col("status"), F.col("auction_start"), F.col("auction_end"), now_col()).alias("active"))


@query("fl07_keyword", "SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') AND contains(lower(text), 'of')")
def fl07(v: Views):
    return v.documents.filter(S.keyword_predicate("thing, OF", {"description": F.col("text")})).select("doc_id")


@query("fl08_variants", "SELECT id FROM listing WHERE list_contains(list_transform(['punne', 'pune', 'ppunne'], lambda x: contains(lower(title), x)), true)")
def fl08(v: Views):
    """A word that is written another way: double letters made single, single ones made double."""
    return v.listing.filter(S.keyword_predicate("punne", {"title": F.col("title")})).select("id")


@query("fl10_city", "SELECT id FROM property WHERE status = 'PUBLISHED' AND lower(geo_city) = 'nation_8'")
def fl10(v: Views):
    return v.property.filter(S.listing_predicate(S.Filters(city="nation_8"))).select("id")


@query("fl11_locality", "SELECT id FROM property WHERE status = 'PUBLISHED' AND (lower(geo_city) = 'nation_3' OR (geo_city IS NULL AND (contains(lower(title), 'nation_3') OR contains(lower(address_text), 'nation_3'))))")
def fl11(v: Views):
    text = S.any_of([S.contains_ci(F.col("title"), "nation_3"), S.contains_ci(F.col("address_text"), "nation_3")])
    return v.property.filter((F.col("status") == "PUBLISHED") & ((F.lower("geo_city") == "nation_3") | (F.col("geo_city").isNull() & text))).select("id")


@query("fl13_none", "SELECT id FROM property p WHERE NOT EXISTS (SELECT 1 FROM auction a WHERE a.property_id = p.id AND a.status = 'LIVE')")
def fl13(v: Views):
    return v.property.join(v.auction.filter("status = 'LIVE'").select(F.col("property_id").alias("id")), "id", "left_anti").select("id")


@query("jn01_inner", "SELECT a.id, p.title, b.name AS bank FROM auction a JOIN property p ON p.id = a.property_id JOIN bank b ON b.id = a.bank_id")
def jn01(v: Views):
    a = v.auction.select("id", "property_id", "bank_id")
    return a.join(v.property.select(F.col("id").alias("property_id"), "title"), "property_id").join(v.bank.select(F.col("id").alias("bank_id"), F.col("name").alias("bank")), "bank_id").select("id", "title", "bank")


@query("jn02_latest_child", "SELECT p.id, a.id AS auction_id, a.reserve_price FROM property p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY created_at DESC NULLS FIRST, id DESC) AS n FROM auction) a ON a.property_id = p.id AND n = 1")
def jn02(v: Views):
    newest = S.latest(v.auction, ["property_id"], F.col("created_at").desc_nulls_first(), F.col("id").desc())
    return v.property.select("id").join(newest.select(F.col("property_id").alias("id"), F.col("id").alias("auction_id"), "reserve_price"), "id", "left")


@query("jn03_semi_anti", "SELECT id, EXISTS (SELECT 1 FROM auction a WHERE a.property_id = p.id AND a.status = 'LIVE') AS has_live FROM property p")
def jn03(v: Views):
    live = v.auction.filter("status = 'LIVE'").select(F.col("property_id").alias("id"))
    with_ = v.property.join(live, "id", "left_semi").select("id", F.lit(True).alias("has_live"))
    return with_.unionByName(v.property.join(live, "id", "left_anti").select("id", F.lit(False).alias("has_live")))


@query("jn04_lateral_top1", "SELECT p.id, a.auction_start FROM property p, LATERAL (SELECT auction_start FROM auction x WHERE x.property_id = p.id ORDER BY auction_start DESC, x.id DESC LIMIT 1) a")
def jn04(v: Views):
    best = v.auction.groupBy(F.col("property_id").alias("id")).agg(F.max_by("auction_start", F.struct("auction_start", F.col("id"))).alias("auction_start"))
    return v.property.select("id").join(best, "id")


@query("jn05_full_outer_fill", """SELECT coalesce(d.k, l.k) AS k, coalesce(nullif(d.s, ''), l.s) AS s FROM
  (SELECT l_orderkey AS k, CASE WHEN max(l_linenumber) > 4 THEN 'many' ELSE '' END AS s FROM lineitem GROUP BY 1) d FULL OUTER JOIN (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0) l ON d.k = l.k""")  # fmt: skip
def jn05(v: Views):
    detail = v.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.when(F.max("l_linenumber") > 4, "many").otherwise("").alias("d"))
    listed = v.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("l"))
    return detail.join(listed, "k", "full_outer").select("k", F.coalesce(F.nullif("d", F.lit("")), "l").alias("s"))


@query("jn07_sheet_lookup", "SELECT p.id, coalesce(nullif(p.geo_city, ''), a.status) AS filled, a.latest FROM property p LEFT JOIN (SELECT property_id, arg_max(status, (auction_start, id)) AS status, max(auction_start) AS latest FROM auction WHERE status <> 'CANCELLED' GROUP BY 1) a ON a.property_id = p.id")
def jn07(v: Views):
    a = v.auction.filter("status <> 'CANCELLED'").groupBy(F.col("property_id").alias("id")).agg(F.max_by("status", F.struct("auction_start", "id")).alias("s"), F.max("auction_start").alias("latest"))
    return v.property.join(a, "id", "left").select("id", F.coalesce(F.nullif("geo_city", F.lit("")), "s").alias("filled"), "latest")


@query("jn13_near_in_time", "SELECT a.id AS a, b.id AS b FROM auction a JOIN auction b ON a.property_id = b.property_id AND a.id < b.id AND abs(epoch(a.auction_start) - epoch(b.auction_start)) < 129600")
def jn13(v: Views):
    return S.near_in_time(v.auction, "property_id", "id", "auction_start", 36 * 3600)


@query("jn15_computed_key", "SELECT p.id, n.n_nationkey FROM property p JOIN nation n ON regexp_replace(lower(p.city), '[^a-z0-9]+', '-', 'g') = regexp_replace(lower(n.n_name), '[^a-z0-9]+', '-', 'g')")
def jn15(v: Views):
    from ..functions.text import city_slug

    left = v.property.select("id", city_slug(F.col("city")).alias("slug"))
    return left.join(v.nation.select("n_nationkey", city_slug(F.col("n_name")).alias("slug")), "slug").select("id", "n_nationkey")


@query("jn16_relink", "SELECT DISTINCT CASE WHEN property_id % 10 = 0 THEN property_id - 1 ELSE property_id END AS keeper, bank_id FROM auction WHERE bank_id IS NOT NULL")
def jn16(v: Views):
    """Children of merged listings move to the keeper; one that is there already is not linked twice."""
    pointer = v.property.filter("id % 10 = 0").select(F.col("id").alias("property_id"), (F.col("id") - 1).alias("keeper"))
    moved = v.auction.filter("bank_id IS NOT NULL").join(pointer, "property_id", "left")
    return moved.select(F.coalesce("keeper", "property_id").alias("keeper"), "bank_id").distinct()


@query("jn17_pick_urls", """SELECT * FROM (SELECT url, 'new' AS kind FROM pages WHERE page_id % 3 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 1) GROUP BY url ORDER BY max(page_id) DESC, url LIMIT 7)
  UNION ALL SELECT * FROM (SELECT url, 'stale' AS kind FROM pages WHERE page_id % 3 = 1 GROUP BY url ORDER BY min(page_id), url LIMIT 3)""")  # fmt: skip
def jn17(v: Views):
    stored = v.pages.filter("page_id % 3 = 1")
    new = v.pages.filter("page_id % 3 = 0").join(stored.select("url"), "url", "left_anti").groupBy("url").agg(F.max("page_id").alias("at")).orderBy(F.desc("at"), "url").limit(7)
    stale = stored.groupBy("url").agg(F.min("page_id").alias("at")).orderBy("at", "url").limit(3)
    return new.select("url", F.lit("new").alias("kind")).unionByName(stale.select("url", F.lit("stale").alias("kind")))


@query("st01_total_order", "SELECT p.id, count(a.id) AS n FROM property p LEFT JOIN auction a ON a.property_id = p.id GROUP BY p.id ORDER BY n DESC, p.id DESC LIMIT 50")
def st01(v: Views):
    n = v.auction.groupBy(F.col("property_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return v.property.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), F.desc("id")).limit(50)


@query("st02_offset_page", "SELECT id, t.total, greatest(1, ceil(t.total / 20.0))::BIGINT AS total_pages, 3 < greatest(1, ceil(t.total / 20.0)) AS has_more FROM (SELECT id FROM property WHERE status = 'PUBLISHED' ORDER BY id DESC LIMIT 20 OFFSET 40), (SELECT count(*) AS total FROM property WHERE status = 'PUBLISHED') t")
def st02(v: Views):
    return S.page(v.property.filter("status = 'PUBLISHED'").select("id"), [F.col("id").desc()], 3, 20)


@query("st03_keyset_page", "SELECT id, title FROM property WHERE id > 100 ORDER BY id LIMIT 25")
def st03(v: Views):
    return S.keyset_page(v.property.select("id", "title"), "id", 100, 25)


@query("st04_top_groups", "SELECT b.name, t.n FROM (SELECT bank_id, count(*) AS n FROM auction WHERE bank_id IS NOT NULL GROUP BY bank_id ORDER BY n DESC, bank_id LIMIT 6) t JOIN bank b ON b.id = t.bank_id")
def st04(v: Views):
    top = v.auction.filter("bank_id IS NOT NULL").groupBy("bank_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bank_id").limit(6)
    return top.join(v.bank.withColumnRenamed("id", "bank_id"), "bank_id").select("name", "n")


@query("st05_capped", "SELECT id, (SELECT count(*) FROM auction WHERE status = 'LIVE') > 30 AS capped FROM auction WHERE status = 'LIVE' ORDER BY id LIMIT 30")
def st05(v: Views):
    return S.capped(v.auction.filter("status = 'LIVE'").select("id"), [F.col("id").asc()], 30)


@query("st06_priority_order", "SELECT n_name, row_number() OVER (ORDER BY coalesce(list_position(['NATION_12', 'NATION_8', 'NATION_17'], n_name), 999), n_name) AS place FROM nation")
def st06(v: Views):
    from pyspark.sql import Window

    wanted = F.array(*[F.lit(x) for x in ("NATION_12", "NATION_8", "NATION_17")])
    rank = F.coalesce(F.nullif(F.array_position(wanted, F.col("n_name")), F.lit(0)), F.lit(999))
    return v.nation.select("n_name", F.row_number().over(Window.orderBy(rank, "n_name")).cast("long").alias("place"))


@query("st07_saved_order", "SELECT r_name, coalesce(o.p, 1000 + r_regionkey) AS place FROM region LEFT JOIN (VALUES ('EUROPE', 1), ('AFRICA', 2)) o(n, p) ON o.n = r_name")
def st07(v: Views):
    saved = v.spark.createDataFrame([("EUROPE", 1), ("AFRICA", 2)], "r_name string, p int")
    return v.region.join(F.broadcast(saved), "r_name", "left").select("r_name", F.coalesce("p", 1000 + F.col("r_regionkey")).cast("int").alias("place"))


@query("st10_oldest_waiting", "SELECT id, auction_end FROM auction ORDER BY auction_end ASC NULLS FIRST, id LIMIT 40")
def st10(v: Views):
    return v.auction.select("id", "auction_end").orderBy(F.col("auction_end").asc_nulls_first(), "id").limit(40)


@query("so01_union_keys", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT l_orderkey FROM lineitem WHERE l_linenumber > 5")
def so01(v: Views):
    return v.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k")).union(v.lineitem.filter("l_linenumber > 5").select("l_orderkey")).distinct()


@query("so02_difference", "SELECT url FROM pages WHERE page_id % 3 = 0 EXCEPT SELECT url FROM pages WHERE page_id % 3 = 1")
def so02(v: Views):
    return v.pages.filter("page_id % 3 = 0").select("url").subtract(v.pages.filter("page_id % 3 = 1").select("url"))


@query("so05_first_per_key", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def so05(v: Views):
    return v.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
