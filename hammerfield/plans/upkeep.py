"""Queries: filters of the console and the API, exports, clean-up passes, small JSON texts of settings and messages."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import lifecycle as L
from ..operators import resolution as E
from ..operators import rollups as R
from ..operators import search as S
from ..sources import readers as X
from .listings import sql_bank_key, sql_map, sql_tidy
from ..operators.staging import shared_dir
from ..sources import sinks as K
from .proxies import Views
from .registry import ORACLE_SQL, query
from .search import _ACTIVE, EFFECTIVE, now_col


def rows_():
    return F.count(F.lit(1))


# -- filters -----------------------------------------------------------------------------------------------------


@query("fl09_state", "SELECT id FROM listing WHERE lower(state_text) IN ('odisha', 'orissa') OR (city_text IS NULL AND (contains(lower(title), 'odisha') OR contains(lower(title), 'orissa') OR contains(lower(kind_text || ' ' || state_text), 'odisha') OR contains(lower(kind_text || ' ' || state_text), 'orissa')))")
def fl09(v: Views):
    """Orissa under each of its spellings."""
    rows = v.listing.select("id", "title", F.col("city_text").alias("geo_city"), F.col("state_text").alias("geo_state"), F.concat("kind_text", F.lit(" "), "state_text").alias("address_text"))
    return rows.filter(S.in_state("Orissa")).select("id")


@query("fl12_admin", """SELECT id FROM property p WHERE status NOT IN ('DUPLICATE', 'REMOVED') AND (contains(lower(title), '1') OR contains(lower(address_text), '1')) AND EXISTS (SELECT 1 FROM auction a WHERE a.property_id = p.id AND a.bank_id = 3)
AND NOT EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = p.id AND l_linenumber = 7) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.id AND coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, '') = '')""")  # fmt: skip
def fl12(v: Views):
    """Not removed, with a text, a round of a bank, no document (here: seventh line), and a round without a borrower."""
    rounds = v.auction.filter("bank_id = 3").select(F.col("property_id").alias("id"))
    documents = v.orders.join(v.lineitem.filter("l_linenumber = 7"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("o_custkey").alias("id"))
    borrower = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority"))
    none = v.orders.filter(F.coalesce(borrower, F.lit("")) == "").select(F.col("o_custkey").alias("id"))
    found = v.property.filter(S.admin_predicate(q="1")).join(rounds, "id", "left_semi").join(documents, "id", "left_anti")
    return found.join(none, "id", "left_semi").select("id")


@query("fl14_api_filters", f"""SELECT id, title, total, page FROM (SELECT p.id, p.title, count(*) OVER () AS total, 2 AS page FROM property p WHERE status = 'PUBLISHED' AND id % 3 > 0 AND EXISTS (SELECT 1 FROM auction a WHERE a.property_id = p.id AND a.bank_id = 5 AND {_ACTIVE}) ORDER BY id DESC LIMIT 50 OFFSET 50)""")
def fl14(v: Views):
    """The second page of a request, as its parameters come: the limit is at most 50, active is the default."""
    asked = S.api_query({"bank": "5", "limit": "500", "page": "2", "updatedSince": "1998-01-01T00:00:00Z"}, {"5", "6"})
    changed = v.property.filter("id % 3 > 0")  # here: what was updated since
    found = S.published(changed, v.auction, asked.filters, now_col()).select("id", "title")
    whole = found.agg(rows_().alias("total"))
    page = found.orderBy(F.desc("id")).offset((asked.page - 1) * asked.limit).limit(asked.limit)
    return page.join(F.broadcast(whole)).select("id", "title", "total", F.lit(asked.page).alias("page"))


@query("fl20_thin", "SELECT p.id FROM property p WHERE status = 'PUBLISHED' AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.id AND o_orderkey % 4 = 0 AND 'feed:' || (o_orderkey % 9) IN (SELECT 'feed:' || (s_suppkey % 9) FROM supplier WHERE s_suppkey % 9 < 3))")
def fl20(v: Views):
    """Published, with a round that has no price (here: every fourth) from the feed of a website."""
    web = v.supplier.filter("s_suppkey % 9 < 3").select(F.concat(F.lit("feed:"), (F.col("s_suppkey") % 9).cast("string")).alias("feed")).distinct()
    rounds = v.orders.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("reserve_price"), F.concat(F.lit("feed:"), (F.col("o_orderkey") % 9).cast("string")).alias("feed"))
    thin = rounds.filter("reserve_price IS NULL").join(web, "feed", "left_semi").select("id")
    return v.property.filter("status = 'PUBLISHED'").join(thin, "id", "left_semi").select("id")


@query("jn06_reconcile", """WITH l AS (SELECT o_orderkey AS k, o_totalprice AS price, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS start FROM orders WHERE o_orderkey % 5 <> 0),
d AS (SELECT l_orderkey AS k, count(*) AS n, CASE WHEN l_orderkey % 6 > 0 THEN sum(l_extendedprice) END AS price, CASE WHEN l_orderkey % 13 > 0 THEN min(l_shipdate) END AS start FROM lineitem GROUP BY l_orderkey),
j AS (SELECT coalesce(l.k, d.k) AS k, l.k IS NULL AS unlisted, d.k IS NULL AS missing, d.n, list_filter([CASE WHEN d.price IS NULL THEN 'price' END, CASE WHEN d.start IS NULL THEN 'start' END], lambda x: x IS NOT NULL) AS fields,
  list_filter([CASE WHEN abs(l.price - d.price) > 1000 THEN 'price' END, CASE WHEN CAST(l.start AS DATE) <> CAST(d.start AS DATE) THEN 'start' END], lambda x: x IS NOT NULL) AS differ FROM l FULL OUTER JOIN d ON l.k = d.k)
SELECT k, CASE WHEN unlisted THEN 'NOT_LISTED' WHEN missing THEN 'DETAIL_MISSING' WHEN n < 2 THEN 'DETAIL_INVALID' WHEN len(fields) > 0 THEN 'DETAIL_INCOMPLETE' ELSE 'DETAIL_COMPLETE' END AS status, CASE WHEN missing THEN [] ELSE fields END AS missing_fields, differ AS mismatches,
  NOT unlisted AND NOT missing AND n >= 2 AND len(fields) = 0 AND len(differ) = 0 AS ready FROM j""")  # fmt: skip
def jn06(v: Views):
    """Listed rows against their details: status, fields the detail lacks, fields that differ, and what is ready."""
    listed = v.orders.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.struct(F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderdate")).alias("start")).alias("l"))
    detail = v.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(rows_().alias("n"), F.sum("l_extendedprice").alias("price"), F.min("l_shipdate").alias("start"))
    detail = detail.select("k", F.struct("n", F.when(F.col("k") % 6 > 0, F.col("price")).alias("price"), F.when(F.col("k") % 13 > 0, F.col("start")).alias("start")).alias("d"))
    lacks = F.array_compact(F.array(*[F.when(F.col(f"d.{c}").isNull(), F.lit(c)) for c in ("price", "start")]))
    differ = F.array_compact(F.array(F.when(F.abs(F.col("l.price") - F.col("d.price")) > 1000, "price"), F.when(F.to_date("l.start") != F.to_date("d.start"), "start")))
    unlisted, missing, invalid = F.col("l").isNull(), F.col("d").isNull(), F.col("d.n") < 2
    status = F.when(unlisted, "NOT_LISTED").when(missing, "DETAIL_MISSING").when(invalid, "DETAIL_INVALID").when(F.size(lacks) > 0, "DETAIL_INCOMPLETE").otherwise("DETAIL_COMPLETE")
    ready = ~unlisted & (status == "DETAIL_COMPLETE") & (F.size(differ) == 0)
    return listed.join(detail, "k", "full_outer").select("k", status.alias("status"), F.when(missing, F.array().cast("array<string>")).otherwise(lacks).alias("missing_fields"), differ.alias("mismatches"), ready.alias("ready"))


# -- exports -----------------------------------------------------------------------------------------------------

_PUBLISHED_BANKS = "SELECT DISTINCT bank_id FROM auction a JOIN property p ON p.id = a.property_id AND p.status = 'PUBLISHED' WHERE bank_id IS NOT NULL"


@query("snk06_sitemap", f"""SELECT 'property' AS kind, id::VARCHAR AS slug FROM (SELECT id FROM property WHERE status = 'PUBLISHED' ORDER BY id DESC LIMIT 40000) UNION ALL SELECT 'bank', lower(s_name) FROM supplier WHERE s_suppkey IN ({_PUBLISHED_BANKS})
UNION ALL SELECT 'city', lower(geo_city) FROM property p WHERE status = 'PUBLISHED' AND geo_city IS NOT NULL AND EXISTS (SELECT 1 FROM auction a WHERE a.property_id = p.id AND {_ACTIVE}) GROUP BY lower(geo_city) HAVING count(*) >= 5""")  # fmt: skip
def snk06(v: Views):
    """The newest 40,000 published listings, the banks of published rounds, and the cities with five active listings or more."""
    live = v.property.filter("status = 'PUBLISHED'")
    newest = live.orderBy(F.desc("id")).limit(40_000).select(F.lit("property").alias("kind"), F.col("id").cast("string").alias("slug"))
    rounds = v.auction.join(live.select(F.col("id").alias("property_id")), "property_id", "left_semi")
    banks = v.supplier.join(rounds.select(F.col("bank_id").alias("s_suppkey")), "s_suppkey", "left_semi").select(F.lit("bank").alias("kind"), F.lower("s_name").alias("slug"))
    open_ = v.auction.filter(L.status_predicate(set(L.OPEN), F.col("status"), F.col("auction_start"), F.col("auction_end"), now_col())).select(F.col("property_id").alias("id"))
    cities = live.filter("geo_city IS NOT NULL").join(open_, "id", "left_semi").groupBy(F.lower("geo_city").alias("slug")).agg(rows_().alias("n")).filter("n >= 5").select(F.lit("city").alias("kind"), "slug")
    return newest.unionByName(banks).unionByName(cities)


SITEMAP = {"head": '<?xml version="1.0" encoding="UTF-8"?>\n<urlset>\n', "tail": "\n</urlset>\n", "suffix": "xml", "most": 40_000}


@query("snk06_published_sitemap", f"SELECT 'https://listings.example.org/' || kind || '/' || slug AS loc FROM ({ORACLE_SQL['snk06_sitemap']})")
def snk06_published(v: Views):
    """The sitemap as published documents, read back by their manifest."""
    loc = F.concat(F.lit("https://listings.example.org/"), "kind", F.lit("/"), "slug")
    escaped = F.replace(F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    path = f"{shared_dir(v.spark)}/sitemap-{uuid.uuid4().hex}"
    K.publish(snk06(v).select(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>")).alias("body")), path, **SITEMAP)
    found = K.published(v.spark, path).select(F.explode(F.regexp_extract_all("text", F.lit("<loc>([^<]*)</loc>"), F.lit(1))).alias("loc"))
    return found.select(F.replace(F.replace("loc", F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&")).alias("loc"))


@query("snk07_api_shape", f"""WITH n AS (SELECT * FROM (SELECT *, {EFFECTIVE} AS s, row_number() OVER (PARTITION BY property_id ORDER BY created_at DESC, id DESC) AS k FROM auction) WHERE k = 1)
SELECT p.id, p.title, n.s AS status, n.reserve_price AS price, strftime(n.auction_start, '%Y-%m-%dT%H:%M:%S.000Z') AS start, p.category AS kind, NOT (n.id IS NULL) AS has_round FROM property p LEFT JOIN n ON n.property_id = p.id""")  # fmt: skip
def snk07(v: Views):
    """The public JSON of a listing (latest round, details without hidden keys, ISO dates), written and read again."""
    s = L.effective_status(F.col("status"), F.col("auction_start"), F.col("auction_end"), now_col())
    last = S.latest(v.auction, ["property_id"], F.col("created_at").desc(), F.col("id").desc())
    iso = F.date_format("auction_start", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    round_ = F.struct(s.alias("status"), F.col("reserve_price").alias("reservePrice"), iso.alias("start"))
    last = last.select(F.col("property_id").alias("id"), round_.alias("auction"))
    details = F.map_filter(F.create_map(F.lit("kind"), F.col("category"), F.lit("legal_schedule"), F.col("address_text"), F.lit("empty"), F.lit("")), lambda k, x: (k != "legal_schedule") & x.isNotNull() & (x != ""))
    body = F.to_json(F.struct("id", "title", "auction", details.alias("details")))
    sent = v.property.join(last, "id", "left").select(body.alias("body"))
    r = F.from_json("body", "id long, title string, auction struct<status:string,reservePrice:double,start:string>, details map<string,string>")
    back = sent.select(r.alias("r"))
    return back.select("r.id", "r.title", "r.auction.status", F.col("r.auction.reservePrice").alias("price"), "r.auction.start", F.try_element_at("r.details", F.lit("kind")).alias("kind"), F.col("r.auction").isNotNull().alias("has_round"))


# -- clean-up ----------------------------------------------------------------------------------------------------


@query("er04_clean_pass", """WITH r AS (SELECT a.id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS t, p_brand AS bank, p_partkey % 2 AS price, p_partkey AS part, a.start FROM (SELECT o_orderkey AS id, o_orderdate AS start FROM orders) a JOIN part ON p_partkey = a.id),
k AS (SELECT *, first_value(id) OVER (PARTITION BY t, bank, price ORDER BY start DESC, id) AS keeper FROM r)
SELECT id, keeper FROM k WHERE id <> keeper AND id % 5 = keeper % 5""")  # fmt: skip
def er04(v: Views):
    """Same title, bank and price: the round that is latest is kept, of equal ones the oldest record; the others go unless the addresses contradict."""
    parts = v.part.select(F.col("p_partkey").alias("id"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "").alias("t"), F.col("p_brand").alias("bank"), (F.col("p_partkey") % 2).alias("price"))
    rows = parts.join(v.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start")), "id")
    keeper = rows.groupBy("t", "bank", "price").agg(F.max_by("id", F.struct("start", -F.col("id"))).alias("keeper"))
    out = rows.join(keeper, ["t", "bank", "price"]).filter("id <> keeper")
    title = F.lit("Row House Unit Seven")
    address = lambda c: F.concat(F.lit("Plot "), (c % 5).cast("string"), F.lit(" Sector Vashi Navi Mumbai"))
    allowed = E.exact_title_merge_allowed(E.facts(title, address(F.col("id"))), E.facts(title, address(F.col("keeper"))))
    return out.filter(allowed).select("id", "keeper")


@query("er15_alias_rewrite", f"""WITH d AS (SELECT id, city_text AS old, coalesce({sql_map(N.CITY_ALIASES)}[lower(trim(regexp_replace(city_text, '\\s+', ' ', 'g')))], city_text) AS new FROM listing) SELECT id, old, new, CASE WHEN id % 2 = 0 THEN old ELSE new END AS after_rollback FROM d WHERE new IS DISTINCT FROM old""")
def er15(v: Views):
    """Rows that an alias changes, with both names; the changes of even ids are then rolled back from that snapshot."""
    from ..operators.staging import stage

    rows = v.listing.select("id", "city_text")
    renamed = F.coalesce(T.lookup(F.lower(T.collapse(F.col("city_text"))), N.CITY_ALIASES), F.col("city_text"))
    snapshot = stage(rows.select("id", F.col("city_text").alias("old"), renamed.alias("new")).filter(~F.col("new").eqNullSafe(F.col("old"))), "rename")
    applied = rows.join(snapshot.select("id", "new"), "id").select("id", F.col("new").alias("city_text"))
    back = snapshot.filter("id % 2 = 0").select("id", F.col("old").alias("undone"))
    after = applied.join(back, "id", "left").select("id", F.coalesce("undone", "city_text").alias("after_rollback"))
    return snapshot.join(after, "id")


_CATEGORY_NAMES = ["asset reconstruction company india"]


@query("er16_mapping_report", f"""WITH b AS (SELECT DISTINCT bank_text FROM listing WHERE coalesce(trim(bank_text), '') <> ''), k AS (SELECT bank_text, {sql_bank_key('bank_text')} AS k, coalesce({sql_bank_key(f"{sql_map(N.BANK_ALIASES)}[{sql_bank_key('bank_text')}]")}, {sql_bank_key('bank_text')}) AS c FROM b),
d AS (SELECT unnest(['State Bank of India', 'uco  bank', 'Union Bank of India', 'Punjab National Bank']) AS name)
SELECT bank_text, CASE WHEN k.k = 'asset reconstruction company india' THEN 'CATEGORY' WHEN max(CASE WHEN d.name = bank_text THEN 1 END) = 1 THEN 'CONFIRMED' WHEN count(d.name) > 0 THEN 'UNCERTAIN' ELSE 'MISSING' END AS status FROM k LEFT JOIN d ON {sql_bank_key('d.name')} = k.c GROUP BY bank_text, k.k""")  # fmt: skip
def er16(v: Views):
    """Institutions as written against a directory: by name, by key, by neither, or the name of a kind of institution."""
    names = ["State Bank of India", "uco  bank", "Union Bank of India", "Punjab National Bank"]
    known = v.spark.createDataFrame([(x,) for x in names], "name string").withColumn("key", N.bank_key(F.col("name")))
    written = v.listing.filter("trim(bank_text) <> ''").select("bank_text").distinct()
    found = written.withColumn("key", N.canonical_bank_key(F.col("bank_text"))).join(known, "key", "left").groupBy("bank_text").agg(F.bool_or(F.col("name") == F.col("bank_text")).alias("exact"), F.count("name").alias("n"))
    status = F.when(N.bank_key(F.col("bank_text")).isin(*_CATEGORY_NAMES), "CATEGORY").when(F.col("exact"), "CONFIRMED").when(F.col("n") > 0, "UNCERTAIN").otherwise("MISSING")
    return found.select("bank_text", status.alias("status"))


@query("sc11_institution", r"""SELECT DISTINCT bank_text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(bank_text), 'asset\s+reconstruction\s+(company|co\.?)', 'arc', 'g'), 'co-?\s?operative', 'cooperative', 'g'), '^the\s+', ''), '\b(private|pvt|limited|ltd)\b\.?', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM listing WHERE bank_text IS NOT NULL""")
def sc11(v: Views):
    return v.listing.filter("bank_text IS NOT NULL").select("bank_text", N.institution_key(F.col("bank_text")).alias("key")).distinct()


@query("pg05_bulk_remove", "SELECT status, count(*) AS n, count(*) FILTER (WHERE changed) AS changed FROM (SELECT CASE WHEN hit THEN 'REMOVED' ELSE status END AS status, hit AS changed FROM (SELECT status, status NOT IN ('DUPLICATE', 'REMOVED') AND (contains(lower(title), '13') OR contains(lower(address_text), '13')) AS hit FROM property)) GROUP BY status")
def pg05(v: Views):
    out = S.bulk_remove(v.property, q="13")
    return out.groupBy("status").agg(rows_().alias("n"), F.count_if("changed").alias("changed"))


@query("pg08_problem_list", """SELECT source, unnest(list_filter([CASE WHEN errors > 150 THEN {'title': 'Many errors', 'detail': errors || ' runs failed', 'fix': 'look at the newest message'} END, CASE WHEN created < 10000 THEN {'title': 'Few records', 'detail': created || ' records', 'fix': 'check the list page'} END], lambda x: x IS NOT NULL), recursive := true)
FROM (SELECT source, count(*) FILTER (WHERE status = 'error') AS errors, sum(created) AS created FROM run_log GROUP BY source)""")  # fmt: skip
def pg08(v: Views):
    """A row for each problem of each source: title, detail and what to do."""
    sums = v.run_log.groupBy("source").agg(F.count_if(F.col("status") == "error").alias("errors"), F.sum("created").alias("created"))
    problem = lambda when, title, detail, fix: F.when(when, F.struct(F.lit(title).alias("title"), detail.alias("detail"), F.lit(fix).alias("fix")))
    many = problem(F.col("errors") > 150, "Many errors", F.concat(F.col("errors").cast("string"), F.lit(" runs failed")), "look at the newest message")
    few = problem(F.col("created") < 10000, "Few records", F.concat(F.col("created").cast("string"), F.lit(" records")), "check the list page")
    return sums.select("source", F.explode(F.array_compact(F.array(many, few))).alias("p")).select("source", "p.*")


@query("pg09_directory", f"""WITH b AS (SELECT bank_text, count(*) AS n FROM listing WHERE trim(bank_text) <> '' GROUP BY 1), l AS (SELECT *, {sql_tidy('bank_text')} AS label FROM b)
SELECT CASE WHEN regexp_matches(upper(left(label, 1)), '[A-Z]') THEN upper(left(label, 1)) ELSE '#' END AS letter, label, n, row_number() OVER (PARTITION BY CASE WHEN regexp_matches(upper(left(label, 1)), '[A-Z]') THEN upper(left(label, 1)) ELSE '#' END ORDER BY n DESC, label) AS place
FROM l WHERE contains(lower(label), 'union') OR contains(lower(label), 'bank') OR contains(lower(label), 'sbi')""")  # fmt: skip
def pg09(v: Views):
    """Banks whose label, not in capitals, has one of the words that a query stands for, by letter and by count."""
    banks = R.grouped_count(v.listing.filter("trim(bank_text) <> ''"), "bank_text").withColumn("label", T.tidy_case(F.col("bank_text")))
    hit = S.any_of([S.contains_ci(F.col("label"), x) for x in ("union", "bank", "sbi")])
    first = F.upper(F.substring("label", 1, 1))
    rows = banks.filter(hit).select(F.when(first.rlike("[A-Z]"), first).otherwise("#").alias("letter"), "label", "n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("letter").orderBy(F.desc("n"), "label")).cast("long"))


@query("pg22_scorecard", """SELECT bank_id, count(*) AS rounds, count(DISTINCT property_id) + max(CASE WHEN property_id IS NULL THEN 1 ELSE 0 END) AS ids, count(*) FILTER (WHERE p.status = 'PUBLISHED') AS published, count(*) FILTER (WHERE p.status = 'PENDING_REVIEW') AS held,
  count(*) FILTER (WHERE a.id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 5)) AS with_media, count(*) FILTER (WHERE a.id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS with_documents FROM auction a LEFT JOIN property p ON p.id = a.property_id GROUP BY bank_id""")  # fmt: skip
def pg22(v: Views):
    state = v.property.select(F.col("id").alias("property_id"), F.col("status").alias("listing"))
    has = v.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_or(F.col("l_linenumber") >= 5).alias("media"), F.bool_or(F.col("l_returnflag") == "R").alias("documents"))
    rows = v.auction.select("id", "bank_id", "property_id").join(state, "property_id", "left").join(has, "id", "left")
    ids = F.countDistinct("property_id") + F.max(F.col("property_id").isNull().cast("int"))
    return rows.groupBy("bank_id").agg(
        rows_().alias("rounds"), ids.alias("ids"), F.count_if(F.col("listing") == "PUBLISHED").alias("published"), F.count_if(F.col("listing") == "PENDING_REVIEW").alias("held"), F.count_if("media").alias("with_media"), F.count_if("documents").alias("with_documents"),
    )


@query("pg35_shapes", """WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*href="([^"]+)"', 1))[:40]) AS u FROM pages), p AS (SELECT page_id, list_filter(string_split(regexp_replace(u, '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM l WHERE starts_with(u, '/')),
s AS (SELECT page_id, coalesce(p[1], '') || '|' || len(p) || '|' || CASE WHEN len(p) = 0 THEN 'root' WHEN regexp_matches(p[-1], '^[0-9]+$') THEN 'num' WHEN regexp_matches(p[-1], '[0-9]{4,}$') THEN 'slugid' WHEN contains(p[-1], '-') THEN 'slug' ELSE 'word' END AS shape FROM p),
g AS (SELECT page_id, shape, count(*) AS n FROM s GROUP BY ALL) SELECT page_id, shape, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, shape) AS k FROM g) WHERE k <= 6""")  # fmt: skip
def pg35(v: Views):
    """The six most frequent shapes of each page's links into its own site."""
    links = v.pages.select("page_id", F.explode(X.page_links(F.col("html"))).alias("u")).filter(F.col("u").startswith("/"))
    shapes = R.grouped_count(links.select("page_id", T.url_shape(F.concat(F.lit("https://x"), F.col("u"))).alias("shape")), "page_id", "shape")
    return R.top_per_group(shapes, ["page_id"], [F.desc("n"), F.col("shape")], 6).select("page_id", "shape", "n")


# -- JSON texts --------------------------------------------------------------------------------------------------

_PLANS = """CASE id % 4 WHEN 0 THEN '[{"id":"month","price":' || id || '},{"id":"free","price":0},{"id":"bad"}]' WHEN 1 THEN '[{"id":"year","price":900,"days":365}]' WHEN 2 THEN 'none' END"""


@query("pg37_plans", """SELECT id, 'month' AS plan, id::DOUBLE AS price, 30 AS days FROM listing WHERE id % 4 = 0 AND id > 0 UNION ALL SELECT id, 'year', 900, 365 FROM listing WHERE id % 4 = 1 UNION ALL SELECT id, 'default', 99, 30 FROM listing WHERE id % 4 > 1 OR id = 0""")
def pg37(v: Views):
    """The plans of a setting that have a price; 30 days unless they say so, and a plan of our own where none is left."""
    given = F.filter(F.from_json("j", "array<struct<id:string,price:double,days:int>>"), lambda p: p["price"] > 0)
    plans = F.transform(given, lambda p: F.struct(p["id"].alias("plan"), p["price"].alias("price"), F.coalesce(p["days"], F.lit(30)).alias("days")))
    own = F.array(F.struct(F.lit("default").alias("plan"), F.lit(99.0).alias("price"), F.lit(30).alias("days")))
    rows = v.listing.select("id", F.expr(_PLANS).alias("j"))
    return rows.select("id", F.explode(F.when(F.size(plans) > 0, plans).otherwise(own)).alias("p")).select("id", "p.*")


_DOCS = """CASE page_id % 4 WHEN 0 THEN '["' || url || '","ftp://y","https://x/' || page_id || '.pdf"]' WHEN 1 THEN 'broken' WHEN 2 THEN '[]' END"""


@query("sj03_json_list", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN [url, 'https://x/' || page_id || '.pdf'] ELSE [] END AS urls FROM pages")
def sj03(v: Views):
    """The web addresses of a JSON list; what is no list has none."""
    urls = F.filter(F.from_json("j", "array<string>"), lambda u: u.rlike("^https?://"))
    return v.pages.select("page_id", F.expr(_DOCS).alias("j")).select("page_id", F.coalesce(urls, F.array().cast("array<string>")).alias("urls"))


_MARKED = """CASE event_id % 3 WHEN 0 THEN 'read [YIELD_V1] {"verdict":"' || CASE event_id % 2 WHEN 0 THEN 'EMPTY' ELSE 'OTHER' END || '","streak":' || event_id % 7 || '}\nmore' WHEN 1 THEN '[YIELD_V1] {broken' ELSE props END"""


@query("sj05_yield_marker", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'EMPTY' END AS verdict, CASE WHEN event_id % 6 = 0 THEN event_id % 7 END AS streak FROM events")
def sj05(v: Views):
    """The marker anywhere in a message; only a verdict that there is counts."""
    r = F.from_json(F.regexp_extract("m", r"\[YIELD_V1\] (\{[^\n]*\})", 1), "verdict string, streak long")
    known = r["verdict"].isin("PRODUCTIVE", "EMPTY", "ZERO_YIELD", "DROPPED", "ALL_REJECTED")
    rows = v.events.select("event_id", F.expr(_MARKED.replace("\n", "' || chr(10) || '")).alias("m"))
    return rows.select("event_id", F.when(known, r["verdict"]).alias("verdict"), F.when(known, r["streak"]).alias("streak"))


_SNAPSHOT = """'{"v":' || event_id % 3 || ',"counts":{"total":' || CASE event_id % 5 WHEN 0 THEN '"many"' WHEN 1 THEN 'null' ELSE CAST(event_id AS {string}) END || ',"open":2}}'"""


@query("sj07_snapshot", "SELECT event_id, CASE WHEN event_id % 3 = 1 AND event_id % 5 > 1 THEN event_id END AS total FROM events")
def sj07(v: Views):
    """Counts of a snapshot of version 1 whose numbers are all there."""
    r = F.from_json("j", "v int, counts struct<total:long,open:long>")
    whole = (r["v"] == 1) & r["counts"]["total"].isNotNull() & r["counts"]["open"].isNotNull()
    return v.events.select("event_id", F.expr(_SNAPSHOT.replace("{string}", "string")).alias("j")).select("event_id", F.when(whole, r["counts"]["total"]).alias("total"))


@query("sj10_content_hash", """SELECT id, sha256('{"bank":"' || coalesce(bank_text, '') || '","id":' || id || ',"title":"' || coalesce(title, '') || '"}') AS hash FROM listing""")
def sj10(v: Views):
    """SHA-256 of a record's JSON with its keys in order."""
    return v.listing.select("id", F.sha2(T.canonical_json({"title": F.coalesce("title", F.lit("")), "id": F.col("id"), "bank": F.coalesce("bank_text", F.lit(""))}), 256).alias("hash"))


#: What a saved search may hold.
SAVED_KEYS = ["q", "state", "city", "locality", "bank", "category", "min", "max", "status"]
_SEARCH = """CASE id % 3 WHEN 0 THEN '{"q":"flat ' || id || '","city":"Pune","evil":"1","state":" ","locality":"' || repeat('x', 81) || '","max":"9"}' WHEN 1 THEN '{}' END"""


@query("sj11_saved_filters", "SELECT id, CASE WHEN id % 3 = 0 THEN ['city=Pune', 'max=9', 'q=flat ' || id] ELSE [] END AS kept FROM listing")
def sj11(v: Views):
    kept = F.map_filter(F.from_json("j", "map<string,string>"), lambda k, x: k.isin(*SAVED_KEYS) & (F.trim(x) != "") & (F.length(x) <= 80))
    pairs = F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return v.listing.select("id", F.expr(_SEARCH).alias("j")).select("id", F.coalesce(F.array_sort(pairs), F.array().cast("array<string>")).alias("kept"))
