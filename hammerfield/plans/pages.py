"""Queries: listing pages, staging of crawled rows, links and rules texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle as L
from ..operators import resolution as E
from ..operators import rollups as R
from ..operators import search as S
from ..operators import staging_rows as G
from ..sources import readers as X
from .entities import _WORDS, named
from .proxies import Views
from .registry import query
from .search import EFFECTIVE, now_col


def rows_():
    return F.count(F.lit(1))


@query("pg04_open_request", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS request FROM events WHERE event_type = 'signup' GROUP BY user_id")
def pg04(v: Views):
    """Of several open requests of one user the oldest is shown."""
    return S.latest(v.events.filter("event_type = 'signup'"), ["user_id"], F.col("ts").asc(), F.col("event_id").asc()).select("user_id", F.col("event_id").alias("request"))


_ATTRIBUTES = "SELECT id, unnest(['review', 'area', 'floor']) AS key FROM property WHERE id % 2 = 0"


@query("pg06_publish_drafts", f"""SELECT p.id, CASE WHEN status = 'PENDING_REVIEW' THEN 'PUBLISHED' ELSE status END AS status, count(a.key) AS attributes FROM property p LEFT JOIN ({_ATTRIBUTES}) a ON a.id = p.id AND NOT (status = 'PENDING_REVIEW' AND a.key = 'review') GROUP BY p.id, status""")
def pg06(v: Views):
    """Drafts become published, and lose one attribute."""
    listed = v.property.select("id", "status")
    attributes = v.property.filter("id % 2 = 0").select("id", F.explode(F.array(*[F.lit(k) for k in ("review", "area", "floor")])).alias("key"))
    drafts = listed.filter("status = 'PENDING_REVIEW'").select("id", F.lit("review").alias("key"))
    kept = attributes.join(drafts, ["id", "key"], "left_anti").groupBy("id").agg(rows_().alias("attributes"))
    out = listed.withColumn("status", F.when(F.col("status") == "PENDING_REVIEW", "PUBLISHED").otherwise(F.col("status")))
    return out.join(kept, "id", "left").select("id", "status", F.coalesce("attributes", F.lit(0)).alias("attributes"))


_LIKE = "len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))"


@query("pg07_clean_duplicates", f"""WITH p AS (SELECT *, {_WORDS} AS t FROM part), g AS (SELECT x.p_brand, x.p_size, avg({_LIKE}) AS likeness FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey GROUP BY ALL HAVING avg({_LIKE}) >= 0.6)
SELECT p_partkey AS id, keeper FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS keeper FROM p SEMI JOIN g USING (p_brand, p_size)) WHERE p_partkey <> keeper""")  # fmt: skip
def pg07(v: Views):
    """Of a group that is alike on the whole, all but the oldest are hidden."""
    block = ["p_brand", "p_size"]
    rows = named(v).join(v.part.select("p_partkey", "p_size"), "p_partkey")
    groups = E.duplicate_groups(rows, block, "p_partkey", "t").filter("likeness >= 0.6 - 1e-12").select(*block, F.col("oldest").alias("keeper"))
    return rows.join(groups, block).filter("p_partkey <> keeper").select(F.col("p_partkey").alias("id"), "keeper")


_OPEN = f"SELECT DISTINCT property_id FROM (SELECT property_id, {EFFECTIVE} AS s FROM auction) WHERE s IN ('UPCOMING', 'LIVE', 'AUCTION_TODAY')"


@query("pg12_city_page", f"""WITH c AS (SELECT id, geo_city FROM property WHERE status = 'PUBLISHED' AND id IN ({_OPEN}) AND regexp_replace(lower(geo_city), '[^a-z0-9]+', '-', 'g') = 'nation-3')
SELECT id, geo_city, (SELECT count(*) FROM c) < 5 AS thin FROM c ORDER BY id DESC LIMIT 48""")  # fmt: skip
def pg12(v: Views):
    """The active listings of the city of a slug, newest 48; a city of fewer than five is thin."""
    effective = L.effective_status(F.col("status"), F.col("auction_start"), F.col("auction_end"), now_col())
    open_ = v.auction.filter(effective.isin("UPCOMING", "LIVE", "AUCTION_TODAY")).select(F.col("property_id").alias("id"))
    city = v.property.filter((F.col("status") == "PUBLISHED") & (T.city_slug(F.col("geo_city")) == "nation-3")).join(open_, "id", "left_semi").select("id", "geo_city")
    whole = city.agg((rows_() < 5).alias("thin"))
    return city.orderBy(F.desc("id")).limit(48).join(F.broadcast(whole))  # one row


_TAGS = "[source, 'c' || doc_id % 3, lang || doc_id % 2]"


@query("pg14_articles", f"SELECT doc_id, lang, (SELECT count(DISTINCT lang) FROM documents) AS categories FROM documents WHERE lang = 'en' AND list_contains({_TAGS}, 'en1')")
def pg14(v: Views):
    tags = F.array("source", F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")), F.concat("lang", (F.col("doc_id") % 2).cast("string")))
    categories = v.documents.agg(F.countDistinct("lang").alias("categories"))
    return v.documents.select("doc_id", "lang", tags.alias("tags")).filter("lang = 'en'").filter(F.array_contains("tags", "en1")).select("doc_id", "lang").join(F.broadcast(categories))


@query("pg17_suggest_inside", """WITH a AS (SELECT geo_state AS chosen, city AS label, count(*) AS n FROM property WHERE contains(lower(city), '1') GROUP BY ALL), b AS (SELECT geo_state || '/' || city AS chosen, category AS label, count(*) AS n FROM property WHERE category IS NOT NULL GROUP BY ALL)
SELECT chosen, label, n FROM (SELECT *, row_number() OVER (PARTITION BY chosen ORDER BY n DESC, label) AS k FROM a) WHERE k <= 9
UNION ALL SELECT chosen, label, n FROM (SELECT *, row_number() OVER (PARTITION BY chosen ORDER BY n DESC, label) AS k FROM b) WHERE k <= 12""")  # fmt: skip
def pg17(v: Views):
    """Inside a chosen state its cities, nine at most; inside a chosen city its categories, twelve at most."""
    cities = R.grouped_count(v.property.filter(S.contains_ci(F.col("city"), "1")).select(F.col("geo_state").alias("chosen"), F.col("city").alias("label")), "chosen", "label")
    kinds = R.grouped_count(v.property.filter("category IS NOT NULL").select(F.concat_ws("/", "geo_state", "city").alias("chosen"), F.col("category").alias("label")), "chosen", "label")
    top = lambda df, n: R.top_per_group(df, ["chosen"], [F.desc("n"), F.col("label")], n).select("chosen", "label", "n")
    return top(cities, 9).unionByName(top(kinds, 12))


_STATE_NAMES = ["Orissa", "Maharashtra", "Bihar", "Tamil Nadu", "Pondicherry"]
_ADDRESS = "concat_ws(', ', city_text, CASE WHEN id % 2 = 0 THEN kind_text END, state_text, CASE WHEN id % 3 = 0 THEN '400001' END)"


@query("pg19_address_parts", f"""SELECT id, CASE WHEN s IS NOT NULL THEN p[1] END AS city, s AS state FROM (SELECT id, p, list_filter(p[2:], lambda x: list_contains({[x.lower() for x in _STATE_NAMES]}, lower(x)))[1] AS s FROM (SELECT id, list_transform(string_split({_ADDRESS}, ','), lambda x: trim(x)) AS p FROM listing))""")
def pg19(v: Views):
    """An address "city, ..., state, PIN": the first part that is a state, after the first; the city is the first part."""
    parts = F.transform(F.split(F.expr(_ADDRESS), ","), lambda x: F.trim(x))
    known = F.filter(F.slice(parts, 2, 1000), lambda x: F.lower(x).isin(*[s.lower() for s in _STATE_NAMES]))
    state = F.get(known, F.lit(0))
    return v.listing.select("id", F.when(state.isNotNull(), F.get(parts, F.lit(0))).alias("city"), state.alias("state"))


@query("pg21_slice_progress", """WITH p AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders), d AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > 300000 GROUP BY ALL)
SELECT o_orderpriority AS kind, count(*) AS planned, count(d.n) AS finished, coalesce(sum(d.n), 0)::BIGINT AS rows, round(coalesce(sum(total), 0), 2) AS total FROM p LEFT JOIN d USING (o_orderpriority, o_orderstatus) GROUP BY 1""")  # fmt: skip
def pg21(v: Views):
    """Of the planned slices how many are finished, and the sums of their counters."""
    planned = v.orders.select("o_orderpriority", "o_orderstatus").distinct()
    done = v.orders.filter("o_totalprice > 300000").groupBy("o_orderpriority", "o_orderstatus").agg(rows_().alias("n"), F.sum("o_totalprice").alias("total"))
    both = planned.join(done, ["o_orderpriority", "o_orderstatus"], "left").groupBy(F.col("o_orderpriority").alias("kind"))
    return both.agg(rows_().alias("planned"), F.count("n").alias("finished"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.round(F.coalesce(F.sum("total"), F.lit(0)), 2).alias("total"))


@query("pg23_live_view", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY created_at DESC, id DESC) AS k FROM auction WHERE bank_id IS NOT NULL), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT bank_id, count(*) AS published FROM auction a JOIN property p ON p.id = a.property_id AND p.status = 'PUBLISHED' GROUP BY 1)
SELECT n.bank_id, n.id, coalesce(l.n, 0) AS documents, coalesce(p.published, 0) AS published FROM n LEFT JOIN l ON l_orderkey = n.id LEFT JOIN p ON p.bank_id = n.bank_id WHERE k <= 30""")  # fmt: skip
def pg23(v: Views):
    """Each source's newest 30 rounds with their documents, and how many of its listings are published."""
    newest = R.top_per_group(v.auction.filter("bank_id IS NOT NULL"), ["bank_id"], [F.desc("created_at"), F.desc("id")], 30).select("bank_id", "id")
    live = v.property.filter("status = 'PUBLISHED'").select(F.col("id").alias("property_id"))
    published = v.auction.join(live, "property_id", "left_semi").groupBy("bank_id").agg(rows_().alias("published"))
    out = R.child_counts(newest, v.lineitem, "id", "l_orderkey").join(published, "bank_id", "left")
    return out.select("bank_id", "id", F.col("n").alias("documents"), F.coalesce("published", F.lit(0)).alias("published"))


@query("pg25_documents", """SELECT l_linenumber, l_partkey, coalesce(CASE WHEN l_returnflag <> 'N' THEN p_name END, p_type) AS title FROM lineitem JOIN auction a ON a.id = l_orderkey JOIN property p ON p.id = a.property_id AND p.status = 'PUBLISHED' JOIN part ON p_partkey = l_partkey
WHERE p.id = (SELECT min(id) FROM property WHERE status = 'PUBLISHED') ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 30""")  # fmt: skip
def pg25(v: Views):
    """Documents of one published listing; without a title of its own a document shows its type."""
    one = v.property.filter("status = 'PUBLISHED'").agg(F.min("id").alias("property_id"))
    rounds = v.auction.join(F.broadcast(one), "property_id", "left_semi").select(F.col("id").alias("l_orderkey"))
    docs = v.lineitem.join(rounds, "l_orderkey", "left_semi").join(v.part, F.col("p_partkey") == F.col("l_partkey"))
    title = F.coalesce(F.when(F.col("l_returnflag") != "N", F.col("p_name")), F.col("p_type"))
    return docs.orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(30).select("l_linenumber", "l_partkey", title.alias("title"))


_LINE = "CASE event_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN substr(props, 1, 4) WHEN 2 THEN '' ELSE props END"


@query("pg29_json_lines", f"SELECT count(*) AS lines, count(*) FILTER (WHERE bad) AS broken, sum(k)::BIGINT AS total FROM (SELECT NOT json_valid(l) AS bad, CASE WHEN json_valid(l) THEN CAST(json_extract(l, '$.k') AS BIGINT) END AS k FROM (SELECT {_LINE} AS l FROM events) WHERE trim(l) <> '')")
def pg29(v: Views):
    rows = X.json_lines(v.events.selectExpr(f"{_LINE} AS value"), "k bigint")
    return rows.agg(rows_().alias("lines"), F.count_if("broken").alias("broken"), F.sum("k").alias("total"))


_CARD = "SELECT page_id, page_id % 40 AS key, url, CASE WHEN page_id % 3 > 0 THEN 'city' END AS city, CASE WHEN page_id % 5 > 0 THEN page_id END AS price FROM pages"


@query("pg30_staging_rows", f"""WITH c AS ({_CARD}), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS n FROM c) WHERE n = 1 AND key NOT IN (SELECT page_id FROM pages WHERE page_id % 10 = 7))
SELECT key, CASE WHEN key % 4 = 0 THEN 'in database' WHEN key % 6 = 0 THEN 'known' ELSE 'new' END AS state, list_filter([CASE WHEN city IS NULL THEN 'city' END, CASE WHEN price IS NULL THEN 'price' END], lambda x: x IS NOT NULL) AS missing FROM u""")  # fmt: skip
def pg30(v: Views):
    cards = v.pages.select("page_id", (F.col("page_id") % 40).alias("key"), F.when(F.col("page_id") % 3 > 0, "city").alias("city"), F.when(F.col("page_id") % 5 > 0, F.col("page_id")).alias("price"))
    staged = v.pages.filter("page_id % 10 = 7").select(F.col("page_id").alias("key"))
    keys = cards.select("key").distinct()
    return G.staging_rows(cards, staged, keys.filter("key % 4 = 0"), keys.filter("key % 6 = 0"), ["city", "price"])


@query("pg31_page_outcomes", """WITH o AS (SELECT page_id, page_id % 8 AS run, CASE WHEN page_id % 5 > 2 THEN 'ok' WHEN contains(html, '<article>') THEN 'layout_changed' ELSE 'empty' END AS outcome FROM pages),
i AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY page_id) AS g FROM o),
s AS (SELECT *, CASE WHEN outcome = 'ok' THEN 0 ELSE row_number() OVER (PARTITION BY run, g, outcome = 'ok' ORDER BY page_id) END AS streak FROM i),
t AS (SELECT *, coalesce(sum(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT page_id, outcome FROM t WHERE before = 0""")  # fmt: skip
def pg31(v: Views):
    """Pages of a run up to the third in a row on which no card is found."""
    outcome = F.when(F.col("page_id") % 5 > 2, "ok").when(F.col("html").contains("<article>"), "layout_changed").otherwise("empty")
    rows = v.pages.select("page_id", (F.col("page_id") % 8).alias("run"), outcome.alias("outcome"))
    return G.until_streak(rows, ["run"], ["page_id"], F.col("outcome") != "ok", 3).select("page_id", "outcome")


@query("pg32_file_plan", """WITH f AS (SELECT page_id AS file, page_id % 300 AS id, CASE WHEN page_id % 9 = 0 THEN 'Goa' ELSE 'Maharashtra' END AS state FROM pages),
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file) AS n FROM f), b AS (SELECT *, CASE WHEN n > 1 THEN 'duplicate' WHEN state <> 'Maharashtra' THEN 'invalid' END AS r FROM a),
c AS (SELECT *, CASE WHEN r IS NULL THEN row_number() OVER (PARTITION BY r IS NULL ORDER BY file) END AS k FROM b)
SELECT file, coalesce(r, CASE WHEN k > 50 THEN 'over limit' WHEN id % 4 = 0 THEN 'already stored' ELSE 'new' END) AS plan FROM c""")  # fmt: skip
def pg32(v: Views):
    files = v.pages.select(F.col("page_id").alias("file"), (F.col("page_id") % 300).alias("id"), F.when(F.col("page_id") % 9 == 0, "Goa").otherwise("Maharashtra").alias("state"))
    stored = files.select("id").distinct().filter("id % 4 = 0")
    return G.file_plan(files, stored, "Maharashtra", 50)


_TIME = "start + interval 1 minute * (id % 1440)"


@query("pg33_rendered_record", f"""SELECT id, why, len(why) = 0 AS usable, CASE WHEN len(why) = 0 THEN trim(title) || ' | ' || price_text || ' | ' || strftime({_TIME} + interval 330 minute, '%Y-%m-%dT%H:%M') END AS record
FROM (SELECT *, list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'no title' END, CASE WHEN price_text IS NULL THEN 'no price' END, CASE WHEN city_text IS NULL AND state_text IS NULL THEN 'no place' END], lambda x: x IS NOT NULL) AS why FROM listing)""")  # fmt: skip
def pg33(v: Views):
    """A rendered page's record with what it lacks; its time is local, without an offset."""
    at = F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 1440).cast("int"))
    lacks = {"no title": F.coalesce(F.trim("title"), F.lit("")) == "", "no price": F.col("price_text").isNull(), "no place": F.col("city_text").isNull() & F.col("state_text").isNull()}
    rows = v.listing.withColumn("why", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lacks.items()])))
    record = F.concat_ws(" | ", F.trim("title"), "price_text", F.date_format(at + F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd'T'HH:mm"))
    return rows.select("id", "why", (F.size("why") == 0).alias("usable"), F.when(F.size("why") == 0, record).alias("record"))


_RULES = "CASE id % 4 WHEN 0 THEN '[{\"text\":\"Keep ' || id || '\",\"on\":true},{\"text\":\"Off\",\"on\":false}]' WHEN 1 THEN '- First ' || id || '\n\n* Second' WHEN 2 THEN '[broken' END"


_WEIGHTS = {"detail": 6, "list": 4, "other": 1}


def crawl_links(v: Views):
    """Links between pages: each leads to two others."""
    n = v.pages.agg(F.max("page_id").alias("n"))
    both = v.pages.select("page_id").join(F.broadcast(n)).select(F.col("page_id").alias("source"), F.explode(F.array((F.col("page_id") * 7 + 1) % F.col("n"), (F.col("page_id") * 3 + 2) % F.col("n"))).alias("url"))
    kind = F.when(F.col("url") % 5 == 0, "detail").when(F.col("url") % 5 < 3, "list").otherwise("other")
    return both.select("source", "url", kind.alias("kind"), (F.col("source") % 3).cast("int").alias("bonus"))


@query("pg36_crawl_frontier")
def pg36(v: Views):
    start = v.pages.filter("page_id = 0").select(F.col("page_id").alias("url"), F.lit("list").alias("kind"))
    return G.crawl(crawl_links(v), start, _WEIGHTS, 8, 15, 6)


@query("pg38_rules_text", f"""SELECT id, CASE WHEN r IS NULL THEN '' WHEN r LIKE '[%' THEN CASE WHEN json_valid(r) THEN 'Keep ' || id ELSE '' END ELSE array_to_string(list_filter(list_transform(string_split(r, chr(10)), lambda x: trim(regexp_replace(x, '^[\\s*-]+', ''))), lambda x: x <> ''), chr(10)) END AS rules FROM (SELECT id, {_RULES.replace(chr(10), "' || chr(10) || '")} AS r FROM listing)""")
def pg38(v: Views):
    """The enabled rules of a text, one a line: a JSON array, or lines with bullets."""
    return v.listing.select("id", X.enabled_rules(F.expr(_RULES.replace("\n", "' || chr(10) || '"))).alias("rules"))


@query("pg39_page_names_state", r"SELECT page_id, regexp_matches(h || ' ' || t, '(?i)(^|[^\p{L}\p{N}_])(the|que)([^\p{L}\p{N}_]|$)') AS named FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g') AS h, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)")
def pg39(v: Views):
    """Pages whose heading or title names one of some words; a page saved as view-source is unwrapped before."""
    wrapped = F.when(F.col("page_id") % 2 == 0, X.wrap_source(F.col("html"))).otherwise(F.col("html"))
    return v.pages.select("page_id", X.names_any(X.unwrap_source(wrapped), ["the", "que"]).alias("named"))


@query("pg40_next_page", r"""SELECT page_id, CASE WHEN u LIKE 'https://%' AND regexp_extract(lower(u), '^[a-z]+://([^/?#:]+)', 1) = regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AND u <> url AND page_id % 10 <> 3 THEN u END AS next
FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^http:', 'https:') || '&p=' || page_id WHEN 2 THEN 'https://other.example.org/x' ELSE regexp_replace(url, '^https?:', 'https:') || '#' || page_id END AS u FROM pages)""")  # fmt: skip
def pg40(v: Views):
    """The next page of each page, if it is another of the same host by https that was not visited."""
    url, i = F.col("url"), F.col("page_id")
    secure = F.regexp_replace(url, "^https?:", "https:")
    following = F.when(i % 4 == 0, url).when(i % 4 == 1, F.concat(F.regexp_replace(url, "^http:", "https:"), F.lit("&p="), i.cast("string"))).when(i % 4 == 2, "https://other.example.org/x").otherwise(F.concat(secure, F.lit("#"), i.cast("string")))
    rows = v.pages.select("page_id", "url", following.alias("u"))
    visited = rows.filter("page_id % 10 = 3").select("u").distinct()
    return G.next_pages(rows, visited)


@query("sk07_notice_links", r"""SELECT DISTINCT page_id, href, kind FROM (SELECT page_id, regexp_extract(a, '(?i)href="([^"]+)"', 1) AS href, lower(regexp_replace(regexp_extract(a, '(?is)>(.*)</a>', 1), '<[^>]*>', '', 'g')) AS t,
  CASE WHEN regexp_matches(a, '(?i)href="[^"]+\.(pdf|docx?|xlsx?|zip|csv)(\?[^"]*)?"') THEN 'file' WHEN regexp_matches(lower(regexp_replace(regexp_extract(a, '(?is)>(.*)</a>', 1), '<[^>]*>', '', 'g')), '(sale notice|auction notice|possession notice|e-?auction notice|tender document|terms and conditions|bid form|ation)') THEN 'named' END AS kind
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="[^"]+"[^>]*>.*?</a>')) AS a FROM (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN '<a class="d" href="/files/' || page_id || '.pdf?x=1">Get</a><a href="/n/' || page_id || '">Sale <b>notice</b></a>' ELSE '' END AS html FROM pages))) WHERE kind IS NOT NULL""")  # fmt: skip
def sk07(v: Views):
    more = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a class="d" href="/files/'), F.col("page_id").cast("string"), F.lit('.pdf?x=1">Get</a><a href="/n/'), F.col("page_id").cast("string"), F.lit('">Sale <b>notice</b></a>'))).otherwise("")
    links = X.notice_links(F.concat("html", more), also="ation")
    return v.pages.select("page_id", F.explode(links).alias("l")).select("page_id", "l.*").distinct()


