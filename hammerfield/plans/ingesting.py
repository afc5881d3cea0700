"""Queries: sources, sinks, import stages, page and notice extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..operators import pages as PG
from ..operators import rollups as R
from ..operators.staging import shared_dir
from ..sources import payloads as P
from ..sources import readers as S
from ..sources.paged import PagedJson
from .proxies import Views
from .registry import ORACLE_SQL, query


def rows_():
    return F.count(F.lit(1))


_EXPORT_KINDS = "customer % 6"


@query("src04_export", f"""SELECT customer, CASE WHEN {_EXPORT_KINDS} = 4 THEN NULL WHEN {_EXPORT_KINDS} = 3 THEN 0 ELSE count(*) END::INT AS n, CASE {_EXPORT_KINDS} WHEN 1 THEN count(*) + 1 WHEN 2 THEN count(*) WHEN 3 THEN 0 END::BIGINT AS total FROM listing GROUP BY customer""")
def src04(v: Views):
    """A JSON export of each customer: an array, a list under one of the usual names, an empty one, text that is none."""
    kind = F.col("customer") % 6
    rows = v.listing.groupBy("customer").agg(F.to_json(F.collect_list(F.struct("id", "title"))).alias("list"), rows_().alias("rows"))
    body = (
        F.when(kind == 0, F.concat(F.lit(" "), F.col("list"))).when(kind == 1, F.concat(F.lit('{"total":'), (F.col("rows") + 1).cast("string"), F.lit(',"items":'), F.col("list"), F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"records":'), F.col("list"), F.lit(',"count":'), F.col("rows").cast("string"), F.lit("}"))).when(kind == 3, '{"count":0,"records":[]}').when(kind == 4, "no json")
        .otherwise(F.concat(F.lit('{"data":'), F.col("list"), F.lit("}")))
    )
    found = S.export_records(F.col("body"))
    return rows.select("customer", body.alias("body")).select("customer", F.when(found.isNotNull(), F.size(found)).alias("n"), S.export_total(F.col("body")).alias("total"))


def label_pages(v: Views):
    """id and html: a table of labels and values of each listing row, with tags in its cells, a second row of one label, and document links."""
    cell = lambda label, value: F.concat(F.lit(f"<tr class='r'><th>{label}:</th>\n<td> <b>"), value, F.lit("</b> </td></tr>"))
    rows = F.concat_ws("", cell("Bank", F.col("bank_text")), cell("Reserve  Price", F.col("price_text")), cell("Bank", F.lit("Other")), F.lit("<tr><td>one cell</td></tr>"))
    links = F.concat(F.lit('<a href="/doc/'), F.col("id").cast("string"), F.lit('.pdf">Sale notice</a><a href="/about">About</a>'))
    return v.listing.select("id", F.concat(F.lit("<table>"), rows, F.lit("</table>"), F.when(F.col("id") % 3 > 0, links).otherwise("")).alias("html"))


@query("src08_label_table", r"""SELECT id, CASE WHEN bank_text IS NULL OR trim(bank_text) = '' THEN 'Other' ELSE trim(regexp_replace(bank_text, '\s+', ' ', 'g')) END AS bank, trim(regexp_replace(price_text, '\s+', ' ', 'g')) AS price, CASE WHEN id % 3 > 0 THEN '/doc/' || id || '.pdf' END AS document FROM listing""")
def src08(v: Views):
    m = S.page_pairs(F.col("html"))
    rows = label_pages(v).select("id", m.alias("m"), F.get(S.notice_links(F.col("html")), F.lit(0))["href"].alias("document"))
    return rows.select("id", F.try_element_at("m", F.lit("bank")).alias("bank"), F.try_element_at("m", F.lit("reserve price")).alias("price"), "document")


@query("src10_list_page", """SELECT customer, count(*)::INT AS cards, count(*) * 10 AS total, CASE WHEN customer % 4 > 0 THEN '/list?page=' || (customer % 9 + 2) END AS next, CASE WHEN customer % 5 > 0 THEN (customer % 30)::INT END AS last FROM listing WHERE city_text IS NOT NULL AND trim(city_text) <> '' GROUP BY customer""")
def src10(v: Views):
    """A list page of each customer's rows: cards, a headline total, the next address and the last page's number."""
    i, c = F.col("id").cast("string"), F.col("customer")
    cards = F.concat(F.lit('<div class="card"><a href="/l/'), i, F.lit('">Listing '), i, F.lit('</a><span class="city">'), "city_text", F.lit('</span><span class="price">'), F.col("price").cast("string"), F.lit("</span></div>"))
    pages = v.listing.filter("city_text IS NOT NULL AND trim(city_text) <> ''").groupBy("customer").agg(F.array_join(F.collect_list(cards), "\n").alias("cards"), rows_().alias("n"))
    following = F.when(c % 4 > 0, F.concat(F.lit('<a class="n" rel="next" href="/list?page='), (c % 9 + 2).cast("string"), F.lit('">Next</a>'))).otherwise("")
    last = F.when(c % 5 > 0, F.concat(F.lit('<a href="/list?page='), (c % 30).cast("string"), F.lit('">Last</a>'))).otherwise("")
    html = F.concat(F.lit("<h1>"), F.format_number(F.col("n") * 10, 0), F.lit(" properties found</h1>"), "cards", following, last)
    found = S.card_list(F.col("html"))
    rows = pages.select("customer", html.alias("html")).select("customer", found.alias("f"), S.last_page(F.col("html")).alias("last"))
    return rows.select("customer", F.size("f.cards").alias("cards"), "f.total", "f.next", "last")


_HEADING = r"(?s)<h1[^>]*>(.*?)</h1>"
_EMBEDDED = """WITH RECURSIVE p AS (SELECT page_id, '{"auctionData":{"data":[{"_index":"listing","_source":{"id":' || page_id || ',"url":' || to_json(url) || ',"heading":' || to_json(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')) || '}},{"_index":"other","_source":{"id":-1}},{"_index":"listing"}],"total":1}}' AS leaf FROM pages WHERE page_id % 7 <> 0),
n AS (SELECT page_id, 0 AS d, leaf AS j FROM p UNION ALL SELECT page_id, d + 1, CASE WHEN d % 2 = 0 THEN '["$","L1",null,' || j || ']' ELSE '{"children":' || j || ',"auctionData":{"data":"none"}}' END FROM n WHERE d < page_id % 6),
t AS (SELECT page_id, t.value AS v FROM n, json_tree(n.j::JSON) t WHERE d = page_id % 6 AND t.key = 'auctionData'),
i AS (SELECT page_id, unnest(json_extract(v, '$.data[*]')) AS item FROM t)
SELECT page_id, json_extract_string(item, '$._source.id') AS id, json_extract_string(item, '$._source.url') AS url, json_extract_string(item, '$._source.heading') AS heading FROM i WHERE json_extract_string(item, '$._index') = 'listing' AND json_extract(item, '$._source') IS NOT NULL"""


def embedding_pages(v: Views):
    """The pages, six of seven with a script that pushes a record of the page, nested up to five deep, in one to three chunks."""
    source = F.struct(F.col("page_id").alias("id"), "url", F.regexp_extract("html", _HEADING, 1).alias("heading"))
    j = F.concat(F.lit('{"auctionData":{"data":[{"_index":"listing","_source":'), F.to_json(source), F.lit('},{"_index":"other","_source":{"id":-1}},{"_index":"listing"}],"total":1}}'))
    for d in range(5):
        wrapped = F.concat(F.lit('["$","L1",null,'), j, F.lit("]")) if d % 2 == 0 else F.concat(F.lit('{"children":'), j, F.lit(',"auctionData":{"data":"none"}}'))
        j = F.when(F.col("page_id") % 6 > d, wrapped).otherwise(j)
    row = F.concat(F.lower(F.hex("page_id")), F.lit(":"), j)
    cut = F.ceil(F.length("row") / (F.col("page_id") % 3 + 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int")), lambda k: F.substring("row", k * F.col("cut") + 1, F.col("cut")))
    script = lambda text: F.concat(F.lit("<script>self.__next_f.push([1,"), F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1), F.lit("])</script>"))
    scripts = F.concat(script(F.lit('0:I["no json"]\n')), F.array_join(F.transform(parts, script), ""), script(F.lit('f:["$",{"rest":"auctionData"}]')))
    rows = v.pages.withColumn("row", row).withColumn("cut", cut)
    return rows.select("page_id", F.when(F.col("page_id") % 7 == 0, F.col("html")).otherwise(F.concat("html", scripts)).alias("html"))


@query("src12_embedded_json", _EMBEDDED)
def src12(v: Views):
    return P.embedded_records(embedding_pages(v), "auctionData", "listing", {"id": "$.id", "url": "$.url", "heading": "$.heading"})


@query("src13_record_dedupe", "SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def src13(v: Views):
    return v.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"), rows_().alias("copies"))


@query("src16_sitemap", "SELECT DISTINCT url || CASE WHEN page_id % 3 > 0 THEN '/auction/' || page_id ELSE '' END AS u FROM pages WHERE page_id % 3 > 0")
def src16(v: Views):
    """A sitemap of each language's pages, some of them auctions, with blanks about some addresses."""
    entry = F.concat(F.lit("<url><loc>"), F.when(F.col("page_id") % 2 == 0, " ").otherwise(""), "url", F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("/auction/"), F.col("page_id").cast("string"))).otherwise(""), F.lit("\n</loc></url>"))
    maps = v.pages.groupBy(F.floor(F.col("page_id") / 50)).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    return maps.select(F.explode(S.sitemap_urls(F.col("xml"))).alias("u")).distinct()


@query("src19_collect_pages", "SELECT count(*) AS pages, count(DISTINCT html) AS distinct_pages FROM pages")
def src19(v: Views):
    return v.pages.agg(rows_().alias("pages"), F.countDistinct("html").alias("distinct_pages"))


@query("sc29_text_chunks")
def sc29(v: Views):
    return S.text_chunks(v.documents.select(F.col("doc_id").alias("doc"), "text"), 2000)


@query("snk01_upsert", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS s FROM orders")
def snk01(v: Views):
    stored = v.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    incoming = v.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("s"), F.lit(1).alias("seq"))
    return I.upsert(stored, incoming.unionByName(incoming.withColumn("s", F.lit("old")).withColumn("seq", F.lit(0))), ["k"])


@query("snk02_insert_absent", "SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def snk02(v: Views):
    return I.insert_absent(v.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k")), v.lineitem.select(F.col("l_suppkey").alias("k")), ["k"])


@query("snk03_bulk_update", "SELECT id, CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'FEATURED' ELSE status END AS status FROM property")
def snk03(v: Views):
    ids = v.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id")).distinct().withColumn("hit", F.lit(True))
    return v.property.select("id", "status").join(ids, "id", "left").select("id", F.when(F.col("hit"), "FEATURED").otherwise(F.col("status")).alias("status"))


@query("snk05_csv_rows", """SELECT CASE WHEN p_partkey % 2 = 0 THEN '"' || p_name || ',x",' ELSE p_name || ',' END || p_partkey AS line FROM part""")
def snk05(v: Views):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(",x"))).otherwise(F.col("p_name"))
    return v.part.select(F.to_csv(F.struct(name.alias("a"), F.col("p_partkey").cast("string").alias("b"))).alias("line"))


@query("er08_import_outcomes", """WITH s AS (SELECT o_custkey AS key, min(o_orderkey) AS id, max(o_orderdate) AS start FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1),
a AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 1000 <> 1 THEN o_custkey END AS key, o_orderdate + interval 1 day * ((o_orderkey % 5) * 200) AS start, o_totalprice AS price FROM orders)
SELECT row, CASE WHEN a.key IS NULL THEN 'skip: no key' WHEN row_number() OVER (PARTITION BY a.key, a.start ORDER BY row) > 1 THEN 'repeated' WHEN s.id IS NULL THEN 'create' WHEN a.start > s.start + interval 36 hour THEN 'round' ELSE 'enrich' END AS outcome, s.id AS known
FROM a LEFT JOIN s ON s.key = a.key""")  # fmt: skip
def er08(v: Views):
    stored = v.orders.filter("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderkey").alias("id"), F.max("o_orderdate").alias("start"))
    key = F.when(F.col("o_orderkey") % 1000 != 1, F.col("o_custkey"))
    start = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 5 * 200).cast("int"))
    incoming = v.orders.select(F.col("o_orderkey").alias("row"), key.alias("key"), start.alias("start"), F.col("o_totalprice").alias("price"))
    return I.import_outcomes(incoming, stored)


@query("er08_import_counters", f"SELECT 'rows' AS counter, count(*) AS n FROM ({ORACLE_SQL['er08_import_outcomes']}) UNION ALL SELECT split_part(outcome, ':', 1), count(*) FROM ({ORACLE_SQL['er08_import_outcomes']}) GROUP BY 1")
def er08_counters(v: Views):
    """The counters of the import, taken while its outcomes are written."""
    counted = I.import_counted(er08(v), scratch(v, "outcomes"))
    return v.spark.createDataFrame([(k, n) for k, n in counted.items() if n], "counter string, n long")


@query("er08_match_chain", """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 > 0 THEN p_partkey // 3 END AS ext_id, CASE WHEN p_partkey % 7 > 0 THEN p_name || p_size END AS key, list_sort(list_distinct(string_split(p_name, ' '))) AS w FROM part), k AS (SELECT * FROM p WHERE p_partkey % 2 = 0), i AS (SELECT * FROM p WHERE p_partkey % 2 = 1),
a AS (SELECT i.p_partkey AS row, min(k.p_partkey) AS known FROM i JOIN k USING (ext_id) GROUP BY 1), b AS (SELECT i.p_partkey AS row, min(k.p_partkey) AS known FROM i JOIN k USING (key) GROUP BY 1),
c AS (SELECT i.p_partkey AS row, min(k.p_partkey) AS known FROM i JOIN k USING (p_brand) WHERE len(list_intersect(i.w, k.w)) >= 0.5 * (len(i.w) + len(k.w) - len(list_intersect(i.w, k.w))) GROUP BY 1)
SELECT i.p_partkey AS row, coalesce(a.known, b.known, c.known) AS known, CASE WHEN a.known IS NOT NULL THEN 'id' WHEN b.known IS NOT NULL THEN 'key' WHEN c.known IS NOT NULL THEN 'alike' END AS method FROM i LEFT JOIN a ON a.row = i.p_partkey LEFT JOIN b ON b.row = i.p_partkey LEFT JOIN c ON c.row = i.p_partkey""")  # fmt: skip
def er08_chain(v: Views):
    """Odd parts matched with even ones: by an external id, by a key, or alike within the brand."""
    i = F.col("p_partkey")
    rows = v.part.select(i.alias("id"), "p_brand", F.when(i % 5 > 0, F.floor(i / 3)).alias("ext_id"), F.when(i % 7 > 0, F.concat("p_name", F.col("p_size").cast("string"))).alias("key"), F.split("p_name", " ").alias("tokens"))
    return I.match_known(rows.filter("id % 2 = 1").withColumnRenamed("id", "row"), rows.filter("id % 2 = 0"), ["p_brand"], 0.5)


@query("er09_fill_only", "SELECT p.id, coalesce(nullif(geo_city, ''), 'CITY ' || p.id) AS geo_city, category AS category FROM property p WHERE category IS NOT NULL OR true")
def er09(v: Views):
    incoming = v.property.select("id", F.concat(F.lit("CITY "), F.col("id").cast("string")).alias("geo_city"), F.lit(None).cast("string").alias("category"))
    return I.fill_only(v.property, incoming, "id", ["geo_city", "category"])


_CHANGED = "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders"


@query("er10_change_rows", f"SELECT id, field, old, new FROM (SELECT o.o_orderkey AS id, unnest(['status', 'cust']) AS field, unnest([o.o_orderstatus, o.o_custkey::VARCHAR]) AS old, unnest([n.status, n.cust::VARCHAR]) AS new FROM orders o JOIN ({_CHANGED}) n ON n.id = o.o_orderkey) WHERE old IS DISTINCT FROM new")
def er10(v: Views):
    old = v.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))
    return I.change_rows(old, old.withColumn("cust", F.when(F.col("id") % 4 != 0, F.col("cust"))), "id", ["status", "cust"])


@query("er11_transitions", "SELECT id, status AS from_status, 'COMPLETED' AS to_status FROM auction WHERE status <> 'COMPLETED' AND id % 2 = 0")
def er11(v: Views):
    to = F.when(F.col("id") % 2 == 0, "COMPLETED").otherwise(F.col("status"))
    return v.auction.select("id", F.col("status").alias("from_status"), to.alias("to_status")).filter(~F.col("from_status").eqNullSafe(F.col("to_status")))


@query("er13_hash_skip", "SELECT a.page_id, CASE WHEN a.page_id % 3 = 0 THEN 'changed' ELSE 'same' END AS outcome FROM pages a")
def er13(v: Views):
    stored = v.pages.select("page_id", F.sha2(F.when(F.col("page_id") % 3 == 0, F.lit("old")).otherwise(F.col("html")), 256).alias("stored"))
    seen = v.pages.select("page_id", F.sha2("html", 256).alias("hash"))
    return seen.join(stored, "page_id", "left").select("page_id", F.when(F.col("hash") == F.col("stored"), "same").otherwise("changed").alias("outcome"))


@query("sj06_observation", "SELECT id, geo_state AS value FROM property WHERE geo_state IS NOT NULL")
def sj06(v: Views):
    encoded = v.property.filter("geo_state IS NOT NULL").select("id", F.to_json(F.struct(F.col("geo_state").alias("v"), F.lit("feed").alias("s"))).alias("j"))
    return encoded.select("id", F.from_json("j", "v string, s string").getField("v").alias("value"))


@query("sj09_attributes", "SELECT id, ['Category', 'State'] AS labels FROM property WHERE category IS NOT NULL")
def sj09(v: Views):
    m = F.create_map(F.lit("category"), F.col("category"), F.lit("state"), F.col("geo_state"), F.lit("_hidden"), F.lit("x"))
    shown = F.transform_keys(F.map_filter(m, lambda k, x: ~k.startswith("_") & x.isNotNull()), lambda k, _: F.initcap(k))
    return v.property.filter("category IS NOT NULL").select("id", F.array_sort(F.map_keys(shown)).alias("labels"))


@query("tx10_page_stats", r"SELECT page_id, (length(html) - length(replace(html, '<a ', ''))) // 3 AS links, (length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs FROM pages")
def tx10(v: Views):
    return v.pages.select("page_id", F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("tx11_page_score", r"SELECT page_id, score::INT AS score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'likely' WHEN score >= 20 THEN 'low' ELSE 'none' END AS band FROM (SELECT page_id, 30 * CAST(contains(lower(html), '<h1>') AS INT) + 30 * CAST(contains(lower(html), 'the') AS INT) + 20 * CAST(contains(lower(html), '<article>') AS INT) AS score FROM pages)")
def tx11(v: Views):
    low = F.lower("html")
    score = sum((F.when(low.contains(word), points).otherwise(0) for word, points in (("<h1>", 30), ("the", 30), ("<article>", 20))), F.lit(0))
    rows = v.pages.select("page_id", score.alias("score"))
    return rows.withColumn("band", F.when(F.col("score") >= 80, "high").when(F.col("score") >= 50, "likely").when(F.col("score") >= 20, "low").otherwise("none"))


@query("tx14_links", """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href="([^"]+)"', 1)) AS link FROM pages""")
def tx14(v: Views):
    # every page has fewer links than the cap, so the rows do not depend on their order
    return v.pages.select("page_id", F.explode(S.page_links(F.col("html"))).alias("link"))


@query("tx14_link_counts", """SELECT page_id, least(40, len(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*href="([^"]+)"', 1))))::INT AS n FROM pages""")
def tx14b(v: Views):
    return v.pages.select("page_id", F.size(S.page_links(F.col("html"))).alias("n"))


@query("tx15_link_scores", "SELECT page_id, CASE WHEN regexp_matches(url, 'page=[0-9]+') THEN 'pagination' WHEN regexp_matches(url, '/[0-9]+(\\.html|/)?([?#]|$)') THEN 'detail' ELSE 'listing' END AS kind FROM pages")
def tx15(v: Views):
    url = F.col("url")
    return v.pages.select("page_id", F.when(url.rlike("page=[0-9]+"), "pagination").when(url.rlike(r"/[0-9]+(\.html|/)?([?#]|$)"), "detail").otherwise("listing").alias("kind"))


def _link_points(score: str) -> str:
    """The table of link signals as SQL: of the rules with one name the first that holds."""
    test = {"like": "regexp_matches({f}, '{v}')", "least": "{f} >= {v}", "most": "{f} <= {v}"}
    names: dict[str, str] = {}
    for name, worth, (field, how, value) in PG.LINK_SIGNALS[score]:
        names[name] = names.get(name, "CASE") + f" WHEN {test[how].format(f=field, v=value)} THEN {worth}"
    verdict = names.pop("VERDICT", "CASE") + (" END" if "VERDICT" in {r[0] for r in PG.LINK_SIGNALS[score]} else " WHEN false THEN 0 END")
    return f"coalesce({verdict}, {' + '.join(f'{c} ELSE 0 END' for c in names.values())})"


_ANCHOR = r'<a\b[^>]*href="([^"]+)"[^>]*>([^<]*)</a>'


@query("tx15_link_points", f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '{_ANCHOR}')) AS a FROM pages), l AS (SELECT DISTINCT page_id, regexp_extract(a, '{_ANCHOR}', 1) AS href, regexp_extract(a, '{_ANCHOR}', 2) AS words FROM a
  UNION SELECT page_id, url, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) FROM pages),
p AS (SELECT *, href AS url, words AS text, trim(words) AS label, length(words) AS text_chars, lower(regexp_extract(href, '^(?:[a-z]+://[^/?#]+)?([^?#]*)', 1)) AS path FROM l), q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
r AS (SELECT *, coalesce(parts[-1], '') AS last, len(parts) AS depth FROM q), s AS (SELECT *, len(string_split(last, '-')) AS last_words FROM r)
SELECT page_id, href, words, ({_link_points("detail")})::INT AS detail, ({_link_points("listing")})::INT AS listing, ({_link_points("pagination")}) > 0 AS pagination FROM s""")  # fmt: skip
def tx15_points(v: Views):
    """The scores of every link of every page, and of the page's own address with its heading."""
    anchors = v.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))).alias("a"))
    links = anchors.select("page_id", F.regexp_extract("a", _ANCHOR, 1).alias("href"), F.regexp_extract("a", _ANCHOR, 2).alias("words"))
    links = links.unionByName(v.pages.select("page_id", F.col("url").alias("href"), F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1).alias("words"))).distinct()
    return links.select("page_id", "href", "words", PG.link_scores(F.col("href"), F.col("words")).alias("s")).select("page_id", "href", "words", "s.*")


@query("tx16_shapes", "SELECT shape, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[0-9]+', '#', 'g') AS shape FROM pages) GROUP BY shape HAVING count(*) >= 3 ORDER BY n DESC, shape LIMIT 4")
def tx16(v: Views):
    shape = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[0-9]+", "#")
    return R.grouped_count(v.pages.select(shape.alias("shape")), "shape").filter("n >= 3").orderBy(F.desc("n"), "shape").limit(4)


_SHAPE = r"regexp_replace(regexp_replace({u}, '^[a-z]+://[^/]+', ''), '[0-9]+', '#'{g})"


@query("tx16_shape_verdicts", f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/]*?([a-z]+[.][a-z]+)(/|$)', 1) AS site, {_SHAPE.format(u="url", g=", 'g'")} AS shape, url, html FROM pages), s AS (SELECT site, shape, count(DISTINCT url) AS urls FROM p GROUP BY ALL HAVING count(DISTINCT url) >= 3),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY site ORDER BY urls DESC, shape) <= 4)
SELECT t.site, t.shape, t.urls, bool_and(regexp_matches(html, '<h1>[^<]')) AS verified FROM t JOIN p USING (site, shape) GROUP BY ALL""")  # fmt: skip
def tx16_verdicts(v: Views):
    """The largest shapes of each host's addresses; here a page is one of a listing where its heading has a text, which all have."""
    host = F.regexp_extract("url", r"^[a-z]+://[^/]*?([a-z]+[.][a-z]+)(/|$)", 1)
    pages = v.pages.select(host.alias("site"), "url", "html")
    return PG.shape_verdicts(pages, ["site"], F.expr(_SHAPE.format(u="url", g="")), [r"\S"]).drop("sample")


@query("tx17_value_in_source", "SELECT page_id, contains(regexp_replace(lower(html), '[^a-z0-9]', '', 'g'), regexp_replace(lower(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '[^a-z0-9]', '', 'g')) AS found FROM pages")
def tx17(v: Views):
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return v.pages.select("page_id", F.contains(bare(F.col("html")), bare(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1))).alias("found"))


@query("tx18_best_candidate", "SELECT lang, arg_max(doc_id, (tier, n_chars, doc_id)) AS best FROM (SELECT *, CASE WHEN n_chars % 100 >= 51 THEN 1 ELSE 0 END AS tier FROM documents WHERE n_chars % 100 >= 30) GROUP BY lang")
def tx18(v: Views):
    score = F.col("n_chars") % 100
    rows = v.documents.filter(score >= 30).withColumn("tier", F.when(score >= 51, 1).otherwise(0))
    return rows.groupBy("lang").agg(F.max_by("doc_id", F.struct("tier", "n_chars", "doc_id")).alias("best"))


def scratch(v: Views, name: str) -> str:
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


@query("src02_csv_cells", """SELECT s_suppkey::VARCHAR AS id, s_name || ', "' || s_suppkey || '"' || chr(10) || 'end' AS name FROM supplier""")
def src02(v: Views):
    """Written as CSV with quotes, commas and line breaks in its cells and a blank row, and read back."""
    name = F.concat("s_name", F.lit(', "'), F.col("s_suppkey").cast("string"), F.lit('"\nend'))
    rows = v.supplier.select(F.col("s_suppkey").cast("string").alias(" ID "), name.alias("Name")).unionByName(v.spark.createDataFrame([(None, "  ")], "` ID ` string, Name string"))
    path = scratch(v, "csv")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return S.read_csv(v.spark, path)


@query("src03_import_table", "SELECT o_orderkey AS title, o_orderstatus AS status FROM orders ORDER BY o_orderkey LIMIT 500")
def src03(v: Views):
    return S.import_table(v.orders.select(F.col("o_orderkey").alias(" Title "), F.col("o_orderstatus").alias("STATUS")), "title")


_PER_PAGE = 10


@query("src06_paged_json", f"""SELECT CASE WHEN p = 3 THEN 'invalid' WHEN p = 4 THEN 'denied' WHEN p = 5 THEN 'temporary' ELSE 'ok' END AS outcome, CASE WHEN p NOT IN (3, 4, 5) THEN s_suppkey END AS k, CASE WHEN p NOT IN (3, 4, 5) THEN (p + 1)::VARCHAR END AS next
FROM (SELECT *, CAST(floor(s_suppkey / {_PER_PAGE}) AS BIGINT) AS p FROM supplier) WHERE p NOT IN (3, 4, 5) OR s_suppkey % {_PER_PAGE} = 0""")  # fmt: skip
def src06(v: Views):
    """Pages of suppliers as files, some of them broken, refused or not ready."""
    page = F.floor(F.col("s_suppkey") / _PER_PAGE)
    bad = F.when(F.col("p") == 3, "<html>").when(F.col("p") == 4, '{"error":"no","code":403}').when(F.col("p") == 5, '{"error":"wait"}')
    pages = v.supplier.withColumn("p", page).groupBy("p").agg(F.collect_list(F.struct("s_suppkey", "s_name")).alias("items"))
    pages = pages.select(F.coalesce(bad, F.to_json(F.struct("items", (F.col("p") + 1).alias("next")))).alias("body"))
    path = scratch(v, "pages")
    pages.write.option("maxRecordsPerFile", 1).text(path)  # one file a page
    v.spark.dataSource.register(PagedJson)
    found = v.spark.read.format("paged_json").option("path", path).load()
    return found.select("outcome", F.get_json_object("record", "$.s_suppkey").cast("long").alias("k"), "next")


_ROBOTS = "User-agent: *\nDisallow: /es\nAllow: /es/1\nDisallow: /*7$\n\nUser-agent: other\nUser-agent: bad\nDisallow: /"


@query("fl25_robots", r"""SELECT DISTINCT p AS url_path, CASE WHEN starts_with(p, '/es/1') THEN true WHEN ends_with(p, '7') THEN false WHEN starts_with(p, '/es') THEN false ELSE true END AS allowed FROM (SELECT regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^$', '/') AS p FROM pages)""")
def fl25(v: Views):
    path = F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    return S.robots_decision(v.pages.select(path.alias("url_path")).distinct(), _ROBOTS, "bot")
