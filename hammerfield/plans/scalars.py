"""Queries: scalar functions over table columns and small stated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import kinds as K
from ..functions import money as M
from ..functions import text as T
from ..operators import lifecycle as L
from .proxies import NOW, Views
from .registry import query


def worded(v: Views, items: list) -> DataFrame:
    """id and c: for each listing row one of the wordings, by its key, with the key for each {id} in it."""
    picked = F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("id") % len(items) + 1).cast("int"))
    return v.listing.select("id", "start", F.replace(picked, F.lit("{id}"), F.col("id").cast("string")).alias("c"))


def sql_worded(items: list) -> str:
    """The same in the oracle's SQL, as a table."""
    texts = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in items)
    return f"(SELECT id, start, replace([{texts}][(id % {len(items)})::INT + 1], '{{id}}', id::VARCHAR) AS c FROM listing) AS t"


@query("sc01_slugify", "SELECT s_suppkey, substr(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100) AS slug FROM supplier")
def sc01(v: Views):
    return v.supplier.select("s_suppkey", T.slugify(F.col("s_name")).alias("slug"))


@query("sc02_city_slug", "SELECT n_nationkey, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM nation")
def sc02(v: Views):
    return v.nation.select("n_nationkey", T.city_slug(F.col("n_name")).alias("slug"))


_TITLE = "(SELECT string_agg(upper(w[1]) || w[2:], '' ORDER BY n) FROM (SELECT unnest(regexp_extract_all({0}, '[^ -]*[ -]?')) AS w, generate_subscripts(regexp_extract_all({0}, '[^ -]*[ -]?'), 1) AS n))"


@query("sc03_title_case", f"SELECT id, {_TITLE.format('lower(trim(city_text))')} AS t FROM listing")
def sc03(v: Views):
    return v.listing.select("id", T.title_case(F.col("city_text")).alias("t"))


_PLACEHOLDERS = ["", "--", "N/A", "na", " Not Available ", "ok {id}", None, "-{id}", "not applicable", "–", "—", "n/a {id}"]


@query("sc14_placeholder", f"SELECT id, CASE WHEN regexp_full_match(lower(trim(c)), '-*|–|—|n/?a|not available|not applicable') THEN NULL ELSE c END AS c FROM {sql_worded(_PLACEHOLDERS)}")
def sc14(v: Views):
    return worded(v, _PLACEHOLDERS).select("id", T.null_if_placeholder(F.col("c")).alias("c"))


@query("sc13_tidy_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM documents")
def sc13(v: Views):
    return v.documents.select("doc_id", T.tidy_text(F.col("text")).alias("t"))


_CONTACTS = ["A.B{id}@Example.com ", "no mail", "x@y", "+91 98765 43210", "098765-43210", "{id}", None, "9{id}", "a b@c.de", "919876543210", "0091 98765 43210"]


@query("sc16_contacts", r"SELECT id, CASE WHEN regexp_matches(lower(trim(c)), '^[^@\s]+@[^@\s]+\.[a-z]{2,}$') THEN lower(trim(c)) END AS email, CASE WHEN length(d) = 10 THEN d END AS phone FROM (SELECT *, regexp_replace(regexp_replace(c, '[^0-9]', '', 'g'), '^(0|91)([0-9]{10})$', '\2') AS d FROM " + sql_worded(_CONTACTS) + ")")
def sc16(v: Views):
    return worded(v, _CONTACTS).select("id", T.email_or_null(F.col("c")).alias("email"), T.phone_digits(F.col("c")).alias("phone"))


_SECRETS = ["Authorization: Bearer abc{id}.def x", "token=12345{id}&x=1", "Cookie: sid={id}; b", "plain {id}", "two token={id} and bearer  {id}", None]


@query("sc18_redact", r"SELECT id, substr(regexp_replace(c || repeat(' and so on', (id % 300)::INT), '(?i)\b(bearer\s+|token=|cookie:\s*)[^\s;&]+', '\1***', 'g'), 1, 1500) AS t FROM " + sql_worded(_SECRETS))
def sc18(v: Views):
    """Excerpts of up to 3,000 characters, cut at 1,500 after masking."""
    text = F.concat("c", F.repeat(F.lit(" and so on"), (F.col("id") % 300).cast("int")))
    return worded(v, _SECRETS).select("id", T.redact(text).alias("t"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '')"


@query("sc19_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def sc19(v: Views):
    return v.pages.select("page_id", T.host(F.col("url")).alias("host"))


@query("sc20_source_key", f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'feed.example.org' ELSE {_HOST} END AS source FROM pages")
def sc20(v: Views):
    own = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("src:feed.example.org:"), F.col("page_id").cast("string")))
    return v.pages.select("page_id", T.source_key(own, F.col("url")).alias("source"))


@query("sc21_source_label", "SELECT page_id, regexp_replace('feed: ' || page_id, '^feed:\\s*', '') AS label FROM pages")
def sc21(v: Views):
    return v.pages.select("page_id", F.regexp_replace(F.concat(F.lit("feed: "), F.col("page_id").cast("string")), r"^feed:\s*", "").alias("label"))


@query("sc22_normalize_url", r"""SELECT page_id, 'https://' || lower(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1)) || regexp_replace(regexp_extract(u, '^[a-z]+://[^/?#]+([^?]*)', 1), '/+$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS url
FROM (SELECT page_id, u, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid)=')) AS q FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))""")  # fmt: skip
def sc22(v: Views):
    return v.pages.select("page_id", T.normalize_url(F.col("url")).alias("url"))


_PATH = "list_filter(string_split(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+(.*)$', 1), '/'), lambda p: p <> '')"


@query("sc23_url_shape", f"""SELECT page_id, coalesce(p[1], '') || '|' || len(p) || '|' || CASE WHEN len(p) = 0 THEN 'root' WHEN regexp_matches(p[-1], '^[0-9]+$') THEN 'num' WHEN regexp_matches(p[-1], '[0-9]{{4,}}$') THEN 'slugid' WHEN contains(p[-1], '-') THEN 'slug' ELSE 'word' END AS shape FROM (SELECT page_id, {_PATH} AS p FROM pages)""")
def sc23(v: Views):
    return v.pages.select("page_id", T.url_shape(F.col("url")).alias("shape"))


@query("sc24_url_id", "SELECT page_id, coalesce(try_cast(nullif(regexp_extract(url, '([0-9]{4,})/?$', 1), '') AS BIGINT), 0) AS id FROM pages")
def sc24(v: Views):
    return v.pages.select("page_id", T.url_id(F.col("url")).alias("id"))


@query("sc25_place_label", "SELECT id, CASE WHEN geo_city IS NOT NULL AND id % 2 = 0 THEN 'Area, ' || geo_city ELSE coalesce(geo_city, address_text) END AS label FROM property")
def sc25(v: Views):
    return v.property.select("id", T.place_label(F.when(F.col("id") % 2 == 0, "Area"), F.col("geo_city"), F.col("address_text")).alias("label"))


@query("sc26_inr", r"""SELECT o_orderkey, CASE WHEN length(t) <= 3 THEN '₹' || t WHEN length(t) <= 5 THEN '₹' || t[:-4] || ',' || t[-3:] WHEN length(t) <= 7 THEN '₹' || t[:-6] || ',' || t[-5:-4] || ',' || t[-3:] ELSE '₹' || t[:-8] || ',' || t[-7:-6] || ',' || t[-5:-4] || ',' || t[-3:] END AS inr
FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS t FROM orders)""")  # fmt: skip
def sc26(v: Views):
    return v.orders.select("o_orderkey", T.indian_digits(F.floor("o_totalprice")).alias("inr"))


_STOP = ["the", "of", "and", "in"]


@query("sc27_tokens", f"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w)))) AS tokens FROM documents")
def sc27(v: Views):
    return v.documents.select("doc_id", F.array_sort(T.tokens(F.col("text"), _STOP, 2)).alias("tokens"))


@query("sc28_html_text", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|svg)\b.*?</(script|style|noscript|svg)>', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table)>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS t FROM pages""")  # fmt: skip
def sc28(v: Views):
    return v.pages.select("page_id", T.html_text(F.col("html")).alias("t"))


@query("sc30_page_title", r"SELECT page_id, substr(trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '<[^>]*>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')), 1, 200) AS title FROM pages")
def sc30(v: Views):
    return v.pages.select("page_id", T.page_title(F.col("html")).alias("title"))


_MESSAGES = ["timeout after {id} s", "HTTP 403 forbidden", "created {id} records", "robots.txt disallows /{id}", "", "Forbidden", "UPDATED {id}", "read {id} rows", None]


@query("sc31_message_kind", f"SELECT id, CASE WHEN contains(lower(c), 'timeout') THEN 'temporary' WHEN regexp_matches(lower(c), '403|forbidden') THEN 'blocked' WHEN contains(lower(c), 'robots') THEN 'robots' WHEN regexp_matches(lower(c), 'created|updated') THEN 'ok' ELSE 'other' END AS kind FROM {sql_worded(_MESSAGES)}")
def sc31(v: Views):
    m = F.lower("c")
    kind = F.when(m.contains("timeout"), "temporary").when(m.rlike("403|forbidden"), "blocked").when(m.contains("robots"), "robots").when(m.rlike("created|updated"), "ok").otherwise("other")
    return worded(v, _MESSAGES).select("id", kind.alias("kind"))


_MONEY = ["32,21,{id}", "₹ {id}", "--", "abc", "-12.5{id}", "0", None, "1e3", "12.5.6", "{id}.", ".{id}", " {id} 000", "+{id}"]


@query("sm01_parse_money", r"SELECT id, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(ltrim(t, '+') AS DOUBLE) END AS n FROM (SELECT id, regexp_replace(c, '[₹,\s]', '', 'g') AS t FROM " + sql_worded(_MONEY) + ")")
def sm01(v: Views):
    return worded(v, _MONEY).select("id", M.parse_money(F.col("c")).alias("n"))


@query("sm06_lost_unit", "SELECT o_orderkey, CASE WHEN o_orderkey % 700 < 1000 AND o_totalprice >= 100 * (o_orderkey % 700) THEN o_totalprice ELSE o_orderkey % 700 END::DOUBLE AS price FROM orders")
def sm06(v: Views):
    return v.orders.select("o_orderkey", M.lost_unit((F.col("o_orderkey") % 700).cast("double"), F.col("o_totalprice").cast("double")).alias("price"))


@query("sm07_percent", "SELECT o_orderkey, coalesce(format('{:,.1f}%', 12.5 * nullif(o_orderkey % 101, 100)), '—') AS p FROM orders")
def sm07(v: Views):
    """Shares in eighths, of which every tenth of a per cent is exact."""
    return v.orders.select("o_orderkey", M.percent(F.nullif(F.col("o_orderkey") % 101, F.lit(100)) / 8, 1).alias("p"))


@query("sm08_drop_class", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 7 >= 0.6 THEN 'CRITICAL' WHEN l_discount * 7 >= 0.3 THEN 'INCOMPLETE' WHEN l_discount * 7 >= 0.1 THEN 'WARNING' ELSE 'HEALTHY' END AS class FROM lineitem")
def sm08(v: Views):
    return v.lineitem.select("l_orderkey", "l_linenumber", M.drop_class(F.col("l_discount") * 7).alias("class"))


@query("sm09_fnv1a", "SELECT s_suppkey, lower(to_base(list_reduce([2166136261] || list_transform(string_split(s_name, ''), lambda c: ord(c)::BIGINT), lambda h, x: (xor(h, x) * 16777619) % 4294967296), 36)) AS hash FROM supplier")
def sm09(v: Views):
    return v.supplier.select("s_suppkey", F.lower(F.conv(M.fnv1a(F.col("s_name")).cast("string"), 10, 36)).alias("hash"))


@query("sm10_haversine", "SELECT c_custkey, round(2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(28.6 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(28.6)) * pow(sin(radians(77.2 - lng) / 2), 2)))), 6) AS km FROM (SELECT c_custkey, 8 + c_custkey % 25 AS lat, 70 + c_custkey % 20 AS lng FROM customer)")
def sm10(v: Views):
    lat, lng = 8 + F.col("c_custkey") % 25, 70 + F.col("c_custkey") % 20
    return v.customer.select("c_custkey", F.round(M.haversine_km(lat, lng, F.lit(28.6), F.lit(77.2)), 6).alias("km"))


@query("fl21_geo_box", "SELECT c_custkey, lat BETWEEN 6 AND 37.6 AND lng BETWEEN 68 AND 97.5 AS ok FROM (SELECT c_custkey, (c_custkey % 60)::DOUBLE AS lat, (50 + c_custkey % 70)::DOUBLE AS lng FROM customer)")
def fl21(v: Views):
    lat, lng = (F.col("c_custkey") % 60).cast("double"), (50 + F.col("c_custkey") % 70).cast("double")
    return v.customer.select("c_custkey", M.valid_point(lat, lng).alias("ok"))


@query("fl22_split_mappable", "SELECT CASE WHEN c_custkey % 60 BETWEEN 6 AND 37.6 AND 50 + c_custkey % 70 BETWEEN 68 AND 97.5 THEN 'mapped' ELSE 'unmapped' END AS part, count(*) AS n FROM customer GROUP BY 1")
def fl22(v: Views):
    ok = M.valid_point((F.col("c_custkey") % 60).cast("double"), (50 + F.col("c_custkey") % 70).cast("double"))
    return v.customer.groupBy(F.when(ok, "mapped").otherwise("unmapped").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("sd01_ist_day", "SELECT event_id, date_trunc('day', ts + interval 330 minute) - interval 330 minute AS day_start, CAST(ts + interval 330 minute AS DATE) AS day FROM events")
def sd01(v: Views):
    return v.events.select("event_id", L.ist_day_start(F.col("ts")).alias("day_start"), L.ist_date(F.col("ts")).alias("day"))




def _clock(k: int) -> str:
    return f"regexp_extract(lower(time_text), '^([0-9]{{1,2}}):([0-9]{{2}})\\s*(am|pm)$', {k})"


@query("sd02_indian_date", f"SELECT id, CASE WHEN id % 13 > 0 AND regexp_full_match(lower(time_text), '[0-9]{{1,2}}:[0-9]{{2}}\\s*(am|pm)') THEN date_trunc('day', start) + to_minutes(60 * ({_clock(1)}::INT % 12 + CASE {_clock(3)} WHEN 'pm' THEN 12 ELSE 0 END) + {_clock(2)}::INT - 330) END AS t FROM listing")
def sd02(v: Views):
    """The day of each round and its clock time as one text; one in thirteen names a day that does not exist."""
    day = F.when(F.col("id") % 13 == 0, "31-02-2026").otherwise(F.date_format("start", "dd-MM-yyyy"))
    return v.listing.select("id", D.indian_date_time(F.concat_ws(" ", day, "time_text")).alias("t"))


@query("sd03_listing_date", "SELECT id, CASE id % 4 WHEN 0 THEN date_trunc('day', start) + to_minutes(330) WHEN 1 THEN date_trunc('day', start) + to_minutes(60 * (id % 24)) WHEN 2 THEN date_trunc('day', start) + to_minutes(60 * (id % 24) - 330) END AS t FROM listing")
def sd03(v: Views):
    """A bare date, one with Z, one without a zone, and no date."""
    i, day = F.col("id"), F.date_format("start", "yyyy-MM-dd")
    clock = F.concat(F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":00:00"))
    text = F.when(i % 4 == 0, day).when(i % 4 == 1, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(i % 4 == 2, F.concat(day, F.lit(" "), clock)).otherwise("soon")
    return v.listing.select("id", D.listing_date(text).alias("t"))


_SHEET = "CASE id % 5 WHEN 4 THEN NULL WHEN 2 THEN date_trunc('day', start) + CASE WHEN year(start) < 2000 THEN interval 100 year ELSE interval 0 year END ELSE date_trunc('day', start) END"


def sheet_text():
    """d/m/y, a month's name, a year of two digits (20xx), dots, and a day that does not exist."""
    i, f = F.col("id"), lambda p: F.date_format("start", p)
    return F.when(i % 5 == 0, f("d/M/yyyy")).when(i % 5 == 1, f("d MMM yyyy")).when(i % 5 == 2, f("d-M-yy")).when(i % 5 == 3, f("dd.MM.yyyy")).otherwise("32/1/2026")


@query("sd04_sheet_date", f"SELECT id, {_SHEET} + to_minutes(330) AS t FROM listing")
def sd04(v: Views):
    return v.listing.select("id", D.sheet_date(sheet_text()).alias("t"))


@query("sd06_date_range", "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1997 AND 1999 THEN o_orderdate END AS t FROM orders")
def sd06(v: Views):
    return v.orders.select("o_orderkey", D.in_range(F.col("o_orderdate"), 1997, 1999).alias("t"))


@query("sd07_noon_dates", f"SELECT id, {_SHEET} + to_minutes(390) AS t FROM listing")
def sd07(v: Views):
    return v.listing.select("id", D.sheet_date(sheet_text(), 12).alias("t"))


_DERIVED = f"CASE WHEN auction_start IS NULL THEN 'UPCOMING' WHEN timestamp '{NOW}' > coalesce(auction_end, auction_start) THEN 'COMPLETED' WHEN timestamp '{NOW}' >= auction_start THEN 'LIVE' WHEN CAST(auction_start AS DATE) = DATE '1998-06-15' THEN 'AUCTION_TODAY' ELSE 'UPCOMING' END"


@query("sd09_derive_status", f"SELECT id, {_DERIVED} AS derived FROM auction")
def sd09(v: Views):
    return v.auction.select("id", L.derive_from_dates(F.col("auction_start"), F.col("auction_end"), F.lit(NOW).cast("timestamp_ntz")).alias("derived"))


@query("sd10_resolve_status", f"SELECT id, CASE WHEN id % 11 = 0 THEN 'CANCELLED' WHEN status = 'POSTPONED' AND NOT (id % 2 = 0) THEN status ELSE {_DERIVED} END AS resolved FROM auction")
def sd10(v: Views):
    derived = L.derive_from_dates(F.col("auction_start"), F.col("auction_end"), F.lit(NOW).cast("timestamp_ntz"))
    return v.auction.select("id", L.resolve_status(F.when(F.col("id") % 11 == 0, "CANCELLED"), F.col("status"), F.col("id") % 2 == 0, derived).alias("resolved"))


@query("sd12_slot", "SELECT event_id, time_bucket(interval 15 minute, ts) AS slot, time_bucket(interval 15 minute, ts) + interval 15 minute AS next FROM events")
def sd12(v: Views):
    w = v.events.select("event_id", D.slot(F.col("ts")).alias("w"))
    return w.select("event_id", F.col("w.start").cast("timestamp_ntz").alias("slot"), F.col("w.end").cast("timestamp_ntz").alias("next"))


@query("sd13_retry_after", "SELECT id, CASE WHEN id % 11 > 0 THEN greatest(0, id % 300 - 50)::INT END AS n FROM listing")
def sd13(v: Views):
    text = F.when(F.col("id") % 11 == 0, "later").otherwise(F.concat(F.lit(" "), (F.col("id") % 300 - 50).cast("string")))
    rows = v.listing.select("id", text.alias("c"))
    return rows.select("id", F.when(F.trim("c").try_cast("int").isNotNull(), D.retry_after(F.col("c"))).alias("n"))


_EXTENSIONS = ["end time will increase by {id} minutes.", "Yes", "no", "INCREASE BY  {id} minute", "increase", " YES ", None]


@query("sd14_extension", f"SELECT id, CASE WHEN id % 7 IN (0, 3) THEN id::INT END AS n, CASE WHEN id % 7 IN (1, 5) THEN true WHEN id % 7 = 2 THEN false END AS y FROM {sql_worded(_EXTENSIONS)}")
def sd14(v: Views):
    return worded(v, _EXTENSIONS).select("id", D.extension_minutes(F.col("c")).alias("n"), D.yes_no(F.col("c")).alias("y"))


@query("sd15_label", "SELECT event_id, strftime(ts + interval 330 minute, '%-d %b %Y, %H:%M') AS label FROM events")
def sd15(v: Views):
    return v.events.select("event_id", D.ist_label(F.col("ts")).alias("label"))


@query("fl17_blocked_host", f"SELECT page_id, ({_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net')) AS blocked FROM pages")
def fl17(v: Views):
    return v.pages.select("page_id", T.blocked_host(F.col("url"), ["example.net"]).alias("blocked"))


_PRIVATE = "a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224"


@query("fl27_private_address", f"SELECT id, a > 255 OR b > 255 OR c > 255 OR id % 19 = 0 OR {_PRIVATE} AS p FROM (SELECT id, [10, 172, 192, 169, 100, 8, 127, 0, 224, 223, 256, id % 256][(id % 12)::INT + 1] AS a, [16, 31, 168, 254, 64, 127, 15, 32, id % 260][(id % 9)::INT + 1] AS b, id % 258 AS c FROM listing)")
def fl27(v: Views):
    """Addresses at the borders of each range; some have a number too many, some are no addresses."""
    pick = lambda *xs: F.element_at(F.array(*[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in xs]), (F.col("id") % len(xs) + 1).cast("int"))
    ip = F.concat_ws(".", pick(10, 172, 192, 169, 100, 8, 127, 0, 224, 223, 256, F.col("id") % 256), pick(16, 31, 168, 254, 64, 127, 15, 32, F.col("id") % 260), (F.col("id") % 258).cast("string"), F.lit("1"))
    return v.listing.select("id", K.private_address(F.when(F.col("id") % 19 == 0, "not an ip").otherwise(ip)).alias("p"))