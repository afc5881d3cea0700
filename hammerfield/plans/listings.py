"""Queries: cleaning, classification and gates of listing records, over the wordings of the view `listing`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import kinds as K
from ..functions import money as M
from ..functions import names as N
from ..functions import text as T
from ..operators import gates as G
from ..operators import phrases as PH
from ..operators import rollups as R
from .proxies import Views
from .registry import query


def sql_kinds(text: str, table: list, otherwise: str = "NULL") -> str:
    """CASE over a table of patterns; RE2 has no look-ahead, so what it would pass over is taken out of the text first."""

    def hit(p: str) -> str:
        found = []
        for words, ahead in ((r"farm\s*house", r"(?!\s*house)"), (r"land\s*(and|&)\s*building", r"(?!\s*(and|&)\s*building)")):
            if ahead in p:
                parts = p.replace(ahead, "@").split("|")
                found += [f"regexp_matches(regexp_replace({text}, '{words}', '', 'g'), '{x[:-1]}')" for x in parts if x.endswith("@")]
                p = "|".join(x for x in parts if not x.endswith("@"))
        return "(" + " OR ".join([*found, f"regexp_matches({text}, '{p}')"]) + ")"

    rows = [f"WHEN {hit(p)}{f' AND NOT {hit(u)}' if u else ''} THEN '{k}'" for k, p, u in table]
    return f"CASE {' '.join(rows)} ELSE {otherwise} END"


@query("sk01_property_kind", f"SELECT id, {sql_kinds('lower(kind_text)', K.PROPERTY_KINDS)} AS kind FROM listing")
def sk01(v: Views):
    return v.listing.select("id", K.property_kind(F.col("kind_text")).alias("kind"))


@query("sk02_feed_kind", f"SELECT id, {sql_kinds('lower(kind_text)', K.FEED_KINDS)} AS kind FROM listing")
def sk02(v: Views):
    return v.listing.select("id", K.feed_kind(F.col("kind_text")).alias("kind"))


_BOTH = "lower(coalesce(kind_text, '') || ' ' || coalesce(title, ''))"
_SITE = "CASE id % 5 WHEN 0 THEN 'Residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'other' WHEN 3 THEN 'INDUSTRIAL' END"


@query("sk03_sheet_kind", f"""SELECT id, {sql_kinds(_BOTH, K.SHEET_KINDS, "''")} AS kind, {sql_kinds(_BOTH, K.SUBTYPE_KINDS, "''")} AS feed_kind FROM listing""")
def sk03(v: Views):
    kind, title = F.col("kind_text"), F.col("title")
    return v.listing.select("id", K.sheet_kind(kind, title).alias("kind"), K.subtype_kind(kind, title).alias("feed_kind"))


@query("sk04_site_kind", f"""SELECT id, CASE WHEN regexp_matches(t, '\\b(land|plot)\\b') AND NOT contains(t, 'building') THEN 'LAND_PLOT'
  WHEN regexp_matches(t, '\\b(house|flat|apartment|villa|bungalow)\\b') THEN 'RESIDENTIAL' WHEN f = 'EXCLUDED' THEN f
  WHEN lower(s) IN ('residential', 'commercial', 'industrial', 'agricultural') THEN upper(s) ELSE coalesce(f, '') END AS kind
FROM (SELECT id, lower(coalesce(kind_text, '')) AS t, {_SITE} AS s, {sql_kinds("lower(kind_text)", K.FEED_KINDS)} AS f FROM listing)""")  # fmt: skip
def sk04(v: Views):
    site = F.expr(_SITE)
    return v.listing.select("id", K.site_kind(F.col("kind_text"), site).alias("kind"))


_LINK = "lower(coalesce(document_text || ' ', '') || '/files/' || id || '.pdf')"
_RE2 = [(k, p.replace("(?s)", ""), u) for k, p, u in K.LINK_DOCUMENTS]


@query("sk05_document_kind", f"""SELECT id, {sql_kinds("lower(coalesce(document_text, ''))", K.LABEL_DOCUMENTS, "'OTHER'")} AS label, {sql_kinds(_LINK, _RE2, "'OTHER'")} AS link, {sql_kinds(_LINK, K.SHOWN_DOCUMENTS, "'Attachment'")} AS shown FROM listing""")
def sk05(v: Views):
    label, url = F.col("document_text"), F.concat(F.lit("/files/"), F.col("id").cast("string"), F.lit(".pdf"))
    return v.listing.select("id", K.label_document(label).alias("label"), K.link_document(label, url).alias("link"), K.shown_document(label, url).alias("shown"))


_HIT = [f"regexp_matches(s, '{p}')" for _, p in K.STATUS_WORDS]
_DENIED = K.STATUS_DENIED.replace("'", "''")


@query("sk06_explicit_status", f"""SELECT id, CASE WHEN length(s) > 60 OR regexp_matches(s, '{_DENIED}') OR {' + '.join(f'{h}::INT' for h in _HIT)} <> 1 THEN NULL WHEN {_HIT[0]} THEN 'CANCELLED' WHEN {_HIT[1]} THEN 'POSTPONED' ELSE 'COMPLETED' END AS status
FROM (SELECT id, lower(trim(coalesce(status_text, ''))) AS s FROM listing)""")  # fmt: skip
def sk06(v: Views):
    return v.listing.select("id", K.explicit_status(F.col("status_text")).alias("status"))


_VEHICLE = K.VEHICLE_TITLE.replace("(?i)", "")
_IS_VEHICLE = "(upper(coalesce({c}, '')) = 'VEHICLE' OR regexp_matches(coalesce(title, ''), '(?i)" + _VEHICLE + "'))"
_CATEGORY = "CASE id % 6 WHEN 0 THEN 'Vehicle' WHEN 1 THEN 'RESIDENTIAL' END"


@query("fl16_vehicle", f"SELECT id, {_IS_VEHICLE.format(c=_CATEGORY)} AS hit FROM listing")
def fl16(v: Views):
    return v.listing.select("id", K.is_vehicle(F.col("title"), F.expr(_CATEGORY)).alias("hit"))


_CODE = "(CAST(page_id AS INT) % 9)"
_CODES = "CASE page_id % 9 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 WHEN 5 THEN 302 WHEN 6 THEN 502 ELSE 200 END"
_PAGE = "CASE page_id % 4 WHEN 0 THEN '<p>Please verify you are human</p>' || html WHEN 1 THEN '<title>Access denied' || html ELSE html END"


@query("fl26_fetch_status", f"""SELECT page_id, CASE WHEN c = 401 THEN 'unauthorized' WHEN c IN (403, 429, 503) AND captcha THEN 'captcha' WHEN c = 403 THEN 'forbidden' WHEN c = 429 THEN 'rate_limited' WHEN c = 503 THEN 'service_unavailable'
  WHEN c = 302 THEN 'success' WHEN c <> 200 THEN 'temporary_error' WHEN length(b) < 20000 AND captcha THEN 'captcha' WHEN length(b) < 20000 AND denied THEN 'blocked' ELSE 'success' END AS status
FROM (SELECT *, regexp_matches(substr(b, 1, 40000), '{K.CAPTCHA_PAGE}') AS captcha, regexp_matches(substr(b, 1, 40000), '{K.DENIED_PAGE}') AS denied FROM (SELECT page_id, {_CODES} AS c, {_PAGE} AS b FROM pages))""")  # fmt: skip
def fl26(v: Views):
    rows = v.pages.selectExpr("page_id", f"{_CODES} AS c", f"{_PAGE} AS b")
    return rows.select("page_id", K.fetch_status(F.col("c"), F.col("b")).alias("status"))


# -- places and institutions -------------------------------------------------------------------------------------

_WORDS_OF = "regexp_extract_all({0}, '[^ -]*[ -]?')"


def sql_title(c: str) -> str:
    return f"array_to_string(list_transform({_WORDS_OF.format(f'lower(trim({c}))')}, lambda w: upper(w[1]) || w[2:]), '')"


def sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in table.items()) + "}"


def sql_city(c: str) -> str:
    key = rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
    return f"coalesce({sql_map(N.CITY_ALIASES)}[{key}], {sql_title(key)})"


def sql_state(c: str) -> str:
    key = rf"lower(trim(regexp_replace(regexp_replace({c}, '\s*&\s*', ' and ', 'g'), '\s+', ' ', 'g')))"
    return f"coalesce({sql_map(N.STATE_ALIASES)}[{key}], {sql_title(key)})"


@query("sc04_canon_city", f"SELECT id, {sql_city('city_text')} AS city FROM listing")
def sc04(v: Views):
    return v.listing.select("id", N.canon_city(F.col("city_text")).alias("city"))


@query("sc05_city_in_state", f"SELECT id, CASE WHEN lower(c) = 'aurangabad' AND lower(trim(state_text)) = 'maharashtra' THEN 'Chhatrapati Sambhajinagar' ELSE c END AS city FROM (SELECT id, state_text, {sql_city('city_text')} AS c FROM listing)")
def sc05(v: Views):
    return v.listing.select("id", N.canon_city_in_state(F.col("city_text"), F.col("state_text")).alias("city"))


@query("sc06_canon_state", f"SELECT id, {sql_state('state_text')} AS state FROM listing")
def sc06(v: Views):
    return v.listing.select("id", N.canon_state(F.col("state_text")).alias("state"))


_OLD = ", ".join(f"CASE WHEN s = '{x}' THEN {sql_title(chr(39) + k + chr(39))} END" for k, x in N.STATE_ALIASES.items())


@query("sc07_state_variants", f"SELECT DISTINCT state_text, unnest(list_filter([s, trim(state_text), replace(s, ' And ', ' & '), {_OLD}], lambda x: x IS NOT NULL)) AS variant FROM (SELECT state_text, {sql_state('state_text')} AS s FROM listing WHERE state_text IS NOT NULL)")
def sc07(v: Views):
    return v.listing.select("state_text").filter("state_text IS NOT NULL").distinct().select("state_text", F.explode(N.state_variants(F.col("state_text"))).alias("variant"))


@query("sc08_usable_city", f"SELECT id, CASE WHEN length(city_text) <= 40 AND lower(c) = lower(trim(city_text)) THEN c END AS city FROM (SELECT id, city_text, {sql_city('city_text')} AS c FROM listing)")
def sc08(v: Views):
    return v.listing.select("id", N.usable_city(F.col("city_text")).alias("city"))


def sql_bank_key(c: str) -> str:
    bare = f"regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '\b(limited|ltd|the|co operative|cooperative)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\[([^\]]*)\]\([^)]*\)|→', '', 'g'), '[\s\x{{00A0}}]+', ' ', 'g'), '[\s·,;|-]+$', ''))"


def sql_tidy(c: str) -> str:
    words = f"regexp_extract_all(lower({c}), '[a-z][a-z'']*|[^a-z]+')"
    word = f"CASE WHEN w IN {tuple(T.CAPITAL_WORDS)} THEN upper(w) WHEN w IN {tuple(T.SMALL_WORDS)} AND i > 1 THEN w ELSE upper(w[1]) || w[2:] END"
    letters, capitals = (f"length(regexp_replace({c}, '[^{x}]', '', 'g'))" for x in ("A-Za-z", "A-Z"))
    return f"CASE WHEN {letters} >= 6 AND {capitals} >= 0.7 * {letters} THEN array_to_string(list_transform({words}, lambda w, i: {word}), '') ELSE {c} END"


@query("sc09_tidy_case", f"SELECT id, {sql_tidy('title')} AS title, {sql_tidy('kind_text')} AS kind FROM listing")
def sc09(v: Views):
    return v.listing.select("id", T.tidy_case(F.col("title")).alias("title"), T.tidy_case(F.col("kind_text")).alias("kind"))


@query("sc10_bank_name", f"SELECT id, k AS raw_key, coalesce({sql_bank_key('a')}, k) AS key, coalesce(a, substr({sql_tidy('b')}, 1, 80)) AS name FROM (SELECT id, {sql_clean('bank_text')} AS b, {sql_bank_key('bank_text')} AS k, {sql_map(N.BANK_ALIASES)}[{sql_bank_key('bank_text')}] AS a FROM listing WHERE bank_text IS NOT NULL)")
def sc10(v: Views):
    bank = F.col("bank_text")
    return v.listing.filter("bank_text IS NOT NULL").select("id", N.bank_key(bank).alias("raw_key"), N.canonical_bank_key(bank).alias("key"), N.canonical_bank_name(bank).alias("name"))


@query("sc12_clean_text", f"SELECT id, {sql_clean('title')} AS title FROM listing")
def sc12(v: Views):
    return v.listing.select("id", T.clean_text(F.col("title")).alias("title"))


_UNIT = r"lower(regexp_extract({t}, '(?i)([0-9]+(?:\.[0-9]+)?)\s*(cr(?:ore)?s?|l(?:ac|akh)?s?|k)?\b', 2))"
_PLAIN = r"regexp_replace(replace(replace({c}, ',', ''), '₹', ' '), '(?i)\brs\.?\b', ' ', 'g')"


def sql_amount(c: str) -> str:
    t = _PLAIN.format(c=c)
    unit = _UNIT.format(t=t)
    n = rf"try_cast(nullif(regexp_extract({t}, '(?i)([0-9]+(?:\.[0-9]+)?)\s*(cr(?:ore)?s?|l(?:ac|akh)?s?|k)?\b', 1), '') AS DOUBLE)"
    return f"nullif(CAST(floor({n} * CASE WHEN {unit} LIKE 'cr%' THEN 1e7 WHEN {unit} LIKE 'l%' THEN 1e5 WHEN {unit} = 'k' THEN 1e3 ELSE 1 END + 0.5) AS BIGINT), 0)"


def sql_least(c: str, least: int) -> str:
    return f"CASE WHEN NOT contains({c}, '%') AND {sql_amount(c)} >= {least} THEN {sql_amount(c)} END"


@query("sm02_clean_money", r"SELECT id, CASE WHEN try_cast(t AS DOUBLE) > 0 AND regexp_full_match(t, '[0-9.]+') THEN round(try_cast(t AS DOUBLE), 2) END AS price FROM (SELECT id, regexp_replace(regexp_replace(lower(price_text), '\b(rs\.?|inr)\s*', '', 'g'), '[₹,\s]', '', 'g') AS t FROM listing)")
def sm02(v: Views):
    return v.listing.select("id", M.clean_money(F.col("price_text")).alias("price"))


@query("sm03_money_words", f"SELECT id, {sql_amount('price_text')} AS price FROM listing")
def sm03(v: Views):
    return v.listing.select("id", M.money_words(F.col("price_text")).alias("price"))


@query("sm04_notice_amount", r"""SELECT id, CAST(floor(n * CASE WHEN unit LIKE 'la%' THEN 1e5 WHEN unit LIKE 'cr%' THEN 1e7 ELSE 1 END + 0.5) AS BIGINT) AS price FROM (
  SELECT id, try_cast(nullif(replace(regexp_extract(price_text, p, 1), ',', '') || regexp_extract(price_text, p, 2), '') AS DOUBLE) AS n, lower(regexp_extract(price_text, p, 3)) AS unit
  FROM listing, (SELECT '""" + M.NOTICE_AMOUNT + "' AS p))")  # fmt: skip
def sm04(v: Views):
    return v.listing.select("id", M.notice_amount(F.col("price_text")).alias("price"))


@query("sm05_least_amount", f"SELECT id, {sql_least('price_text', 1000)} AS price, {sql_least('emd_text', 100)} AS emd FROM listing")
def sm05(v: Views):
    return v.listing.select("id", M.amount_at_least(F.col("price_text"), 1000).alias("price"), M.amount_at_least(F.col("emd_text"), 100).alias("emd"))


_MON = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower({0}))"


_P, _Q = r"([0-9]{1,2})[\s-]+([A-Za-z]{3})[a-z]*[\s,-]+([0-9]{4})", r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})"
_PARTS_P, _PARTS_Q = (", ".join(f"regexp_extract(date_text, '{p}', {k})" for k in (1, 2, 3)) for p in (_P, _Q))


@query("sd05_date_and_time", rf"""SELECT id, CASE WHEN day BETWEEN 1 AND last_day AND h < 24 THEN make_timestamp(y, m, day, h, n, 0) - interval 330 minute END AS at FROM (
  SELECT *, CASE WHEN half = 'pm' AND h0 < 12 THEN h0 + 12 WHEN half = 'am' AND h0 = 12 THEN 0 ELSE coalesce(h0, 11) END AS h, CASE WHEN m BETWEEN 1 AND 12 THEN day(last_day(make_date(y, m, 1))) END AS last_day FROM (
  SELECT id, try_cast(CASE WHEN w THEN d[3] ELSE e[3] END AS BIGINT) AS y, CASE WHEN w THEN {_MON.format('d[2]')} ELSE try_cast(e[2] AS BIGINT) END AS m, try_cast(CASE WHEN w THEN d[1] ELSE e[1] END AS BIGINT) AS day,
    try_cast(regexp_extract(t, '([0-9]{{1,2}}):([0-9]{{2}})', 1) AS BIGINT) AS h0, coalesce(try_cast(regexp_extract(t, '([0-9]{{1,2}}):([0-9]{{2}})', 2) AS BIGINT), 0) AS n, lower(regexp_extract(t, '(?i)[0-9]{{1,2}}:[0-9]{{2}}\s*(am|pm)', 1)) AS half
  FROM (SELECT id, coalesce(time_text, '') AS t, regexp_matches(date_text, '{_P}') AS w, [{_PARTS_P}] AS d, [{_PARTS_Q}] AS e
    FROM listing)))""")  # fmt: skip
def sd05(v: Views):
    return v.listing.select("id", D.date_and_time(F.col("date_text"), F.col("time_text")).alias("at"))


_N, _W = r"([0-9]{1,2})\s*[./-]\s*([0-9]{1,2})\s*[./-]\s*([0-9]{4})", r"(?i)([0-9]{1,2})(?:st|nd|rd|th)?[\s-]+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s,.-]+([0-9]{4})"


@query("sd08_notice_date", rf"""SELECT id, CASE WHEN n = '' AND w = '' THEN NULL WHEN y BETWEEN 2020 AND 2100 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND day(last_day(make_date(greatest(y, 1), greatest(least(m, 12), 1), 1))) THEN strftime(make_date(y, m, d), '%Y-%m-%d') ELSE 'invalid' END AS date FROM (
  SELECT *, try_cast(CASE WHEN by_n THEN regexp_extract(n, '{_N}', 3) ELSE regexp_extract(w, '{_W}', 3) END AS BIGINT) AS y, try_cast(CASE WHEN by_n THEN regexp_extract(n, '{_N}', 1) ELSE regexp_extract(w, '{_W}', 1) END AS BIGINT) AS d,
    CASE WHEN by_n THEN try_cast(regexp_extract(n, '{_N}', 2) AS BIGINT) ELSE {_MON.format(f"regexp_extract(w, '{_W}', 2)")} END AS m
  FROM (SELECT *, n <> '' AND (w = '' OR strpos(date_text, n) <= strpos(date_text, w)) AS by_n FROM (SELECT id, date_text, regexp_extract(date_text, '{_N}') AS n, regexp_extract(date_text, '{_W}') AS w FROM listing WHERE date_text IS NOT NULL)))
UNION ALL SELECT id, NULL FROM listing WHERE date_text IS NULL""")  # fmt: skip
def sd08(v: Views):
    return v.listing.select("id", D.notice_date(F.col("date_text")).alias("date"))


# -- records and gates -------------------------------------------------------------------------------------------


@query("sc15_normalize_listing", f"""SELECT id, CASE WHEN title IS NOT NULL THEN substr({sql_tidy(sql_clean('title'))}, 1, 200) END AS title, CASE WHEN bank_text IS NULL THEN NULL WHEN trim(bank_text) = '' THEN '' ELSE coalesce({sql_map(N.BANK_ALIASES)}[{sql_bank_key('bank_text')}], substr({sql_tidy(sql_clean('bank_text'))}, 1, 80)) END AS bank,
  CASE WHEN price_text IS NOT NULL THEN coalesce(CAST({sql_least('price_text', 1000)} AS VARCHAR), '') END AS reserve_price, CASE WHEN emd_text IS NOT NULL THEN coalesce(CAST({sql_least('emd_text', 100)} AS VARCHAR), '') END AS emd,
  substr(trim(regexp_replace(officer_text, '[^0-9+,\\-\\s/]', '', 'g')), 1, 40) AS officer_phone FROM listing""")  # fmt: skip
def sc15(v: Views):
    rows = v.listing.select("id", "title", F.col("bank_text").alias("bank"), F.col("price_text").alias("reserve_price"), F.col("emd_text").alias("emd"), F.col("officer_text").alias("officer_phone"))
    return G.normalize_listing(rows)


@query("sc17_officer", r"SELECT id, regexp_extract(regexp_replace(coalesce(officer_text, ''), '\s+', ' ', 'g'), '[\w.+-]+@[\w-]+(?:\.[\w-]+)+') AS email, CASE WHEN officer_text LIKE 'Contact%' THEN 'Mr Satish Trapasiya, Mr Jitendra Patel' WHEN officer_text LIKE 'Mr. A%' THEN 'Mr. A K Rao, Ms B' WHEN officer_text LIKE 'John%' THEN 'John, Mary' ELSE '' END AS name, CASE WHEN officer_text LIKE 'Contact%' THEN '+91 9726962491, +91 9974848487' WHEN officer_text LIKE 'Ph:%' THEN '022-26541234' WHEN officer_text LIKE 'Mr. A%' THEN '98765 43210' WHEN officer_text LIKE 'John%' THEN '9876543210' ELSE '' END AS phone FROM listing")
def sc17(v: Views):
    return v.listing.select("id", T.officer(F.col("officer_text")).alias("o")).select("id", "o.*")


@query("wn13_longest_run", """WITH RECURSIVE m AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: try_cast(x AS BIGINT)), lambda x: x IS NOT NULL) AS l FROM documents),
o AS (SELECT doc_id, l[i] AS n, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM m)),
e AS (SELECT a.doc_id, a.i, a.n, min(b.i) AS j FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.n = a.n + 1 AND b.i > a.i GROUP BY ALL),
r AS (SELECT doc_id, i AS start, n AS first, j, 1 AS length FROM e UNION ALL SELECT r.doc_id, r.start, r.first, e.j, r.length + 1 FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.j),
l AS (SELECT doc_id, start, first, max(length) AS length FROM r GROUP BY ALL)
SELECT doc_id, first, length::INT AS length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start) AS k FROM l) WHERE k = 1""")  # fmt: skip
def wn13(v: Views):
    numbers = F.filter(F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    rows = v.documents.select("doc_id", numbers.alias("numbers")).filter(F.size("numbers") > 0)
    return rows.select("doc_id", T.longest_run(F.col("numbers")).alias("r")).select("doc_id", "r.*")


_PLACE = "CASE WHEN id % 3 = 0 THEN city_text END"
_BLOCKED = "id % 23 = 0"


@query("fl15_quality_gate", f"""SELECT id, CASE WHEN {_BLOCKED} THEN ['source_on_do_not_fetch_list'] WHEN len(shape) > 0 THEN shape WHEN {_IS_VEHICLE.format(c=_CATEGORY)} OR regexp_matches(coalesce(title, '') || ' ' || coalesce(kind_text, ''), '{G.MOVABLES}') THEN ['invalid_property_type'] ELSE [] END AS why,
  list_filter([CASE WHEN coalesce(trim(price_text), '') = '' THEN 'reserve_price_missing' END, CASE WHEN coalesce(trim(date_text), '') = '' THEN 'auction_date_missing' END, CASE WHEN coalesce(trim(p), '') = '' THEN 'address_missing' END], lambda x: x IS NOT NULL) AS strict_why
FROM (SELECT *, {_PLACE} AS p, list_filter([CASE WHEN title IS NULL OR trim(title) = '' OR length(title) < 8 THEN 'title_missing' END, CASE WHEN coalesce(trim(bank_text), '') = '' AND coalesce(trim({_PLACE}), '') = '' THEN 'address_missing' END], lambda x: x IS NOT NULL) AS shape FROM listing)""")  # fmt: skip
def fl15(v: Views):
    rows = v.listing.withColumns({"p": F.expr(_PLACE), "c": F.expr(_CATEGORY), "b": F.expr(_BLOCKED)})
    why = G.quality_gate(F.col("title"), F.col("bank_text"), F.col("p"), F.col("c"), F.col("kind_text"), F.col("b"))
    none = F.lit(None).cast("string")
    return rows.select("id", why.alias("why"), G.strict_gate(F.col("price_text"), F.col("date_text"), none, F.col("p"), none).alias("strict_why"))


_LATEST, _FETCHED, _PARSED, _RECORD = "CASE WHEN id % 4 <> 1 THEN CASE WHEN id % 11 = 0 THEN 'false' ELSE ' true' END END", "CASE WHEN id % 4 <> 2 THEN CASE WHEN id % 13 = 0 THEN 'timeout' ELSE 'Success' END END", "CASE WHEN id % 17 = 0 THEN 'Unparsed' ELSE 'parsed' END", "CASE id % 19 WHEN 0 THEN 'Duplicate of 4' WHEN 1 THEN 'archived' WHEN 2 THEN NULL ELSE 'active' END"


@query("fl18_row_verdict", f"""SELECT id, CASE WHEN coalesce(trim(title), '') = '' THEN 'no title' WHEN upper(trim({_LATEST})) <> 'TRUE' THEN 'older snapshot' WHEN lower(trim({_FETCHED})) <> 'success' THEN 'fetch error' WHEN {_PARSED} = 'Unparsed' THEN 'not parsed'
  WHEN regexp_matches({_RECORD}, '{G.INACTIVE_RECORD}') THEN 'record not active' WHEN {sql_kinds('lower(kind_text)', K.FEED_KINDS)} = 'EXCLUDED' OR regexp_matches(title, '{G.MOVABLE_TITLE}') THEN 'movable asset (not real estate)' WHEN {_BLOCKED} THEN 'source is on the do-not-fetch list' END AS verdict FROM listing""")  # fmt: skip
def fl18(v: Views):
    verdict = G.row_verdict(F.col("title"), F.expr(_LATEST), F.expr(_FETCHED), F.expr(_PARSED), F.expr(_RECORD), F.col("kind_text"), F.expr(_BLOCKED))
    return v.listing.select("id", verdict.alias("verdict"))


_EXTERNAL, _END = "CASE WHEN id % 9 > 0 THEN 'x' END", "start + interval 5 day - interval 1 day * (id % 8)"


@query("fl19_validate", f"""SELECT id, list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'Missing title' END, CASE WHEN {_EXTERNAL} IS NULL THEN 'Missing external auction/listing ID (needed for dedup)' END, CASE WHEN r <= 0 THEN 'Reserve price is not a positive number' END,
  CASE WHEN e < 0 THEN 'EMD is negative' END, CASE WHEN start > {_END} THEN 'Auction start is after auction end' END], lambda x: x IS NOT NULL) AS errors, ({sql_kinds('lower(kind_text)', K.PROPERTY_KINDS)}) IS NULL OR r IS NULL OR start IS NULL AS needs_review
FROM (SELECT *, CASE WHEN id % 5 > 0 THEN price - 20000 END AS r, price - 30000 AS e FROM listing)""")  # fmt: skip
def fl19(v: Views):
    r, e = F.expr("CASE WHEN id % 5 > 0 THEN price - 20000 END"), F.col("price") - 30000
    end = F.expr("start + make_dt_interval(5) - make_dt_interval(1) * (id % 8)")
    errors = G.record_errors(F.col("title"), F.expr(_EXTERNAL), r, e, F.col("start"), end)
    return v.listing.select("id", errors.alias("errors"), G.needs_review(K.property_kind(F.col("kind_text")), r, F.col("start")).alias("needs_review"))


_ADDRESS = "CASE id % 7 WHEN 0 THEN 'Near lake, Nashik' WHEN 1 THEN 'Pincode-416 310' WHEN 2 THEN 'plot in Karnataka' WHEN 3 THEN 'Pin code: 560001' WHEN 4 THEN 'Survey 401 202, MAHARASHTRA' WHEN 5 THEN '' END"
_UNIQUE = sorted({x.lower().replace("-", " ") for x in G.DISTRICTS + G.CITIES} - {x.lower() for x in G.AMBIGUOUS})
_KEYOF = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_LOCATION = rf"""SELECT id, CASE WHEN s IS NOT NULL AND s <> 'Maharashtra' THEN 'reject' WHEN other OR pin = 'no' THEN CASE WHEN stated OR here THEN 'review' ELSE 'reject' END WHEN stated OR here THEN 'accept' WHEN unclear AND pin = 'yes' THEN 'accept' ELSE 'review' END AS verdict
FROM (SELECT *, coalesce(s = 'Maharashtra', false) OR regexp_matches(t, '(?i)\bmaharashtra\b') AS stated, regexp_matches(t, '(?i)\b({"|".join(x.replace(" ", chr(92) + "s+") for x in G.OTHER_STATES)})\b') AS other,
  CASE WHEN p3 BETWEEN 400 AND 402 OR p3 BETWEEN 404 AND 445 THEN 'yes' WHEN p3 IS NOT NULL THEN 'no' END AS pin,
  regexp_matches(' ' || {_KEYOF.format('t')} || ' ', ' ({"|".join(_UNIQUE)}) ') AS here, {_KEYOF.format("coalesce(city_text, '')")} = 'aurangabad' AS unclear
  FROM (SELECT *, try_cast(nullif(regexp_extract(t, '(?i)pin\s*code\s*[-:]?\s*(\d{{3}})\s?\d{{3}}\b', 1), '') AS INT) AS p3 FROM (
    SELECT id, city_text, CASE WHEN state_text IS NOT NULL AND id % 2 = 0 THEN {sql_state('state_text')} END AS s, concat_ws(' ', nullif(trim({_ADDRESS}), ''), city_text) AS t FROM listing)))"""


def _verdicts(v: Views):
    none = F.lit(None).cast("string")
    return G.location_verdict(F.when(F.col("id") % 2 == 0, F.col("state_text")), none, F.col("city_text"), none, F.expr(_ADDRESS), none)


@query("fl23_location_verdict", _LOCATION)
def fl23(v: Views):
    return v.listing.select("id", _verdicts(v).alias("verdict"))


_HERE = list(dict.fromkeys(" ".join(x.lower().replace("-", " ").split()) for x in G.DISTRICTS + G.CITIES if x.lower() not in {y.lower() for y in G.AMBIGUOUS}))
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_EVIDENCE = rf"""WITH a AS (SELECT id, nullif(trim(CASE WHEN id % 2 = 0 THEN state_text END), '') AS state, coalesce(city_text, '') AS city, concat_ws(' ', nullif(trim({_ADDRESS}), ''), city_text) AS t FROM listing),
b AS (SELECT *, CASE WHEN state IS NOT NULL THEN {sql_state('state')} END AS named, regexp_replace(regexp_extract(t, '(?i)pin\s*code\s*[-:]?\s*(\d{{3}}\s?\d{{3}})\b', 1), '\s', '', 'g') AS pin, regexp_matches(t, '(?i)\bmaharashtra\b') AS in_name,
  list_filter({_LIST(G.OTHER_STATES)}, lambda s: regexp_matches(t, '(?i)\b' || replace(s, ' ', '\s+') || '\b')) AS others, list_filter({_LIST(_HERE)}, lambda p: contains(' ' || {_KEYOF.format('t')} || ' ', ' ' || p || ' ')) AS inside, {_KEYOF.format('city')} AS key FROM a),
c AS (SELECT *, CASE WHEN pin = '' THEN NULL ELSE left(pin, 3)::INT BETWEEN 400 AND 402 OR left(pin, 3)::INT BETWEEN 404 AND 445 END AS pin_ok, coalesce(CASE WHEN list_contains({_LIST(_HERE)}, key) THEN key END, inside[1]) AS place,
  CASE WHEN list_contains({_LIST([x.lower() for x in G.AMBIGUOUS])}, key) THEN key END AS unsure FROM b),
d AS (SELECT *, coalesce(named = 'Maharashtra', false) AS own, coalesce(named = 'Maharashtra', false) OR in_name OR place IS NOT NULL AS yes FROM c),
e AS (SELECT *, list_filter([CASE WHEN own THEN 'state field says Maharashtra' END, CASE WHEN in_name THEN 'address text names Maharashtra' END, CASE WHEN pin_ok THEN 'PIN ' || pin || ' is a Maharashtra PIN' END, CASE WHEN place IS NOT NULL THEN 'district / city "' || place || '" is in Maharashtra' END], lambda x: x IS NOT NULL) AS basis,
  list_filter([CASE WHEN NOT pin_ok AND yes THEN 'PIN ' || pin || ' is not a Maharashtra PIN but other evidence says Maharashtra' END, CASE WHEN len(others) > 0 AND yes THEN 'the address also names ' || array_to_string(others, ', ') END], lambda x: x IS NOT NULL) AS conflicts FROM d),
f AS (SELECT *, CASE WHEN named <> 'Maharashtra' THEN 1 WHEN len(conflicts) > 0 THEN 2 WHEN NOT pin_ok THEN 3 WHEN len(others) > 0 THEN 4 WHEN yes THEN 5 WHEN unsure IS NOT NULL AND pin_ok THEN 6 WHEN unsure IS NOT NULL THEN 7 ELSE 8 END AS rule FROM e)
SELECT id, ['reject', 'review', 'reject', 'reject', 'accept', 'accept', 'review', 'review'][rule] AS verdict, CASE WHEN rule = 1 THEN '' ELSE array_to_string(basis, '; ') || CASE WHEN rule = 6 THEN '; "' || unsure || '" is ambiguous but the PIN settles it' ELSE '' END END AS basis,
CASE rule WHEN 1 THEN 'the property''s state is "' || state || '"' WHEN 2 THEN array_to_string(conflicts, '; ') WHEN 3 THEN 'PIN ' || pin || ' is not a Maharashtra PIN' WHEN 4 THEN 'the address names ' || array_to_string(others, ', ') || ' and not Maharashtra' WHEN 7 THEN '"' || unsure || '" exists in more than one state and no state or PIN settles it'
  WHEN 8 THEN CASE WHEN t <> '' THEN 'the location text does not name a Maharashtra district, city or state, and there is no state field or PIN code' ELSE 'no location evidence' END ELSE '' END AS reasons FROM f"""


@query("fl23_location_evidence", _EVIDENCE)
def fl23_evidence(v: Views):
    none = F.lit(None).cast("string")
    state = F.when(F.col("id") % 2 == 0, F.col("state_text"))
    rows = v.listing.select("id", state.alias("state"), none.alias("district"), F.col("city_text").alias("city"), none.alias("area"), F.expr(_ADDRESS).alias("address"), none.alias("pin"))
    return PH.location_evidence(rows).select("id", "verdict", F.array_join("basis", "; ").alias("basis"), F.array_join("reasons", "; ").alias("reasons"))


_CONFIRMED = ("state bank of india", "punjab national bank", "union bank of india", "xyz co operative bank")
_ALIAS = f"{sql_map(N.BANK_ALIASES)}[{sql_bank_key('bank_text')}]"
_GATE_KEY = f"coalesce({sql_bank_key(_ALIAS)}, {sql_bank_key('bank_text')})"


@query("fl24_two_gates", f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN coalesce(trim(bank_text), '') = '' THEN 'institution_unknown' WHEN {_GATE_KEY} NOT IN {_CONFIRMED} THEN 'institution_not_verified' WHEN l.verdict = 'reject' THEN 'location_rejected' WHEN l.verdict = 'review' THEN 'location_review' ELSE 'qualified' END AS outcome
FROM listing JOIN ({_LOCATION}) l USING (id)) GROUP BY outcome""")  # fmt: skip
def fl24(v: Views):
    """The institution first, then the place; counts of each way out."""
    known, verdict = N.canonical_bank_key(F.col("bank_text")).isin(*_CONFIRMED), _verdicts(v)
    outcome = (
        F.when(F.coalesce(F.trim("bank_text"), F.lit("")) == "", "institution_unknown")
        .when(~known, "institution_not_verified")
        .when(verdict == "reject", "location_rejected")
        .when(verdict == "review", "location_review")
        .otherwise("qualified")
    )
    return R.grouped_count(v.listing.select(outcome.alias("outcome")), "outcome")


_KNOWN = f"coalesce(CASE WHEN id % 4 = 0 THEN 'LAND_PLOT' END, {sql_kinds('lower(kind_text)', K.PROPERTY_KINDS)}, {sql_kinds('lower(title)', K.PROPERTY_KINDS)})"


@query("er12_auto_review", f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN {_IS_VEHICLE.format(c='k')} THEN 'REMOVED' WHEN k IS NOT NULL AND coalesce(trim(city_text), '') <> '' AND (r IS NOT NULL OR s IS NOT NULL) AND length(title) >= 8 THEN 'PUBLISHED' ELSE 'PENDING_REVIEW' END AS verdict
FROM (SELECT *, {_KNOWN} AS k, CASE WHEN id % 3 = 0 THEN price END AS r, CASE WHEN id % 5 = 0 THEN start END AS s FROM listing)) GROUP BY verdict""")  # fmt: skip
def er12(v: Views):
    category, r, s = F.when(F.col("id") % 4 == 0, "LAND_PLOT"), F.when(F.col("id") % 3 == 0, F.col("price")), F.when(F.col("id") % 5 == 0, F.col("start"))
    verdict = G.review_verdict(F.col("title"), category, F.col("kind_text"), F.col("city_text"), r, s)
    return R.grouped_count(v.listing.select(verdict.alias("verdict")), "verdict")
