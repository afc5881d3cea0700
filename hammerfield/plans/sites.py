"""Queries: pages, sheets and workbook cells made of listings, read back into the listings that they show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kinds import FEED_KINDS
from ..sources import readers as S
from ..sources.details import detail_records
from ..sources.rendered import rendered_records
from .proxies import Views
from .listings import sql_kinds
from .registry import query


@query("src09_card_list", """SELECT id, title, city, price, n::BIGINT AS total FROM (SELECT o.id, trim(o.title) AS title, trim(o.city_text) AS city, trim(o.price_text) AS price, count(*) OVER (PARTITION BY customer) AS n FROM listing o) WHERE city IS NOT NULL AND price IS NOT NULL""")
def src09(v: Views):
    """A list page for each customer; cards without a city or a price are none."""
    safe = lambda c: F.coalesce(F.col(c), F.lit(""))
    card = F.concat(F.lit('<div class="card"><a href="/p/'), F.col("id").cast("string"), F.lit('">'), safe("title"), F.lit('</a><span class="city">'), safe("city_text"), F.lit('</span> <span class="price"><b>'), safe("price_text"), F.lit("</b></span></div>"))
    pages = v.listing.groupBy("customer").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" results"), F.array_join(F.collect_list(card), "\n"), F.lit('<a rel="next" href="/l?p=2">n</a>')).alias("html"))
    found = pages.select(S.card_list(F.col("html")).alias("l")).select("l.total", F.explode("l.cards").alias("c"))
    return found.select("c.id", "c.title", "c.city", "c.price", "total")


_START = "CASE WHEN id % 6 > 0 THEN start END"


@query("src11_detail_page", f"""SELECT id, bank, price, st AS start, list_filter([CASE WHEN id % 7 = 0 THEN 'no canonical address' END, CASE WHEN id % 7 = 1 THEN 'canonical address of another' END, CASE WHEN bank IS NULL THEN 'no bank' END, CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN st IS NULL THEN 'no start' END], lambda x: x IS NOT NULL) AS errors
FROM (SELECT id, nullif(trim(regexp_replace(bank_text, '\\s+', ' ', 'g')), '') AS bank, CASE WHEN id % 4 > 0 AND round(price) > 0 THEN round(price) END AS price, {_START} AS st FROM listing)""")  # fmt: skip
def src11(v: Views):
    row = lambda label, value: F.concat(F.lit(f"<tr><th>{label}:</th><td>"), F.coalesce(value, F.lit("")), F.lit("</td></tr>"))
    i = F.col("id")
    own = F.when(i % 7 == 0, "").otherwise(F.concat(F.lit('<link rel="canonical" href="https://x.org/auction/'), F.when(i % 7 == 1, i + 1).otherwise(i).cast("string"), F.lit('">')))
    price = F.when(i % 4 > 0, F.concat(F.lit("Rs "), F.format_number(F.round("price"), 0)))
    bank = F.regexp_replace(F.col("bank_text"), r"\s+", " ")
    html = F.concat(own, F.lit("<table>"), row("Bank", bank), row("Reserve Price", price), row("Auction start", F.date_format(F.expr(_START), "yyyy-MM-dd HH:mm:ss")), F.lit("</table>"))
    return v.listing.select("id", S.detail_record(html, i).alias("r")).select("id", "r.*")


@query("src14_rendered_page", """SELECT id, nullif(trim(kind_text), '') AS kind, trim(city_text) AS city, CASE WHEN id % 3 > 0 THEN trim(price_text) END AS price FROM listing""")
def src14(v: Views):
    """The visible text of a page: some labels stand before their values, some above them; a second mention counts for nothing."""
    safe = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = lambda label, c: F.when(F.trim(safe(c)) != "", F.concat(F.lit(label), F.lit(": "), safe(c), F.lit("\n"))).otherwise("")
    above = F.when(F.col("city_text").isNotNull(), F.concat(F.lit("City:\n\n  "), safe("city_text"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("Welcome\n"), line("Property Type", "kind_text"), above, F.when(F.col("id") % 3 > 0, line("Reserve price", "price_text")).otherwise(""), F.when(F.col("kind_text").isNotNull() & (F.trim("kind_text") != ""), "Property type: other\n").otherwise(""), F.lit("Thank you\n"))
    m = S.label_lines(text)
    get = lambda k: F.try_element_at(m, F.lit(k))
    return v.listing.select("id", get("property type").alias("kind"), get("city").alias("city"), get("reserve price").alias("price"))


@query("src15_sheet_tabs", """SELECT c_custkey AS row, c_custkey AS id, c_name AS title, a.price, a.start FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price, max(o_orderdate) AS start FROM orders GROUP BY 1) a ON o_custkey = c_custkey WHERE c_custkey > 40""")
def src15(v: Views):
    """Two tabs: customers after row 40, with the latest of their orders."""
    properties = v.customer.select(F.col("c_custkey").alias("row"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    auctions = v.orders.select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("start"))
    return S.sheet_rows({"Auctions": auctions, "Properties": properties}, {"Properties": 40, "Auctions": 10_000})


@query("src17_raw_rows", """SELECT id, CASE WHEN id % 3 = 2 THEN (100 + id)::VARCHAR ELSE nullif(trim(price_text), '') END AS price, CASE WHEN id % 3 = 2 THEN 'Town ' || id WHEN id % 3 = 0 THEN nullif(trim(kind_text), '') ELSE kind_text END AS place FROM listing""")
def src17(v: Views):
    """A record as a markdown table, as JSON or as card text."""
    i, safe = F.col("id"), lambda c: F.coalesce(F.col(c), F.lit(""))
    table = F.concat(F.lit("| Label | Value |\n|---|---|\n| Reserve price: | "), safe("price_text"), F.lit(" |\n| Location: | "), safe("kind_text"), F.lit(" |\n| Location: | again |"))
    fields = F.to_json(F.struct(F.lit("c").alias("catalogue"), F.struct(F.nullif(F.trim("price_text"), F.lit("")).alias("Reserve Price"), F.col("kind_text").alias("Location")).alias("fields")))
    card = F.concat(F.lit("Auction reserve price ₹"), (100 + i).cast("string"), F.lit("\n\n## Property location\nTown "), i.cast("string"), F.lit("\n## More\n"))
    m = S.raw_record(F.when(i % 3 == 0, table).when(i % 3 == 1, fields).otherwise(card))
    place = F.try_element_at(m, F.lit("location"))
    # an empty first mention leaves the label to the second
    return v.listing.select("id", F.try_element_at(m, F.lit("reserve price")).alias("price"), F.when(place == "again", None).otherwise(place).alias("place"))


_CLEAN = "CASE WHEN TRY_CAST({0} AS DOUBLE) > 0 THEN round(CAST({0} AS DOUBLE), 2) END".format("regexp_replace(regexp_replace(lower({c}), '\\b(rs\\.?|inr)\\s*', '', 'g'), '[₹,\\s]', '', 'g')")


@query("src14_rendered_records", f"""SELECT page_id, property_id, auction_id, title, property_type, category, bank, branch, borrower, city, reserve_price, emd, auction_start, emd_deadline, n_documents, usable,
  array_to_string(list_filter([CASE WHEN title IS NULL THEN 'title_missing' END, CASE WHEN city IS NULL THEN 'address_missing' END, CASE WHEN reserve_price IS NULL THEN 'reserve_price_missing' END, CASE WHEN auction_start IS NULL THEN 'auction_date_missing' END, CASE WHEN bank IS NULL THEN 'bank_missing' END, CASE WHEN borrower IS NULL THEN 'borrower_name_missing' END], lambda x: x IS NOT NULL), ',') AS missing
FROM (SELECT *, title IS NOT NULL AND reserve_price IS NOT NULL AND city IS NOT NULL AND bank IS NOT NULL AS usable FROM (SELECT id AS page_id, CASE WHEN id % 5 > 0 THEN 'P' || id ELSE 'Q' || id END AS property_id, CASE WHEN id % 2 = 0 THEN id::VARCHAR END AS auction_id,
  CASE id % 3 WHEN 0 THEN 'Sale lot ' || (id + 1000) WHEN 1 THEN '2 BHK for sale in Pune ' || id END AS title,
  CASE id % 4 WHEN 0 THEN 'Individual House' WHEN 1 THEN 'Shop' END AS property_type, CASE id % 4 WHEN 0 THEN 'RESIDENTIAL' WHEN 1 THEN 'COMMERCIAL' END AS category,
  nullif(trim(regexp_replace(bank_text, '\\s+', ' ', 'g')), '') AS bank, CASE WHEN id % 7 > 0 THEN 'Fort ' || id END AS branch, CASE WHEN id % 3 <> 1 THEN 'Mr ' || id END AS borrower,
  trim(regexp_replace(city_text, '\\s+', ' ', 'g')) AS city, {_CLEAN.format(c="price_text")} AS reserve_price, CASE WHEN id % 2 = 1 THEN {_CLEAN.format(c="emd_text")} END AS emd,
  CASE WHEN id % 11 > 0 THEN date_trunc('minute', start) + (id % 24) * INTERVAL 1 HOUR END AS auction_start, CASE WHEN id % 2 = 0 THEN TIMESTAMP '2026-10-06 10:15:00' END AS emd_deadline, 1::BIGINT AS n_documents FROM listing))""")  # fmt: skip
def src14_records(v: Views):
    """Pages with a table, a definition list and lines: labels with and without values, repeated ones and ones that say nothing."""
    i, own = F.col("id"), F.col("id").cast("string")
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in parts])
    html = put(
        "<h1>", F.when(i % 3 == 0, put("Sale <b>lot</b> ", (i + 1000).cast("string"))).otherwise("Home"), "</h1><table><tr><th>Bank Name:</th><td>", F.col("bank_text"), "</td></tr><tr><td>Branch</td></tr></table>",
        "<dl><dt>City</dt> <dd>", F.col("city_text"), '</dd></dl><a href="/n', own, '.pdf?x=1">Sale notice</a><a href="/user-manual.pdf">Manual</a><a href="/other">Other</a>',
    )
    begin = F.expr("date_trunc('minute', start) + make_interval(0, 0, 0, 0, cast(id % 24 as int), 0, 0)")
    text = put(
        F.when(i % 5 > 0, put("Bank Property ID\nP", own)).otherwise(put("Property ID Q", own)), "\n",
        F.when(i % 4 == 0, "Individual House, Residential\n").when(i % 4 == 1, "Shop, Commercial\n"), F.when(i % 3 == 1, put("2 BHK for sale in Pune ", own, "\n")),
        F.when(F.col("price_text").isNotNull(), put("Reserve Price (INR): ", F.col("price_text"), "\nReserve price: 77\n")),
        F.when(i % 2 == 0, "EMD Amount\nEMD End Date\n2026-10-06T10:15\n").when(F.col("emd_text").isNotNull(), put("EMD Amount\n", F.col("emd_text"), "\n")),
        F.when(i % 7 == 0, "Branch Name\nContact Us\n").otherwise(put("Branch Name\n  Fort   ", own, "\n")),
        "Borrower's Name: ", F.when(i % 3 == 1, "N/A\nBorrower: Mr Second").otherwise(put("Mr ", own)), "\n",
        "Auction Start Date & Time: ", F.when(i % 11 > 0, F.date_format(begin, "dd-MM-yyyy hh:mm a")).otherwise("31-02-2026 10:00"), "\nAuction End Date",
    )
    pages = v.listing.select(i.alias("page_id"), F.concat(F.lit("https://x.org/"), F.when(i % 2 == 0, "auction-detail/").otherwise("view/"), own).alias("url"), html.alias("html"), text.alias("text"))
    shown = ("page_id", "property_id", "auction_id", "title", "property_type", "category", "bank", "branch", "borrower", "city", "reserve_price", "emd", "auction_start", "emd_deadline")
    return rendered_records(pages).select(*shown, F.size("documents").cast("long").alias("n_documents"), "usable", F.array_join("missing", ",").alias("missing"))


_TYPE = "nullif(trim(regexp_replace(kind_text, '\\s+', ' ', 'g')), '')"


@query("src11_detail_records", f"""SELECT page_id, CASE WHEN e = '' AND kind = 'EXCLUDED' THEN 'no real estate' ELSE e END AS errors, reserve_price, pincode, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN kind END AS category, CASE WHEN ok THEN bank END AS bank,
  CASE WHEN ok THEN locality END AS geo_locality, CASE WHEN ok THEN st END AS auction_start, CASE WHEN ok THEN 'src:x.org:' || page_id END AS external_id, CASE WHEN ok THEN page_id % 3 END AS n_documents
FROM (SELECT *, e = '' AND kind <> 'EXCLUDED' AS ok FROM (SELECT *, CASE WHEN page_id % 17 = 0 THEN 'check page' WHEN page_id % 17 = 1 THEN 'empty page' ELSE array_to_string(list_filter([CASE WHEN page_id % 13 = 0 THEN 'no canonical address' WHEN page_id % 13 = 1 THEN 'canonical address on another host' WHEN page_id % 13 = 2 THEN 'canonical address of no property' END,
    CASE WHEN page_id % 19 = 0 THEN 'no number' WHEN page_id % 13 = 3 THEN 'number of another property' END, CASE WHEN price_text IS NOT NULL AND reserve_price IS NULL THEN 'unreadable reserve price' END, CASE WHEN reserve_price IS NULL THEN 'no reserve price' END, CASE WHEN page_id % 7 = 0 THEN 'unreadable auction start' END, CASE WHEN page_id % 5 = 0 THEN 'no place' END, CASE WHEN type IS NULL AND page_id % 2 = 0 THEN 'no type or title' END], lambda x: x IS NOT NULL), ',') END AS e FROM (
  SELECT id AS page_id, price_text, CASE WHEN id % 17 > 1 THEN {_CLEAN.format(c="price_text")} END AS reserve_price, CASE WHEN id % 17 > 1 AND id % 3 > 0 THEN '400601' END AS pincode, {_TYPE} AS type, coalesce({_TYPE}, 'Property') || ' for sale in ' || CASE WHEN id % 4 = 0 THEN 'old FORT.,, ' ELSE '' END || 'Town ' || id AS title,
    CASE WHEN regexp_matches(k, '\\b(land|plot)\\b') AND NOT contains(k, 'building') THEN 'LAND_PLOT' WHEN regexp_matches(k, '\\b(house|flat|apartment|villa|bungalow)\\b') THEN 'RESIDENTIAL' WHEN f = 'EXCLUDED' THEN 'EXCLUDED' WHEN id % 3 = 1 THEN 'COMMERCIAL' ELSE coalesce(f, '') END AS kind,
    nullif(trim(regexp_replace(bank_text, '\\s+', ' ', 'g')), '') AS bank, CASE WHEN id % 4 = 0 THEN 'Old Fort' END AS locality, CASE WHEN id % 6 > 0 THEN date_trunc('minute', start) + INTERVAL 30 YEAR - INTERVAL 330 MINUTE END AS st FROM (SELECT *, lower(coalesce({_TYPE}, '')) AS k, {sql_kinds("lower(" + _TYPE + ")", FEED_KINDS)} AS f FROM listing))))""")  # fmt: skip
def src11_records(v: Views):
    """Detail pages, some without a number, with another's address, with labels that have no value, or no page at all."""
    i, own = F.col("id"), F.col("id").cast("string")
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in parts])
    item = lambda label, value: F.when(value.isNotNull(), put(f"<li><strong>{label} :</strong> <span>", value, "</span></li>"))
    address = F.when(i % 13 == 1, put("https://y.org/properties/", own)).when(i % 13 == 2, "/about").when(i % 13 == 3, put("/properties/", (i + 1).cast("string"))).otherwise(put("https://www.x.org/properties/", own, "/"))
    begin = F.date_format(F.expr("start + interval 30 years"), "dd-MM-yyyy hh:mm a")
    page = put(
        F.when(i % 13 > 0, put('<link rel="canonical" href="', address, '">')), "<title>Auction</title><body>", F.when(i % 19 > 0, put('<a class="text-dark fw-bold">Auction ID : #', own, "</a>")),
        F.when(i % 2 == 1, "<h1>A <i>lot</i></h1>"), "<ul><li><strong>Borrower Name :</strong></li>", item("Property Type", F.col("kind_text")), item("Asset Category", F.when(i % 3 == 1, "Commercial").otherwise("Any")),
        "<li><strong>Bank Name:</strong> ", F.col("bank_text"), "</li>", item("Reserve Price", F.col("price_text")), item("Reserve Price", F.when(F.col("price_text").isNotNull(), "5")),
        item("Auction Start Date", F.when(i % 7 == 0, "31-02-2026 02:00 PM").when(i % 6 > 0, begin)), item("City/Town", F.when(i % 5 > 0, put("Town ", own))), item("Area/Town", F.when((i % 4 == 0) & (i % 5 > 0), "old FORT.,")),
        "</ul><div class=\"card\"><h5>Description</h5><div class=\"card-body\"><p>A lot", F.when(i % 3 > 0, ", pin code - 400 601"), "</p></div></div><ul>", F.when(i % 3 > 0, '<li id="notice1"><a href="https://x.org/1.pdf">1</a></li>'),
        F.when(i % 3 > 1, '<li id="notice2"><a href="https://x.org/2.pdf">2</a></li>'), '<li id="notice3"><a href="http://x.org/3.pdf">3</a></li></ul></body>',
    )
    html = F.when(i % 17 == 0, "<title>Just a moment...</title><body>Wait</body>").when(i % 17 > 1, page)
    shown = detail_records(v.listing.select(i.alias("page_id"), html.alias("html")), "x.org")
    record = ("title", "category", "bank", "geo_locality", "auction_start", "external_id")
    return shown.select("page_id", F.array_join("errors", ",").alias("errors"), "reserve_price", "pincode", *[F.col(f"record.{x}").alias(x) for x in record], F.size("record.documents").cast("long").alias("n_documents"))
