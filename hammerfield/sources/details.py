"""Detail pages of an auction site: labelled values, checked against each other and the page's own address, and the listing they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_range, indian_date_time
from ..functions.kinds import site_kind
from ..functions.money import clean_money
from ..functions.names import canon_city
from ..functions.text import collapse, first_of_each, once, title_case
from .readers import unwrap_source
from .rendered import absolute_url

#: The labels of each field, as the site writes them (the misspelling is its own), and what its check pages say.
LABELS = {
    "property_type": ["property type"],
    "site_category": ["asset category"],
    "auction_type": ["auction type"],
    "bank": ["bank name"],
    "branch": ["branch name"],
    "service_provider": ["service provider"],
    "borrower": ["borrower name"],
    "reserve_text": ["reserve price"],
    "emd_text": ["emd"],
    "start_text": ["auction start date"],
    "end_text": ["auction end time"],
    "deadline_text": ["application subbmision date", "application submission date"],
    "state": ["province/state"],
    "city": ["city/town"],
    "area": ["area/town"],
}
CHECK_PAGE = r"(?i)just a moment|enable javascript and cookies to continue|verify you are human|attention required"
#: What stands beside a label, after it where it ends, up to where its parent closes.
BESIDE = r"(?is)^(?:[^>]*>.*?</strong>)?(.*?)(?:</(?:li|div|td|tr|ul|section|body)\b|$)"
TYPED = ("reserve_text", "emd_text", "start_text", "end_text", "deadline_text")


def _plain(html: Column) -> Column:
    return collapse(F.regexp_replace(html, "<[^>]*>", " "))


def _found(html: Column, pattern: str) -> Column:
    return F.nullif(_plain(F.regexp_extract(html, pattern, 1)), F.lit(""))


def labelled_values(html: Column) -> Column:
    """array of struct(k, v): what stands beside each <strong> label, lower-cased: the first span, link or paragraph, else the text."""
    parts = F.slice(F.split(html, r"(?i)<strong\b"), 2, 1 << 30)

    def inside(beside: Column) -> Column:
        return F.when(beside.rlike(r"(?is)<(span|a|p)\b"), F.regexp_extract(beside, r"(?is)<(span|a|p)\b[^>]*>(.*?)(?:</\1>|$)", 2)).otherwise(beside)

    def pair(part: Column) -> Column:
        inner = once(F.regexp_extract(part, BESIDE, 1), inside)
        return F.struct(F.lower(F.regexp_replace(_plain(F.regexp_extract(part, r"(?is)^[^>]*>(.*?)</strong>", 1)), r"\s*:$", "")).alias("k"), _plain(inner).alias("v"))

    return F.transform(parts, pair)


def detail_records(pages: DataFrame, host: str) -> DataFrame:
    """A row for each row of pages (page_id, html): its fields, errors and, where there are none, the listing (record).

    Of a label that comes twice the first with a value counts. A page saved from the source view is unwrapped. A null or
    empty page and a check page have one error and no fields. The number on the page and the one of its canonical
    address must be equal, and the address must be on the host. A page of movables is read, but makes no listing.
    Dates are UTC instants of 2015 to 2100. Other columns are ignored, repeated rows kept.
    """
    read = pages.select("page_id", unwrap_source(F.coalesce("html", F.lit(""))).alias("html"))
    listed = r'(?is)<a\b[^>]*class="[^"]*text-dark fw-bold[^"]*"[^>]*>(.*?)</a>'
    head = F.concat_ws(" ", _found(F.col("html"), r"(?is)<title\b[^>]*>(.*?)</title>"), F.substring(_plain(F.regexp_replace("html", r"(?is)^.*?<body\b[^>]*>", "")), 1, 600))
    own = F.nullif(F.regexp_extract(_plain(F.regexp_extract("html", listed, 1)), r"(?i)auction id\s*:?\s*#?\s*(\d+)", 1), F.lit(""))
    # a page with a number is no check page, so its words need not be read for that
    state = F.when(F.trim("html") == "", "empty").when(F.col("own_id").isNull(), F.when(head.rlike(CHECK_PAGE), "check").otherwise("page")).otherwise("page")
    read = read.withColumn("own_id", own).select("page_id", state.alias("page"), "html", "own_id")
    read = read.withColumn("html", F.when(F.col("page") == "page", F.col("html")).otherwise(""))

    href = F.nullif(F.regexp_extract("html", r"""(?i)<link\b[^>]*rel=["']canonical["'][^>]*href=["']([^"']*)["']""", 1), F.lit(""))
    notices = F.transform(F.regexp_extract_all("html", F.lit(r'(?is)<li\b[^>]*\bid="notice[^>]*>.*?</li>'), F.lit(0)), lambda x: F.regexp_extract(x, r'(?i)<a\b[^>]*href="(https://[^"]+)"', 1))
    values = F.filter(labelled_values(F.col("html")), lambda p: p["v"] != "")
    read = read.withColumn("href", href).select(
        "page_id", "page", "own_id", absolute_url(F.col("href"), F.lit(f"https://www.{host}/")).alias("address"), _found(F.col("html"), r"(?is)<h1\b[^>]*>(.*?)</h1>").alias("source_title"),
        _found(F.col("html"), r"(?is)<h5\b[^>]*>[^<]*Description[^<]*</h5>.*?<p\b[^>]*>(.*?)</p>").alias("description"), F.filter(notices, lambda x: x != "").alias("notices"), values.alias("found"),
        F.col("html").rlike(r"(?i)<strong\b[^>]*>\s*contact details").alias("has_contact"),
    )
    read = read.withColumn("told", F.map_from_entries(first_of_each(F.col("found"), lambda p: p["k"])))
    get = lambda labels: F.coalesce(*[F.try_element_at("told", F.lit(k)) for k in labels])
    read = read.select("*", *[get(labels).alias(name) for name, labels in LABELS.items()]).drop("found", "told")

    when = lambda c: F.when(F.col(c).rlike(r"^\d+-\d+-\d+\s+(0?[1-9]|1[0-2]):"), in_range(indian_date_time(F.col(c)), 2015))
    site = F.regexp_replace(F.lower(F.regexp_extract("address", r"(?i)^https?://([^/?#:]+)", 1)), r"^www\.", "")
    number = F.nullif(F.regexp_extract("address", r"(?i)^https?://[^/?#]+/properties/(\d+)/?(?:[?#].*)?$", 1), F.lit(""))
    pin = r"(?i)pin\s*code\s*[-:]?\s*(\d{3})\s?(\d{3})\b"
    read = read.select(
        "*", F.when(site == host, number).alias("address_id"), site.alias("site"), clean_money(F.col("reserve_text")).alias("reserve_price"), clean_money(F.col("emd_text")).alias("emd"),
        when("start_text").alias("auction_start"), when("end_text").alias("auction_end"), when("deadline_text").alias("application_deadline"),
        F.nullif(F.concat(F.regexp_extract("description", pin, 1), F.regexp_extract("description", pin, 2)), F.lit("")).alias("pincode"), site_kind(F.col("property_type"), F.col("site_category")).alias("category"),
    )
    c = F.col
    sound = c("page") == "page"
    rules = {
        "empty page": c("page") == "empty",
        "check page": c("page") == "check",
        "no canonical address": sound & c("address").isNull(),
        "canonical address on another host": sound & (c("site") != host),
        "canonical address of no property": sound & (c("site") == host) & c("address_id").isNull(),
        "no number": sound & c("own_id").isNull(),
        "number of another property": c("own_id") != c("address_id"),
        "unreadable reserve price": c("reserve_text").isNotNull() & c("reserve_price").isNull(),
        "no reserve price": sound & c("reserve_price").isNull(),
        "unreadable auction start": c("start_text").isNotNull() & c("auction_start").isNull(),
        "no place": sound & c("city").isNull() & c("area").isNull(),
        "no type or title": sound & c("property_type").isNull() & c("source_title").isNull(),
    }
    errors = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    read = read.withColumn("errors", errors)
    excluded = (F.size("errors") == 0) & (c("category") == "EXCLUDED")
    read = read.withColumn("errors", F.when(excluded, F.array(F.lit("no real estate"))).otherwise(c("errors")))
    place = F.concat_ws(", ", "area", "city")
    documents = F.transform("notices", lambda u, i: F.struct(F.lit("SALE_NOTICE").alias("type"), F.concat(F.lit("Sale Notice "), (i + 1).cast("string")).alias("title"), u.alias("url")))
    record = F.struct(
        F.concat(F.coalesce("property_type", F.lit("Property")), F.lit(" for sale in "), place).alias("title"), "bank", "branch", "category", place.alias("location"), c("state").alias("geo_state"),
        canon_city(c("city")).alias("geo_city"), title_case(F.regexp_replace("area", r"[.,;]+$", "")).alias("geo_locality"), F.substring("description", 1, 1500).alias("description"), "reserve_price", "emd",
        "auction_start", "auction_end", "application_deadline", "auction_type", F.lit("E-Auction").alias("auction_method"), c("property_type").alias("source_property_type"), "borrower",
        F.concat(F.lit(f"src:{host}:"), "own_id").alias("external_id"), F.concat(F.lit(f"https://www.{host}/properties/"), "address_id").alias("source_url"), c("own_id").alias("notice_number"), documents.alias("documents"),
    )
    out = read.withColumn("record", F.when(F.size("errors") == 0, record))
    return out.drop("page", "address", "site", *TYPED).withColumnRenamed("own_id", "auction_id").withColumnRenamed("address_id", "canonical_id")
