"""Property pages as a browser lays them out: labels and values of tables, definition lists and lines, read into typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import clean_money
from ..functions.text import collapse, first_of_each, html_text

#: The labels of each field, as such pages write them.
LABELS = {
    "auction_id": r"^auction id$",
    "bank_property_id": r"^bank property id$",
    "property_id": r"^property id$",
    "auction_start": r"^auction start( date)?( & time)?$",
    "auction_end": r"^auction end( date)?( & time)?$",
    "emd": r"^emd( amount)?$",
    "emd_deadline": r"^emd end( date)?( & time)?$",
    "reserve_price": r"^(reserve|upset|base) price( \(.*\))?$",
    "minimum_increment": r"^(bid|minimum bid) increment|^incremental amount$",
    "officer_name": r"^(authori[sz]ed )?officer'?s? name$",
    "officer_phone": r"^(officer'?s? )?(phone|mobile|contact)( no\.?| number)?$",
    "officer_email": r"^(officer'?s? )?e-?mail( id)?$",
    "borrower": r"^borrower'?s?( name)?$|^name of (the )?borrower$",
    "bank": r"^(bank|bank name|secured creditor)$",
    "branch": r"^(branch|branch name)$",
    "address": r"^(property )?address$",
    "city": r"^city$",
    "district": r"^district$",
    "state": r"^state$",
    "pincode": r"^pin ?code$",
    "possession": r"^possession( type| status)?$",
    "inspection": r"^(property )?inspection( date)?( & time)?$",
}
#: Lines that open another section, so that no label's value is among them; values that say nothing.
SECTION = r"(?i)^(property detail|auction detail|owner details|bank detail|view auction|contact us|image|other links|about .*|terms & conditions|privacy policy|disclaimer|help|faq|user manual|property summary|ownership type|title deed type)$"
NOTHING = r"(?i)^(n\/?a|na|-|--|not available|null|none)$"
#: Kinds by words of the type line and the heading, the first that is found; documents of the site itself.
KINDS = {
    "AGRICULTURAL": r"(?i)agricultur|farm",
    "INDUSTRIAL": r"(?i)industri|factory|warehouse",
    "COMMERCIAL": r"(?i)commercial|shop|office|showroom",
    "LAND_PLOT": r"(?i)plot|land",
    "RESIDENTIAL": r"(?i)residential|flat|house|villa|apartment|bungalow",
}
SITE_DOCUMENT = r"(?i)client-document|user[-_ ]?manual|faq|privacy|terms"
TYPE_LINE = r"(?i)^[a-z /&-]{3,40},\s*(residential|commercial|industrial|agricultural|land|plot)\b"

INLINE = r"^([A-Za-z][A-Za-z '&./()-]{2,40}?)\s*:\s*(.+)$"
TEXTS = ("bank", "branch", "borrower", "address", "city", "district", "state", "possession", "inspection", "officer_name", "officer_email")
AMOUNTS = ("reserve_price", "emd", "minimum_increment")
TIMES = ("auction_start", "auction_end", "emd_deadline")


def field_of(label: Column) -> Column:
    """The field that a label names; null where it names none."""
    # most lines are no labels: one pattern tells, and the fields are tried only for the others
    any_ = "(?i)" + "|".join(f"(?:{rx})" for rx in LABELS.values())
    return F.when(label.rlike(any_), F.coalesce(*[F.when(label.rlike("(?i)" + rx), F.lit(name)) for name, rx in LABELS.items()]))


def page_time(c: Column) -> Column:
    """The first date of a text as Indian wall time: day-month-year with an optional time and am or pm, else an ISO date; 11:00 without a time."""
    daily = r"(?i)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[ ,T]+(\d{1,2}):(\d{2})(?::\d{2})?\s*(am|pm)?)?"
    iso = r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2}))?"
    d = [F.regexp_extract(c, daily, k) for k in range(1, 7)]
    i = [F.regexp_extract(c, iso, k) for k in range(1, 6)]
    number = lambda x: x.try_cast("int")
    half = F.lower(d[5])
    hour = F.when(half == "pm", F.when(number(d[3]) < 12, number(d[3]) + 12).otherwise(number(d[3]))).when((half == "am") & (number(d[3]) == 12), 0).otherwise(number(d[3]))
    made = lambda y, m, day, h, n: F.try_make_timestamp_ntz(number(y), number(m), number(day), F.coalesce(h, F.lit(11)), F.coalesce(number(n), F.lit(0)), F.lit(0))
    return F.when(c.rlike(daily), made(d[2], d[1], d[0], hour, d[4])).otherwise(made(i[0], i[1], i[2], number(i[3]), i[4]))


def absolute_url(href: Column, base: Column) -> Column:
    """href as seen from the page at base; no steps up."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.concat(origin, F.regexp_extract(F.regexp_replace(base, r"^https?://[^/?#]+|[?#].*$", ""), r"^(.*/)?", 0))
    return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, F.when(folder == origin, "/").otherwise(""), href))


def _plain(html: Column) -> Column:
    return collapse(F.regexp_replace(html, "<[^>]*>", " "))


def _pair(label: Column, value: Column) -> Column:
    return F.struct(F.regexp_replace(label, r"\s*:$", "").alias("label"), value.alias("value"))


def _markup_pairs(html: Column) -> Column:
    """The pairs of table rows that have two cells, then those of definition lists."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.filter(F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1))), lambda c: F.size(c) == 2)
    tables = F.transform(cells, lambda c: _pair(_plain(c[0]), _plain(c[1])))
    terms = F.regexp_extract_all(html, F.lit(r"(?is)<dt\b[^>]*>.*?</dt>\s*<dd\b[^>]*>.*?</dd>"), F.lit(0))
    lists = F.transform(terms, lambda t: _pair(_plain(F.regexp_extract(t, r"(?is)^<dt\b[^>]*>(.*?)</dt>", 1)), _plain(F.regexp_extract(t, r"(?is)<dd\b[^>]*>(.*?)</dd>$", 1))))
    return F.filter(F.concat(tables, lists), lambda p: (p["label"] != "") & (p["value"] != ""))


def _line_pairs(lines: Column) -> Column:
    """The pairs of the lines: "Label: value", a field's label before a line that is neither label nor section, "Property ID value"."""

    def of(x: Column, i: Column) -> Column:
        after = F.get(lines, i + 1)
        inline = F.when(x["text"].rlike(INLINE), _pair(F.regexp_extract(x["text"], INLINE, 1), F.trim(F.regexp_extract(x["text"], INLINE, 2))))
        above = F.when(x["field"].isNotNull() & after["field"].isNull() & ~after["stop"], _pair(x["text"], after["text"]))
        own = F.nullif(F.regexp_extract(x["text"], r"(?i)^property id\s+(\S+)$", 1), F.lit(""))
        return F.array_compact(F.array(inline, above, F.when(own.isNotNull(), _pair(F.lit("Property ID"), own))))

    return F.flatten(F.transform(lines, of))


def rendered_records(pages: DataFrame) -> DataFrame:
    """A record for each row of pages (page_id, url, html, text): its labelled values, typed, and which needed ones are missing.

    text is the page as a browser shows it; where it is null, it is made of the html. Of a field that comes twice the
    first mention counts, in tables, then definition lists, then lines; one that says nothing ("N/A") makes it null.
    Amounts that are not positive and dates that do not exist are null. A page without html and text is a row whose
    fields are all missing. Other columns are ignored, repeated rows kept.
    """
    html = F.coalesce("html", F.lit(""))
    shown = F.filter(F.transform(F.split(F.coalesce("text", html_text(html)), "\n"), collapse), lambda x: x != "")
    # the label is a value of its own, so that it is made once and not for each pattern
    labels = F.transform(shown, lambda x: F.struct(x.alias("text"), F.regexp_replace(x, ":$", "").alias("label")))
    lines = F.transform(labels, lambda x: F.struct(x["text"].alias("text"), field_of(x["label"]).alias("field"), x["label"].rlike(SECTION).alias("stop")))
    read = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), lines.alias("lines"))
    pairs = read.select("*", F.concat(_markup_pairs(F.col("html")), _line_pairs(F.col("lines"))).alias("pairs"))
    named = F.filter(F.transform("pairs", lambda p: F.struct(field_of(p["label"]).alias("k"), p["value"].alias("v"))), lambda p: p["k"].isNotNull())
    known = pairs.select("page_id", "url", "html", F.transform("lines", lambda x: x["text"]).alias("lines"), named.alias("named"))
    firsts = F.map_from_entries(first_of_each(F.col("named"), lambda p: p["k"]))
    told = F.map_filter(firsts, lambda _, v: ~v.rlike(NOTHING))
    known = known.select("page_id", "url", "html", "lines", told.alias("told"))

    get = lambda k: F.try_element_at(F.col("told"), F.lit(k))
    headings = F.concat(F.array(_plain(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))), F.filter("lines", lambda x: x.rlike(r"(?i)\bfor sale in\b") & x.rlike(r"\b(for sale|in)\b.*\b[A-Z]")))
    title = F.get(F.filter(headings, lambda x: F.length(x) >= 8), F.lit(0))
    type_line = F.get(F.filter("lines", lambda x: x.rlike(TYPE_LINE)), F.lit(0))
    known = known.select("*", title.alias("title"), type_line.alias("type_line"))

    by = F.concat_ws(" ", "type_line", "title")
    point = r"(?i)latitude and longitude\s*(-?\d{1,2}\.\d+)\s*[,\s]\s*(-?\d{1,3}\.\d+)"
    place = F.concat_ws("\n", "html", F.array_join("lines", "\n"))
    anchors = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*href="[^"]+"[^>]*>.*?</a>'), F.lit(0))
    links = F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, r'(?i)href="([^"]+)"', 1).alias("href"), _plain(a).alias("name")))
    links = F.filter(links, lambda a: a["href"].rlike(r"(?i)\.(pdf|docx?)(\?|$)") & ~F.concat_ws(" ", a["href"], a["name"]).rlike(SITE_DOCUMENT))
    documents = F.slice(F.transform(links, lambda a: F.struct(F.coalesce(F.nullif(F.substring(a["name"], 1, 100), F.lit("")), F.lit("Notice")).alias("title"), absolute_url(a["href"], F.col("url")).alias("url"))), 1, 12)
    record = known.select(
        "page_id", "url", F.coalesce(get("bank_property_id"), get("property_id")).alias("property_id"),
        F.coalesce(get("auction_id"), F.nullif(F.regexp_extract("url", r"/auction-detail/(\d+)", 1), F.lit(""))).alias("auction_id"),
        "title", F.trim(F.split_part("type_line", F.lit(","), F.lit(1))).alias("property_type"),
        F.coalesce(*[F.when(by.rlike(rx), F.lit(kind)) for kind, rx in KINDS.items()]).alias("category"),
        *[get(k).alias(k) for k in TEXTS], F.nullif(F.substring(F.regexp_replace(get("pincode"), r"\D", ""), 1, 6), F.lit("")).alias("pincode"),
        F.nullif(F.trim(F.regexp_replace(get("officer_phone"), r"[^\d+, /-]", "")), F.lit("")).alias("officer_phone"),
        *[clean_money(get(k)).alias(k) for k in AMOUNTS], *[page_time(get(k)).alias(k) for k in TIMES],
        *[F.regexp_extract(place, point, k).try_cast("double").alias(name) for k, name in ((1, "latitude"), (2, "longitude"))], documents.alias("documents"),
    )
    needed = {
        "property_id_missing": F.coalesce("property_id", "auction_id"), "title_missing": F.col("title"), "address_missing": F.coalesce("address", "city"),
        "reserve_price_missing": F.col("reserve_price"), "auction_date_missing": F.col("auction_start"), "bank_missing": F.col("bank"), "borrower_name_missing": F.col("borrower"),
    }
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in needed.items()]))
    usable = F.col("title").isNotNull() & F.col("reserve_price").isNotNull() & F.coalesce("address", "city").isNotNull() & F.col("bank").isNotNull()
    return record.select("*", missing.alias("missing"), usable.alias("usable"))
