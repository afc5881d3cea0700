"""Lots of a sale notice given as text: where each lot starts, its labelled values, and how far they can be trusted.

A notice marks its lots in one of several ways. Each way is tried on the notice's lines: its markers are chained to the
longest run of numbers that count up, the run cuts the text into blocks, and the first way with a block that has a price
or an address is taken; a table and a single price come after them. Everything is a column function on the arrays of
lines of one notice, until the blocks become rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import money as M
from ..functions.text import once
from .staging import stage

#: How lots are numbered, in the order in which the ways are tried.
MARKERS = [
    ("marker:lot", r"(?i)^[ \t]*(?:lot|property|item)[ \t]*(?:no\.?|number|#)?[ \t]*[:.\-]?[ \t]*(\d{1,3})\b"),
    ("marker:serial", r"(?i)^[ \t]*(?:sr\.?|s\.?)[ \t]*no\.?[ \t]*[:.\-]?[ \t]*(\d{1,3})\b"),
    ("numbered", r"^[ \t]*(\d{1,3})[ \t]*[.)][ \t]+\S"),
]
#: Labels of fields, words that begin the next field, and what follows the last lot. A label's first letters are
#: looked at before its wordings are tried: most places of a text begin none.
RESERVE = r"(?=[ru][ep])(?:reserve|upset)\s*price"
EMD = r"\b(?:emd|earnest\s*money(?:\s*deposit)?)\b"
AUCTION_DATE = r"(?=[dea])(?:date\s*(?:&|and)?\s*time\s*of\s*(?:the\s*)?(?:e-?\s*)?auction|(?:e-?\s*)?auction\s*date|date\s*of\s*(?:the\s*)?(?:e-?\s*)?(?:auction|sale)|(?:e-?\s*)?auction\s*on)"
ADDRESS = r"(?=[dpals][erdoc])(?:description\s+of\s+(?:the\s+)?(?:immovable\s+|secured\s+)?propert(?:y|ies)|property\s+description|address\s+of\s+(?:the\s+)?propert(?:y|ies)|address|location|schedule\s+of\s+(?:the\s+)?propert(?:y|ies)|details\s+of\s+(?:the\s+)?propert(?:y|ies))\s*[:\-–]?"
STOP = r"(?=[ruedbcilnpo])(?:(?:reserve|upset)\s*price|\bemd\b|earnest|\bdate\b|borrower|contact|inspection|\blot\s*no|name\s*of|possession|outstanding|encumbrance|bid\s*(?:increment|multiplier))"
TRAILER = r"(?i)^[ \t]*(?:terms\s*(?:&|and)\s*conditions|general\s*terms|important\s*(?:notes?|information)|note\s*:|for\s*detailed\s*terms)"
CLAIM = r"(?i)\b(?:total\s*(?:of\s*)?)?(\d{1,3})\s*(?:\(\s*[a-z-]+\s*\)\s*)?(?:properties|lots|assets)\b"
NOTICE_DATE = r"(?i)(?:dated?|notice\s*date)\s*[:\-]?\s*([^\n]{0,40})"
TABLE_HEAD, TABLE_ROW, ROW_AMOUNT = r"(?i)(?:sr|s)\.?\s*no|description|property|date", r"^[ \t]*(\d{1,3})[ \t]+(\S.*)$", r"(?i)(?:rs\.?|₹)?\s*(\d{1,3}(?:,\d{2,3})+)\s*(?:/-)?"
#: Bounds of an amount; shares of confidence of a reserve price, a date of the lot or of the notice, an address and
#: a deposit; what an issue that blocks takes off. An impossible PIN code counts twice. SHORTEST: characters of an address.
LEAST, MOST, LETTERS, SHORTEST = 10_000, 5e10, 120, 15
WEIGHTS = {"reserve": 0.35, "date": 0.25, "notice_date": 0.15, "address": 0.3, "emd": 0.1, "issue": -0.15}
BLOCKING = ["price_inconsistent", "reserve_conflicting", "reserve_implausible", "date_conflicting", "date_invalid", "auction_before_notice", "pincode_invalid"]

def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r" \s+|[\s&&[^ ]]\s*", " "))


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(f"(?i){pattern}"))


def _after(block: Column, label: str, most: int) -> Column:
    """What follows each place of a label, up to `most` characters or the next field's label."""
    rests = F.regexp_extract_all(block, F.lit(rf"(?i){label}(?=([\s\S]{{0,{most}}}))"), F.lit(1))
    return F.transform(rests, lambda r: F.regexp_extract(r, rf"(?is)^[\s:\-–.=|]*+.*?(?={STOP}|\z)", 0))


def _one(values: Column, name: str, bad: Column | None = None) -> tuple[Column, Column]:
    """The value that all places agree on, and the issue where there is none or they differ."""
    distinct = F.array_distinct(values)
    agreed = F.when(F.size(distinct) == 1, distinct[0])
    issue = F.when(F.size(distinct) == 0, F.lit(f"{name}_missing") if bad is None else F.when(bad, f"{name}_invalid").otherwise(f"{name}_missing")).when(F.size(distinct) > 1, f"{name}_conflicting")
    return agreed, issue


def _amounts(block: Column, label: str) -> Column:
    return F.array_compact(F.transform(_after(block, label, 80), M.notice_amount))


def _amount(found: Column, name: str) -> tuple[Column, Column]:
    value, issue = _one(found, name)
    plausible = value.between(LEAST, F.lit(MOST))
    return F.when(plausible, value), F.coalesce(issue, F.when(~plausible, f"{name}_implausible"))


def _dates(text: Column) -> Column:
    return F.array_compact(F.transform(_after(text, AUCTION_DATE, 80), D.notice_date))


def _valid(dates: Column) -> Column:
    return F.filter(dates, lambda d: d != "invalid")


def chain(marks: Column) -> Column:
    """The longest run numbered n, n + 1, n + 2 ... of an array of marks (struct with n), those between them passed over.

    Of equally long runs the first counts. One pass from the end tells how far each mark's run goes, by the length at the
    nearest later mark of the next number; one pass from the start picks its marks.
    """
    start = F.struct(F.create_map(F.lit(-1), F.lit(0)).alias("at"), F.lit(0).alias("best"), F.lit(-1).alias("place"), (F.size(marks) - 1).alias("i"))

    def back(acc: Column, m: Column) -> Column:
        run = F.coalesce(F.try_element_at(acc["at"], m["n"] + 1), F.lit(0)) + 1
        at = F.map_concat(F.map_filter(acc["at"], lambda k, _: k != m["n"]), F.create_map(m["n"], run))
        better = run >= acc["best"]
        return F.struct(at.alias("at"), F.when(better, run).otherwise(acc["best"]).alias("best"), F.when(better, acc["i"]).otherwise(acc["place"]).alias("place"), (acc["i"] - 1).alias("i"))

    # the first place is part of the state, so it is found once
    first = F.aggregate(F.reverse(marks), start, back, lambda acc: acc["place"])
    none = F.filter(marks, lambda m: F.lit(False))
    walk = F.struct(none.alias("run"), F.lit(None).cast("int").alias("want"), F.lit(0).alias("i"), first.alias("first"))

    def on(acc: Column, m: Column) -> Column:
        takes = F.coalesce((acc["i"] == acc["first"]) | (m["n"] == acc["want"]), F.lit(False))
        return F.struct(F.when(takes, F.array_append(acc["run"], m)).otherwise(acc["run"]).alias("run"), F.when(takes, m["n"] + 1).otherwise(acc["want"]).alias("want"), (acc["i"] + 1).alias("i"), acc["first"].alias("first"))

    return F.aggregate(marks, walk, on, lambda acc: acc["run"])


def _marks(lines: Column, pattern: str) -> Column:
    """The lines that a marker starts: array of struct(line, n)."""
    # few lines are marks: only those are taken apart
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1).cast("int")).alias("n")))
    return F.filter(marked, lambda m: m["n"].isNotNull())


def _blocks(lines: Column, run: Column) -> Column:
    """array of struct(num, text): from each mark of the run to the next; the last ends at what follows the lots."""
    ends = F.concat(F.transform(F.slice(run, 2, F.size(run)), lambda m: m["line"]), F.array(F.size(lines)))

    def block(m: Column, end: Column) -> Column:
        body = F.slice(lines, m["line"] + 1, end - m["line"])
        stop = F.when(end == F.size(lines), F.array_position(F.transform(body, lambda x: x.rlike(TRAILER)), True)).otherwise(0)
        body = F.when(stop > 0, F.slice(body, 1, (stop - 1).cast("int"))).otherwise(body)
        return F.struct(m["n"].cast("string").alias("num"), F.array_join(body, "\n").alias("text"))

    return F.when(F.size(run) > 0, F.zip_with(run, ends, block))


def _signal(text: Column) -> Column:
    return _has(text, RESERVE) | _has(text, ADDRESS)


def _table(lines: Column) -> tuple[Column, Column]:
    """Rows of the table after the first line that names the money columns (struct(num, text)), and the order of those columns."""
    head = F.array_position(F.transform(lines, lambda x: x.rlike(f"(?i){RESERVE}") & x.rlike(TABLE_HEAD)), True).cast("int")
    line = F.get(lines, head - 1)
    place = lambda p: F.length(F.regexp_extract(line, rf"(?i)^(.*?){p}", 1))
    has_emd = line.rlike(r"(?i)\b(?:emd|earnest\s*money)")
    order = F.when(~has_emd, F.array(F.lit("reserve"))).when(place(r"\b(?:emd|earnest\s*money)") < place(RESERVE), F.array(F.lit("emd"), F.lit("reserve"))).otherwise(F.array(F.lit("reserve"), F.lit("emd")))
    rest = F.when(head > 0, F.slice(lines, head + 1, F.size(lines)))
    state = F.struct(F.array().cast("array<struct<num:string,text:string>>").alias("rows"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["rows"])
        numbered = F.coalesce(F.when(x.rlike(TABLE_ROW), F.regexp_extract(x, TABLE_ROW, 1).cast("int")) == n + 1, F.lit(False))
        return once(numbered & ~acc["over"], lambda starts: taken(acc, x, n, starts))

    def taken(acc: Column, x: Column, n: Column, starts: Column) -> Column:
        rows = acc["rows"]
        goes_on = ~starts & ~acc["over"] & (n > 0) & ~x.rlike(r"^[ \t]*$")
        ends = goes_on & x.rlike(TRAILER)
        last = F.get(rows, n - 1)
        longer = F.array_append(F.slice(rows, 1, F.greatest(n - 1, F.lit(0))), F.struct(last["num"].alias("num"), F.concat(last["text"], F.lit(" "), F.trim(x)).alias("text")))
        new = F.array_append(rows, F.struct(F.regexp_extract(x, TABLE_ROW, 1).alias("num"), F.regexp_extract(x, TABLE_ROW, 2).alias("text")))
        return F.struct(F.when(starts, new).when(goes_on & ~ends, longer).otherwise(rows).alias("rows"), (acc["over"] | ends).alias("over"))

    return F.when(head > 0, F.aggregate(rest, state, step, lambda acc: acc["rows"])), order


def _labelled(row: Column, order: Column) -> Column:
    """A table's row as a block with labels, so that it is read as any other: amounts by the order of the columns where they line up."""
    found = F.transform(F.regexp_extract_all(row, F.lit(ROW_AMOUNT), F.lit(0)), M.notice_amount)
    return once(found, lambda amounts: once(D.notice_date(row), lambda date: _with_labels(row, order, amounts, date)))


def _with_labels(row: Column, order: Column, amounts: Column, date: Column) -> Column:
    fits = F.size(amounts) == F.size(order)
    value = lambda name: F.when(fits, F.get(amounts, F.array_position(order, name).cast("int") - 1)).cast("string")
    described = _flat(F.regexp_replace(row, r"(?is)(?:rs\.?|₹)?\s*\d{1,3}(?:,\d{2,3})+.*$", ""))
    # what is too short for an address is not made one by the words of the label that follows
    parts = [
        F.when(F.length(described) >= SHORTEST, F.concat(F.lit("Description of Property: "), described)), F.concat(F.lit("Reserve Price: "), value("reserve")), F.concat(F.lit("EMD: "), value("emd")),
        F.when(date != "invalid", F.concat(F.lit("Auction Date: "), F.array_join(F.reverse(F.split(date, "-")), "."))),
    ]
    issues = F.array_compact(F.array(F.when(~fits, "columns_not_aligned"), F.when(date == "invalid", "date_invalid")))
    return F.struct(F.array_join(F.array(*parts), "\n").alias("text"), issues.alias("issues"))


def segment(notices: DataFrame) -> DataFrame:
    """doc, status, strategy, claimed, header_date, notice_date and blocks (num, text, issues, raw) of notices (doc, text).

    status: NEEDS_OCR (hardly any letters), NO_LOTS, AMBIGUOUS (several prices that nothing tells apart), PARTIAL (the
    notice claims more lots than were found) or OK. A null text is empty. Other columns are ignored.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""), r" [ \t\f\x0B]+|[\t\f\x0B][ \t\f\x0B]*", " ")
    rows = notices.select("doc", text.alias("text")).withColumn("lines", F.split("text", "\n"))
    lines = F.col("lines")
    for k, (_, pattern) in enumerate(MARKERS):
        rows = rows.withColumn(f"marks{k}", _marks(lines, pattern))
        rows = rows.withColumn(f"run{k}", chain(F.col(f"marks{k}")))
        least = 2 if MARKERS[k][0] == "numbered" else 1
        cut = F.filter(_blocks(lines, F.col(f"run{k}")), lambda b: _signal(b["text"]))
        rows = rows.withColumn(f"found{k}", F.when(F.size(f"run{k}") >= least, cut))
    table, order = _table(lines)
    rows = rows.withColumns({"table": table, "order": order, "prices": _count(F.col("text"), RESERVE)})
    has = [F.coalesce(F.size(f"found{k}") > 0, F.lit(False)) for k in range(len(MARKERS))]
    in_table = F.coalesce(F.size("table") > 0, F.lit(False))
    scanned = ~F.col("text").rlike(rf"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]){{{LETTERS}}}")
    strategy = F.when(scanned, F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    plain = lambda blocks: F.transform(blocks, lambda b: F.struct(b["num"].alias("num"), b["text"].alias("text"), none.alias("issues"), b["text"].alias("raw")))
    blocks = F.when(scanned, plain(F.array().cast("array<struct<num:string,text:string>>")))
    before = F.when(F.lit(False), F.col("text"))
    for k, (name, _) in enumerate(MARKERS):
        strategy, blocks = strategy.when(has[k], name), blocks.when(has[k], plain(F.col(f"found{k}")))
        before = before.when(has[k], F.array_join(F.slice(lines, 1, F.get(F.col(f"run{k}"), F.lit(0))["line"]), "\n"))

    def row(r: Column) -> Column:
        return once(_labelled(r["text"], F.col("order")), lambda made: F.struct(r["num"].alias("num"), made["text"].alias("text"), made["issues"].alias("issues"), r["text"].alias("raw")))

    strategy = strategy.when(in_table, "table").when(F.col("prices") == 1, "single")
    single = plain(F.array(F.struct(F.lit("1").alias("num"), F.col("text").alias("text"))))
    blocks = blocks.when(in_table, F.transform("table", row)).when(F.col("prices") == 1, single)
    stated = F.array_distinct(_valid(_dates(before.otherwise(F.col("text")))))
    rows = rows.withColumns({"scanned": scanned, "strategy": strategy, "blocks": blocks, "stated": stated})
    claimed = F.regexp_extract(F.substring("text", 1, 1500), CLAIM, 1).try_cast("int")
    claimed = F.when(~F.col("scanned") & claimed.between(1, 500), claimed)
    noticed = D.notice_date(F.regexp_extract(F.substring("text", 1, 600), NOTICE_DATE, 1))
    status = (
        F.when(F.col("scanned"), "NEEDS_OCR")
        .when(F.col("strategy").isNull() & (F.col("prices") > 1), "AMBIGUOUS")
        .when(F.col("strategy").isNull(), "NO_LOTS")
        .when(F.size("blocks") < claimed, "PARTIAL")
        .otherwise("OK")
    )
    out = rows.select("doc", status.alias("status"), "strategy", claimed.alias("claimed"), F.when(F.size("stated") == 1, F.col("stated")[0]).alias("header_date"), F.when(noticed != "invalid", noticed).alias("notice_date"), "blocks")
    # written once: joined with what reads the lots, one plan would cut the texts again for each value
    return stage(out, "notices")


def lots(segmented: DataFrame) -> DataFrame:
    """The lots of segmented notices: doc, strategy, lot, reserve, emd, date, date_source, address, confidence, issues, complete, excerpt.

    A value is what stands between its label and the next one; one that a lot states twice and differently is null, and
    so are both amounts where the deposit is not below the price. A lot without a date takes that of the notice's head.
    A date before the notice's own is none. The confidence is the sum of WEIGHTS, between 0 and 1, in hundredths.
    """
    rows = segmented.select("doc", "strategy", "header_date", "notice_date", F.explode("blocks").alias("b"))
    block = F.col("b.text")
    places = F.filter(F.transform(_after(block, ADDRESS, 420), _flat), lambda a: (F.length(a) >= SHORTEST) & a.rlike("[A-Za-z]{3}"))
    rows = rows.withColumns({"reserves": _amounts(block, RESERVE), "emds": _amounts(block, EMD), "dates": _dates(block), "places": F.transform(places, lambda a: F.struct((-F.length(a)).alias("shorter"), a.alias("a")))})
    reserve, no_reserve = _amount(F.col("reserves"), "reserve")
    emd, no_emd = _amount(F.col("emds"), "emd")
    date, no_date = _one(_valid(F.col("dates")), "date", F.array_contains("dates", "invalid"))
    # the longest, of equally long ones the first
    address = F.get(F.array_sort("places", lambda x, y: x["shorter"] - y["shorter"]), F.lit(0))["a"]
    # any number of six digits may be the PIN code: a plot's or a survey's may stand before it
    no_address = F.when(address.isNull(), "address_missing").when(address.rlike(r"\b0\d{5}\b"), "pincode_invalid")
    rows = rows.select("doc", "strategy", "header_date", "notice_date", "b", reserve.alias("r"), no_reserve.alias("no_r"), emd.alias("e"), no_emd.alias("no_e"), date.alias("d"), no_date.alias("no_d"), address.alias("address"), no_address.alias("no_a"))
    # a filter on what follows stops at a generator: written out down to the patterns it would search a block many times
    rows = rows.select("doc", "strategy", "header_date", "notice_date", "b", F.inline(F.array(F.struct("r", "no_r", "e", "no_e", "d", "no_d", "address", "no_a"))))
    swapped = F.coalesce(F.col("e") >= F.col("r"), F.lit(False))
    from_head = F.coalesce(F.col("d").isNull() & (F.col("no_d") == "date_missing") & F.col("header_date").isNotNull(), F.lit(False))
    date = F.coalesce("d", F.when(from_head, F.col("header_date")))
    early = F.coalesce(date < F.col("notice_date"), F.lit(False))
    rows = rows.withColumns({
        "reserve": F.when(~swapped, F.col("r")), "emd": F.when(~swapped, F.col("e")), "date": F.when(~early, date),
        "date_source": F.when(~early & F.col("d").isNotNull(), "lot").when(~early & from_head, "notice"),
        "own": F.array_distinct(F.array_compact(F.array(F.col("no_r"), F.col("no_e"), F.when(~from_head, F.col("no_d")), F.col("no_a"), F.when(swapped, "price_inconsistent"), F.when(early, "auction_before_notice")))),
    })
    blocking = F.size(F.filter("own", lambda i: i.isin(BLOCKING))) + F.array_contains("own", "pincode_invalid").cast("int")
    share = lambda c, name: F.when(c, WEIGHTS[name]).otherwise(0.0)
    dated = share(F.col("date_source") == "lot", "date") + share(F.col("date_source") == "notice", "notice_date")
    score = share(F.col("reserve").isNotNull(), "reserve") + dated + share(F.col("address").isNotNull(), "address") + share(F.col("emd").isNotNull(), "emd") + F.lit(WEIGHTS["issue"]) * blocking
    whole = F.col("reserve").isNotNull() & F.col("date").isNotNull() & F.col("address").isNotNull() & ~F.array_contains("own", "pincode_invalid")
    return rows.select(
        "doc", "strategy", F.col("b.num").alias("lot"), "reserve", "emd", "date", "date_source", "address", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2))).alias("confidence"),
        F.array_distinct(F.concat("own", "b.issues")).alias("issues"), whole.alias("complete"), F.substring(_flat(F.col("b.raw")), 1, 300).alias("excerpt"),
    )


def document_hash(url: Column) -> Column:
    """A name for a document's address. 256 bits: of the 32 of FNV-1a a million documents use some twice."""
    return F.sha2(url, 256)


def listing_records(found: DataFrame, url: Column, bank: Column, source_hash: Callable[[Column], Column]) -> DataFrame:
    """Records of the complete lots, with an id that stays the same for a document and lot; incomplete lots give none."""
    host = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("pdf")), r"^www\.", "")
    part = lambda n: F.substring("address", 1, n)
    return found.filter("complete").select(
        F.concat(F.lit("Lot "), "lot", F.lit(": "), part(90)).alias("title"), F.coalesce(bank, F.lit("")).alias("bank"), part(200).alias("location"), part(900).alias("legal_schedule"),
        F.col("reserve").cast("string").alias("reserve_price"), F.coalesce(F.col("emd").cast("string"), F.lit("")).alias("emd"), F.col("date").alias("auction_start"), F.lit("E-Auction").alias("auction_method"),
        F.concat(F.lit("src:"), host, F.lit(":pdf-"), source_hash(url), F.lit("-lot"), F.col("lot")).alias("external_id"), url.alias("source_url"),
    )
