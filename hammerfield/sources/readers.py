"""Readers of listing sources: delimited text, JSON exports, JSON lines, sitemaps, robots rules, pages, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with line breaks and doubled quotes in cells; names lower-cased and trimmed; blank rows dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False)
    df = df.toDF(*[c.strip().lower().lstrip("﻿") for c in df.columns])
    filled = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "" for c in df.columns]
    some = filled[0]
    for x in filled[1:]:
        some = some | x
    return df.filter(some)


def import_table(df: DataFrame, order: str, required: str = "title", most: int = 500) -> DataFrame:
    """The first rows of a table, by a column of their order, that has the required column; the limit is the import's own."""
    names = {c.strip().lower(): c for c in df.columns}
    if required not in names:
        raise ValueError(f"column {required} is missing")
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()]).orderBy(order).limit(most)


LISTS = ("records", "data", "items", "results", "properties", "listings")


def export_records(body: Column) -> Column:
    """The list of a JSON export: the document itself, or what stands under one of the usual names, as texts."""
    whole = F.from_json(body, "array<string>")
    named = [F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>") for k in LISTS]
    return F.coalesce(F.when(F.ltrim(body).startswith("["), whole), *named)


def export_total(body: Column) -> Column:
    return F.coalesce(*[F.get_json_object(body, f"$.{k}").try_cast("long") for k in ("total", "totalRecords", "total_records", "count")])


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """The records of the lines of a column value and, in broken, which lines are no JSON; blank lines are no lines."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*").withColumn("broken", F.col("_corrupt").isNotNull()).drop("_corrupt")


def enabled_rules(body: Column) -> Column:
    """The rules of a text, one a line: those of a JSON array (text, on) that are on, or the lines without their bullets."""
    listed = F.from_json(body, "array<struct<text:string,on:boolean>>")
    on = F.transform(F.filter(listed, lambda r: F.coalesce(r["on"], F.lit(True)) & r["text"].isNotNull()), lambda r: F.trim(r["text"]))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s*-]+", ""))), lambda x: x != "")
    return F.coalesce(F.array_join(F.when(F.ltrim(body).startswith("["), on).otherwise(lines), "\n"), F.lit(""))


def wrap_source(html: Column) -> Column:
    """A page as a browser saves its source view: each line in a table cell, marks escaped."""
    escaped = F.replace(F.replace(F.replace(html, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit('<td class="line-content">'), x, F.lit("</td>")))
    return F.concat(F.lit('<html><body class="view-source"><table>'), F.array_join(cells, ""), F.lit("</table></body></html>"))


def unwrap_source(html: Column) -> Column:
    """The page that a saved source view shows; any other page as it is."""
    cells = F.regexp_extract_all(html, F.lit(r'(?s)<td class="line-content">(.*?)</td>'), F.lit(1))
    inner = F.regexp_replace(F.array_join(cells, "\n"), r"<[^>]*>", "")
    plain = F.replace(F.replace(F.replace(inner, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.when(F.size(cells) > 0, plain).otherwise(html)


def names_any(html: Column, words: list[str]) -> Column:
    """Whether the heading or the title of a page has one of the words."""
    heading = F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", " ")
    return F.concat_ws(" ", heading, F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).rlike(r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")([^\p{L}\p{N}_]|$)")


#: Endings of document files, and what a link to a notice says.
DOCUMENT_FILE = r"(?i)\.(pdf|docx?|xlsx?|zip|csv)(\?.*)?$"
NOTICE_TEXT = r"(?i)(sale notice|auction notice|possession notice|e-?auction notice|tender document|terms and conditions|bid form"


def notice_links(html: Column, also: str = "", most: int = 1000) -> Column:
    """array of struct(href, kind) of a page's links to documents: by the ending of the file, or by what the link says."""
    anchors = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="[^"]+"[^>]*>.*?</a>'), F.lit(0))

    def link(a: Column) -> Column:
        href = F.regexp_extract(a, r'(?i)href="([^"]+)"', 1)
        text = F.regexp_replace(F.regexp_extract(a, r"(?is)>(.*)</a>", 1), "<[^>]*>", "")
        kind = F.when(href.rlike(DOCUMENT_FILE), "file").when(text.rlike(NOTICE_TEXT + (f"|{also})" if also else ")")), "named")
        return F.struct(href.alias("href"), kind.alias("kind"))

    return F.slice(F.filter(F.transform(anchors, link), lambda x: x["kind"].isNotNull()), 1, most)


def sitemap_urls(xml: Column, part: str = "/auction/") -> Column:
    return F.filter(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1), lambda u: u.contains(part))


RULE = "struct<agent:string,allow:boolean,pattern:string>"


def robots_rules(body: Column) -> Column:
    """array of (agent, allow, pattern) of a robots.txt; blank patterns allow everything and are left out.

    Agents named one after another share the rules that follow; a rule ends the naming.
    """
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("ruled"), F.array().cast(f"array<{RULE}>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        plain = F.regexp_replace(line, "#.*$", "")
        key, value = F.lower(F.trim(F.split_part(plain, F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace(plain, "^[^:]*:?", ""))
        agents = F.when(key != "user-agent", acc["agents"]).when(acc["ruled"], F.array(F.lower(value))).otherwise(F.array_append(acc["agents"], F.lower(value)))
        rule = key.isin("allow", "disallow")
        made = F.transform(acc["agents"], lambda a: F.struct(a.alias("agent"), (key == "allow").alias("allow"), value.alias("pattern")))
        ruled = F.when(rule, True).when(key == "user-agent", False).otherwise(acc["ruled"])
        return F.struct(agents.alias("agents"), ruled.alias("ruled"), F.when(rule & (value != ""), F.concat(acc["out"], made)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(body, r"\r?\n"), start, step, lambda acc: acc["out"])


def robots_decision(paths: DataFrame, body: str, agent: str) -> DataFrame:
    """url_path, allowed, by the robots.txt of one host: the agent's own group, else that of *; the longest matching
    pattern decides, and Allow wins a tie. The rules of a file (500 KB at most are read) are one row for all paths."""
    rules = paths.sparkSession.createDataFrame([(body[:500_000],)], "body string").select(robots_rules(F.col("body")).alias("rules"))
    own = F.filter("rules", lambda r: r["agent"] == agent.lower())
    used = F.when(F.size(own) > 0, own).otherwise(F.filter("rules", lambda r: r["agent"] == "*"))
    escaped = lambda r: F.regexp_replace(F.regexp_replace(r["pattern"], r"([.?+^\[\](){}|\\])", r"\\$1"), r"\*", ".*")
    ready = F.transform(used, lambda r: F.struct(F.length(r["pattern"]).alias("size"), r["allow"].alias("allow"), F.concat(F.lit("^"), escaped(r)).alias("rx")))
    joined = paths.join(F.broadcast(rules.select(ready.alias("rules"))))
    best = F.array_max(F.filter("rules", lambda r: F.regexp_like("url_path", r["rx"])))
    return joined.select("url_path", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def page_pairs(html: Column) -> Column:
    """map of label to value, from the two-cell rows of a page's tables."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)

    def cell(row: Column, k: int) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1)
        return F.trim(F.regexp_replace(F.coalesce(F.try_element_at(cells, F.lit(k)), F.lit("")), r"(?:<[^>]*>|\s)+", " "))

    pairs = F.transform(rows, lambda r: F.struct(F.lower(F.regexp_replace(cell(r, 1), r"[:\s]+$", "")).alias("k"), cell(r, 2).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    firsts = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(firsts)


def page_links(html: Column, most: int = 40) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*href="([^"]+)"'), 1)), 1, most)


def next_link(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'(?i)<a\b[^>]*rel="next"[^>]*href="([^"]+)"', 1), F.lit(""))


def text_chunks(texts: DataFrame, most: int = 12_000) -> DataFrame:
    """doc, n, chunk: whole texts packed into chunks of at most `most` characters, cut at line breaks where there are any."""
    lines = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    cuts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda k: F.substring(x, k * most + 1, F.lit(most)))
    pieces = F.flatten(F.transform(lines, cuts))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc: Column, piece: Column) -> Column:
        full = (F.length(acc["held"]) > 0) & (F.length(acc["held"]) + F.length(piece) > most)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["held"])).otherwise(acc["done"]).alias("done"), F.when(full, piece).otherwise(F.concat(acc["held"], piece)).alias("held"))

    chunks = F.aggregate(pieces, start, step, lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["held"])))
    return texts.select("doc", F.posexplode(chunks).alias("n", "chunk"))


def card_list(html: Column) -> Column:
    """struct(cards, total, next) of a list page: cards of id, title, city and price, the headline total, the next address."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)<div class="card">(.*?)</div>'), F.lit(1))
    part = lambda b, p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(b, p, 1), "<[^>]*>", "")), F.lit(""))

    def card(b: Column) -> Column:
        return F.struct(
            part(b, r'href="[^"]*/([0-9]+)"').try_cast("long").alias("id"), part(b, r"(?s)<a\b[^>]*>(.*?)</a>").alias("title"),
            part(b, r'(?s)<span class="city">(.*?)</span>').alias("city"), part(b, r'(?s)<span class="price">(.*?)</span>').alias("price"),
        )

    whole = F.filter(F.transform(blocks, card), lambda c: c["id"].isNotNull() & c["city"].isNotNull() & c["price"].isNotNull())
    total = F.replace(F.regexp_extract(html, r"(?i)([0-9][0-9,]*)\s+(?:results|properties|auctions)\b", 1), F.lit(","), F.lit("")).try_cast("long")
    return F.struct(whole.alias("cards"), total.alias("total"), next_link(html).alias("next"))


def last_page(html: Column) -> Column:
    """The number of the last page that a list links to by a link named so; null without one."""
    return F.nullif(F.regexp_extract(html, r'(?i)<a\b[^>]*href="[^"]*?[?&]page=(\d+)[^"]*"[^>]*>\s*last\b', 1), F.lit("")).try_cast("int")


def detail_record(html: Column, page_id: Column) -> Column:
    """struct(bank, price, start, errors) of a detail page: its label table, checked, and its canonical address against the id."""
    pairs = page_pairs(html)
    get = lambda name: F.nullif(F.trim(F.try_element_at(pairs, F.lit(name))), F.lit(""))
    canonical = F.regexp_extract(html, r'(?i)<link rel="canonical" href="[^"]*?([0-9]+)"', 1).try_cast("long")
    price = F.regexp_replace(get("reserve price"), "[^0-9.]", "").try_cast("double")
    start = F.try_to_timestamp(get("auction start"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    rules = {
        "no canonical address": canonical.isNull(),
        "canonical address of another": canonical != page_id,
        "no bank": get("bank").isNull(),
        "no price": price.isNull() | (price <= 0),
        "no start": start.isNull(),
    }
    errors = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return F.struct(get("bank").alias("bank"), price.alias("price"), start.alias("start"), errors.alias("errors"))


def label_lines(text: Column) -> Column:
    """map of label to value of a rendered text: "Label: value" on a line, or a label's line and its value on the next.

    Labels are lower-cased; of a label that comes twice the first counts.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pair = F.transform(
        lines,
        lambda x, i: F.when(x.rlike(r"^[^:]{2,40}:\s*\S"), F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))).when(
            x.rlike("^[^:]{2,40}:$"), F.struct(F.lower(F.trim(F.replace(x, F.lit(":"), F.lit("")))).alias("k"), F.get(lines, i + 1).alias("v"))
        ),
    )
    kept = F.filter(pair, lambda p: p.isNotNull() & p["v"].isNotNull())
    keys = F.transform(kept, lambda p: p["k"])
    return F.map_from_entries(F.filter(kept, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def raw_record(raw: Column) -> Column:
    """map of label to value of a workbook cell in any of its three shapes: a markdown table, JSON with fields, card text."""
    rows = F.regexp_extract_all(raw, F.lit(r"(?m)^\|[^|\n]*\|[^|\n]*\|"), F.lit(0))
    cell = lambda r, k: F.trim(F.get(F.split(r, r"\|"), F.lit(k)))
    table = F.transform(rows, lambda r: F.struct(F.lower(F.regexp_replace(cell(r, 1), r"\s*:$", "")).alias("k"), cell(r, 2).alias("v")))
    table = F.filter(table, lambda p: (p["k"] != "") & (p["v"] != "") & ~p["k"].rlike("^-+$"))
    keys = F.transform(table, lambda p: p["k"])
    table = F.map_from_entries(F.filter(table, lambda p, i: F.array_position(keys, p["k"]) == i + 1))
    fields = F.from_json(F.get_json_object(raw, "$.fields"), "map<string,string>")
    price = F.nullif(F.regexp_extract(raw, r"(?i)reserve price\s*₹?\s*([\d,.]+)", 1), F.lit(""))
    place = F.nullif(F.trim(F.regexp_extract(raw, r"## Property location\s*\n([^\n#]+)", 1)), F.lit(""))
    card = F.map_filter(F.create_map(F.lit("reserve price"), price, F.lit("location"), place), lambda _, x: x.isNotNull())
    return F.when(F.ltrim(raw).startswith("|"), table).when(F.ltrim(raw).startswith("{"), F.transform_keys(fields, lambda k, _: F.lower(k))).otherwise(card)


def sheet_rows(tabs: dict[str, DataFrame], cursors: dict[str, int]) -> DataFrame:
    """The rows of a workbook's tab "Properties" (row, id, title) after its cursor, with the latest row of tab "Auctions" of each id.

    The other tab is a side to be looked up in whole, whatever its own cursor.
    """
    properties = tabs["Properties"].filter(F.col("row") > cursors.get("Properties", 0))
    if "Auctions" not in tabs:
        return properties.withColumns({"price": F.lit(None).cast("double"), "start": F.lit(None).cast("timestamp_ntz")})
    last = tabs["Auctions"].groupBy("id").agg(F.max_by(F.struct("price", "start"), F.struct("start", "row")).alias("a"))
    return properties.join(last, "id", "left").select("row", "id", "title", "a.price", "a.start")
