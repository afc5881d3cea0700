"""Column functions on text: cleaning, names, urls, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{00A0}]+"
#: The runs of SPACE that are not one blank: most words are parted by one, which need not be written again.
UNEVEN_SPACE = r" [\s\x{00A0}]+|[\s\x{00A0}&&[^ ]][\s\x{00A0}]*"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f names its argument more than once and the value is to be found once."""
    return F.transform(F.array(value), f)[0]


def slugify(c: Column, most: int = 100) -> Column:
    return F.substring(city_slug(c), 1, most)


def city_slug(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(c: Column) -> Column:
    """Upper case after the start, white space or a hyphen; lower case elsewhere."""
    parts = F.split(F.lower(F.trim(c)), r"(?<=[\s-])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNEVEN_SPACE, " "))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of c in a fixed table, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


#: Words that stay small inside a title, and those written in capitals.
SMALL_WORDS = ["of", "in", "at", "the", "and", "for", "to", "on", "a", "an"]
CAPITAL_WORDS = "sbi pnb hdfc icici idbi uco bob boi nh sh rd st bhk rcc mig lig hig ews ii iii iv vi sez gidc midc dlf dda hsr btm cbd".split()


def tidy_case(c: Column) -> Column:
    """A text of mostly capitals (seven letters in ten, of six or more) as a title; any other as it is."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(c, "[^A-Z]", ""))
    parts = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z']*|[^a-z]+"), F.lit(0))

    def written(word: Column, place: Column) -> Column:
        return F.when(word.isin(*CAPITAL_WORDS), F.upper(word)).when(word.isin(*SMALL_WORDS) & (place > 0), word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20)))

    return F.when((letters >= 6) & (capitals >= 0.7 * letters), F.array_join(F.transform(parts, written), "")).otherwise(c)


def null_if_placeholder(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).rlike(r"^(-*|–|—|n/?a|not available|not applicable)$"), None).otherwise(c)


def clean_text(c: Column) -> Column:
    """Without markdown links, arrows, doubled spaces and separators at the end; null counts as empty."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[([^\]]*)\]\([^)]*\)|→", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, SPACE, " "), r"[\s·,;|-]+$", ""))


def tidy_text(c: Column) -> Column:
    """A space where a lower-case letter meets an upper-case one."""
    return collapse(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def source_key(external_id: Column, url: Column) -> Column:
    own = F.nullif(F.regexp_extract(external_id, "^src:([^:]+):", 1), F.lit(""))
    return F.coalesce(own, host(url), F.lit("(manual / unknown)"))


def normalize_url(url: Column) -> Column:
    """https, lower-case host, sorted query without tracking, no fragment, no slash at the end; null unless http(s)."""
    base = F.regexp_replace(F.trim(url), "#.*$", "")
    h = F.lower(F.try_parse_url(base, F.lit("HOST")))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(base, F.lit("PATH")), F.lit("")), "/+$", "")
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(base, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid)="))
    query = F.array_join(F.array_sort(parts), "&")
    return F.when(base.rlike("(?i)^https?://") & h.isNotNull(), F.concat(F.lit("https://"), h, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""), "/"), -1)


def url_shape(url: Column) -> Column:
    """First part of the path, its depth, and the kind of its last part."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    kind = (
        F.when(last == "", "root")
        .when(last.rlike("^[0-9]+$"), "num")
        .when(last.rlike("[0-9]{4,}$"), "slugid")
        .when(last.contains("-"), "slug")
        .otherwise("word")
    )
    return F.concat_ws("|", F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), F.size(parts).cast("string"), kind)


def url_id(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, "([0-9]{4,})/?$", 1), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def blocked_host(url: Column, hosts: list[str]) -> Column:
    h = host(url)
    out = F.lit(False)
    for x in hosts:
        out = out | (h == x) | h.endswith(f".{x}")
    return F.coalesce(out, F.lit(False))


def place_label(locality: Column, city: Column, address: Column) -> Column:
    return F.when(city.isNotNull() & locality.isNotNull(), F.concat_ws(", ", locality, city)).otherwise(F.coalesce(city, address))


def indian_digits(n: Column) -> Column:
    """A whole number with the last three digits together and the others in twos."""
    text = F.abs(n).cast("long").cast("string")
    head = F.regexp_replace(F.when(F.length(text) > 3, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(F.lit("")), r"(\d)(?=(\d\d)+$)", "$1,")
    return F.when(F.length(text) > 3, F.concat(F.lit("₹"), head, F.lit(","), F.right(text, F.lit(3)))).otherwise(F.concat(F.lit("₹"), text))


def tokens(c: Column, stop: list[str], least: int = 1) -> Column:
    """Distinct lower-case runs of letters and digits that are long enough and no stop words."""
    words = F.split(F.lower(c), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_digit(a: Column) -> Column:
    return F.filter(a, lambda x: x.rlike("[0-9]"))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def html_text(html: Column) -> Column:
    """Visible text: no scripts, styles or drawings, blocks on lines of their own, entities decoded, spaces collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</(script|style|noscript|svg)>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table)>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def page_title(html: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.substring(collapse(F.regexp_replace(found, r"<[^>]*>", " ")), 1, 200)


def email_or_null(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"), x)


def phone_digits(c: Column) -> Column:
    """Ten digits, without a country code or leading zero; null when there are not ten."""
    digits = F.regexp_replace(F.regexp_replace(c, r"[^0-9]", ""), r"^(0|91)(?=[0-9]{10}$)", "")
    return F.when(F.length(digits) == 10, digits)


def redact(c: Column, most: int = 1500) -> Column:
    hidden = F.regexp_replace(c, r"(?i)\b(bearer\s+|token=|cookie:\s*)[^\s;&]+", "$1***")
    return F.substring(hidden, 1, most)


#: Phone numbers, e-mail addresses and the words around them in an officer's line.
PHONE = r"(?:\+?91[\s-]?)?\d[\d\s-]{6,}\d"
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
CONTACT_WORDS = r"(?i)Contact\s+the\s+Authori[sz]ed\s+Officers?\s*:?-?"
PHONE_WORDS = r"(?i)\b(ph|phone|tel|mob(?:ile)?|m|mob no|email|e-?mail id)\b\.?\s*:?-?"
LABEL_WORDS = "ph phone tel telephone mob mobile m no contact email e-mail id officer authorised authorized the and for inspection call".split()


def first_of_each(items: Column, key) -> Column:
    """The items of an array without those whose key an earlier one has."""
    # the keys are found once, not again for each item
    return once(items, lambda all_: once(F.transform(all_, key), lambda keys: F.filter(all_, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def officer(c: Column) -> Column:
    """struct(name, phone, email) of a contact line: at most three names and three numbers of 8 to 13 digits."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), CONTACT_WORDS, " "), r"\s+", " ")
    email = F.regexp_extract(text, EMAIL, 0)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    found = F.filter(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda x: F.length(digits(x)).between(8, 13))
    phones = F.transform(first_of_each(found, digits), lambda x: F.regexp_replace(F.trim(x), r"\s{2,}", " "))

    def name(part: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(part, PHONE, " "), PHONE_WORDS, " ")
        out = F.regexp_replace(out, r"(?i)[\s\-–]+(mo|mob|mobile|ph|no)\.?$", "")
        out = F.regexp_replace(F.regexp_replace(out, r"[:()\-+.,]+\s*$", ""), r"^[\s:()\-+.,]+", "")
        return F.trim(F.regexp_replace(out, r"\s+", " "))

    def real(x: Column) -> Column:
        labels = F.forall(F.split(x, " "), lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z-]", "")).isin(*LABEL_WORDS))
        return (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 3) & ~labels & ~x.rlike("[0-9@]")

    parts = F.split(F.when(email == "", text).otherwise(F.replace(text, email, F.lit(" "))), r"(?i)[;/&]|,|\band\b|\(\d\)")
    names = F.transform(first_of_each(F.filter(F.transform(parts, name), real), F.lower), lambda x: F.substring(x, 1, 40))
    return F.struct(
        F.substring(F.array_join(F.slice(names, 1, 3), ", "), 1, 120).alias("name"), F.substring(F.array_join(F.slice(phones, 1, 3), ", "), 1, 80).alias("phone"), email.alias("email")
    )


def longest_run(numbers: Column) -> Column:
    """struct(first, length) of the longest run n, n + 1, n + 2 ... in an array of numbers, others between them passed over.

    Of equally long runs the first counts. One pass from the end: the run from a place is one longer than that from the
    nearest later place of the next number.
    """
    start = F.struct(F.create_map(F.lit(-1).cast("long"), F.lit(0)).alias("runs"), F.lit(None).cast("long").alias("first"), F.lit(0).alias("length"))

    def step(acc: Column, n: Column) -> Column:
        run = F.coalesce(F.try_element_at(acc["runs"], n + 1), F.lit(0)) + 1
        runs = F.map_concat(F.map_filter(acc["runs"], lambda k, _: k != n), F.create_map(n, run))
        better = run >= acc["length"]
        return F.struct(runs.alias("runs"), F.when(better, n).otherwise(acc["first"]).alias("first"), F.when(better, run).otherwise(acc["length"]).alias("length"))

    return F.aggregate(F.reverse(numbers), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["length"].alias("length")))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields with its keys in order, so that equal records give equal texts."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
