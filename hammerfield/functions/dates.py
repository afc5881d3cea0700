"""Column functions on dates: readers of source formats to UTC instants. Unreadable dates are null.

A clock time without a zone is Indian. Days that do not exist (31 February) are null rather than rolled over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

IST = "INTERVAL 330 MINUTES"


def _utc(local: Column) -> Column:
    return local - F.expr(IST)


def indian_date_time(c: Column) -> Column:
    """DD-MM-YYYY h:mm am/pm."""
    text = F.lower(F.trim(c))
    shape = r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\s+[0-9]{1,2}:[0-9]{2}\s*(am|pm)$"
    parts = [F.regexp_extract(text, r"^([0-9]+)-([0-9]+)-([0-9]+)\s+([0-9]+):([0-9]+)\s*(am|pm)$", k) for k in range(1, 7)]
    d, m, y, h, n = (p.try_cast("int") for p in parts[:5])
    hour = h % 12 + F.when(parts[5] == "pm", 12).otherwise(0)
    return F.when(text.rlike(shape), _utc(F.try_make_timestamp_ntz(y, m, d, hour, n, F.lit(0))))


def listing_date(c: Column) -> Column:
    """ISO dates: a bare date is 11:00 Indian time, a time without a zone is Indian, Z is UTC."""
    text = F.trim(c)
    zoned = F.try_to_timestamp(F.regexp_replace(text, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    local = F.try_to_timestamp(F.regexp_replace(text, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    bare = F.try_to_timestamp(F.concat(text, F.lit(" 11:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return (
        F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _utc(bare))
        .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), zoned)
        .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}$"), _utc(local))
    )


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def sheet_date(c: Column, hour: int = 11) -> Column:
    """d/m/y with years of two or four digits, or "31 Dec 2026"; the given Indian hour."""
    text = F.lower(F.trim(c))
    numeric = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})$"
    worded = r"^([0-9]{1,2})\s+([a-z]{3})[a-z]*\.?,?\s+([0-9]{4})$"

    def group(pattern: str, k: int) -> Column:
        return F.regexp_extract(text, pattern, k)

    year = group(numeric, 3).try_cast("int")
    year = F.when(year < 100, 2000 + year).otherwise(year)
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), group(worded, 2)), F.lit(0)).cast("int")
    a = F.try_make_timestamp_ntz(year, group(numeric, 2).try_cast("int"), group(numeric, 1).try_cast("int"), F.lit(hour), F.lit(0), F.lit(0))
    b = F.try_make_timestamp_ntz(group(worded, 3).try_cast("int"), month, group(worded, 1).try_cast("int"), F.lit(hour), F.lit(0), F.lit(0))
    return F.when(text.rlike(numeric), _utc(a)).when(text.rlike(worded), _utc(b))


def in_range(ts: Column, first: int = 2010, last: int = 2100) -> Column:
    return once(ts, lambda t: F.when(F.year(t).between(first, last), t))


def ist_label(ts: Column) -> Column:
    return F.date_format(ts + F.expr(IST), "d MMM yyyy, HH:mm")


def retry_after(c: Column) -> Column:
    """Seconds, never below 0."""
    return F.greatest(F.lit(0), F.trim(c).try_cast("int"))


def extension_minutes(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)increase by\s+([0-9]+)\s*minute", 1), F.lit("")).try_cast("int")


def yes_no(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v == "yes", True).when(v == "no", False)


def slot(ts: Column, minutes: int = 15) -> Column:
    """Start of the slot that ts is in, and of the next: the Indian offset is a whole number of quarter hours."""
    return F.window(ts.cast("timestamp"), f"{minutes} minutes")


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)), F.lit(0)).cast("int")


def date_and_time(date: Column, time: Column, hour: int = 11) -> Column:
    """"30 Sep 2026" or 30-09-2026 with a clock time of its own column, Indian; the given hour where there is no time."""
    worded, numeric = r"([0-9]{1,2})[\s-]+([A-Za-z]{3})[a-z]*[\s,-]+([0-9]{4})", r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})"
    clock = r"(?i)([0-9]{1,2}):([0-9]{2})\s*(am|pm)?"
    get = lambda c, p, k: F.regexp_extract(c, p, k)
    by_word = date.rlike(worded)
    year = F.when(by_word, get(date, worded, 3)).otherwise(get(date, numeric, 3)).try_cast("int")
    month = F.when(by_word, _month(get(date, worded, 2))).otherwise(get(date, numeric, 2).try_cast("int"))
    day = F.when(by_word, get(date, worded, 1)).otherwise(get(date, numeric, 1)).try_cast("int")
    time = F.coalesce(time, F.lit(""))
    half, h = F.lower(get(time, clock, 3)), get(time, clock, 1).try_cast("int")
    h = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), 0).otherwise(h)
    at = F.try_make_timestamp_ntz(year, month, day, F.coalesce(h, F.lit(hour)), F.coalesce(get(time, clock, 2).try_cast("int"), F.lit(0)), F.lit(0))
    return _utc(at)


#: A date of a notice, numeric (groups 1 to 3) or worded (4 to 6).
NOTICE_DATE = r"(?is)([0-9]{1,2})\s*[./-]\s*([0-9]{1,2})\s*[./-]\s*([0-9]{4})|([0-9]{1,2})(?:st|nd|rd|th)?[\s-]+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s,.-]+([0-9]{4})"


def notice_date(c: Column) -> Column:
    """The first date a notice prints, numeric or worded, as yyyy-mm-dd; "invalid" when no such day is in 2020 to 2100."""

    def day_of(found: Column) -> Column:
        get = lambda k: F.regexp_extract(found, NOTICE_DATE, k)
        month = F.coalesce(get(2).try_cast("int"), _month(get(5)))

        def made(year: Column) -> Column:
            at = F.try_make_timestamp_ntz(year, month, F.concat(get(1), get(4)).try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
            return F.when(year.between(2020, 2100), F.date_format(at, "yyyy-MM-dd"))

        return F.when(found != "", F.coalesce(once(F.concat(get(3), get(6)).try_cast("int"), made), F.lit("invalid")))

    # the text is searched once; what follows reads the date alone
    return once(F.regexp_extract(c, NOTICE_DATE, 0), day_of)
