"""Auction lifecycle, derived when rows are read.

Days are Indian calendar days: UTC + 330 minutes, no daylight saving.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = ("UPCOMING", "LIVE", "AUCTION_TODAY")
INACTIVE = ("COMPLETED", "POSTPONED", "CANCELLED", "EXPIRED")
IST = "INTERVAL 330 MINUTES"
DAY = "INTERVAL 1 DAY"


def ist_day_start(ts: Column) -> Column:
    """Instant at which the Indian day of ts began."""
    return F.date_trunc("day", ts + F.expr(IST)).cast("timestamp_ntz") - F.expr(IST)


def ist_date(ts: Column) -> Column:
    return F.to_date(ts + F.expr(IST))


def is_over(start: Column, end: Column, now: Column) -> Column:
    """Ended before now, or without an end the Indian day of the start is past; false without dates."""
    return F.coalesce(end < now, ist_day_start(start) + F.expr(DAY) <= now, F.lit(False))


def effective_status(status: Column, start: Column, end: Column, now: Column) -> Column:
    """The status that holds at now."""
    tomorrow = ist_day_start(now) + F.expr(DAY)
    return (
        F.when(~status.isin(*OPEN), status)
        .when(is_over(start, end, now), F.lit("COMPLETED"))
        .when((status == "LIVE") | start.isNull(), status)
        .when(start <= now, F.when(end.isNotNull(), F.lit("LIVE")).otherwise(F.lit("AUCTION_TODAY")))
        .when(start < tomorrow, F.lit("AUCTION_TODAY"))
        .otherwise(status)
    )


def status_predicate(wanted: set[str], status: Column, start: Column, end: Column, now: Column) -> Column:
    """effective_status(...) in wanted, as a disjunction of ranges on the plain columns.

    No function touches a stored column, so file statistics can skip row groups; now is a literal.
    """
    today = ist_day_start(now)
    tomorrow = today + F.expr(DAY)
    stored = [w for w in wanted if w not in OPEN]
    open_ = status.isin(*OPEN)
    # the day of the start is past exactly when the start is before today
    over = (end < now) | (end.isNull() & (start < today))
    going = (end.isNull() | (end >= now)) & (end.isNotNull() | start.isNull() | (start >= today))
    early = start.isNotNull() & (status != "LIVE")
    parts = []
    if stored:
        parts.append(status.isin(*stored))
    if "COMPLETED" in wanted:
        parts.append(open_ & over)
    if "LIVE" in wanted:
        parts.append((status == "LIVE") & going)
        parts.append(open_ & going & early & (start <= now) & end.isNotNull())
    if "AUCTION_TODAY" in wanted:
        parts.append((status == "AUCTION_TODAY") & going & (start.isNull() | (start >= tomorrow)))
        parts.append(open_ & going & early & (((start <= now) & end.isNull()) | ((start > now) & (start < tomorrow))))
    if "UPCOMING" in wanted:
        parts.append((status == "UPCOMING") & going & (start.isNull() | (start >= tomorrow)))
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(False))


def derive_from_dates(start: Column, end: Column, now: Column) -> Column:
    """The status written with a record, by the UTC day of the start; a missing end is the start, no start is upcoming."""
    last = F.coalesce(end, start)
    return (
        F.when(start.isNull(), F.lit("UPCOMING"))
        .when(now > last, F.lit("COMPLETED"))
        .when(now >= start, F.lit("LIVE"))
        .when(F.to_date(start) == F.to_date(now), F.lit("AUCTION_TODAY"))
        .otherwise(F.lit("UPCOMING"))
    )


def resolve_status(explicit: Column, stored: Column, date_changed: Column, derived: Column) -> Column:
    """An explicit status wins; postponed and cancelled are held unless the date changed; else the derived one."""
    held = stored.isin("POSTPONED", "CANCELLED") & ~F.coalesce(date_changed, F.lit(False))
    return F.when(explicit.isNotNull(), explicit).when(held, stored).otherwise(derived)
