"""Column functions on amounts and numbers. What cannot be read is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once


def parse_money(c: Column) -> Column:
    """A plain number; rupee signs, commas and spaces are dropped; dashes and anything else are null."""
    text = F.regexp_replace(c, r"[₹,\s\x{00A0}]", "")
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def clean_money(c: Column) -> Column:
    """A positive amount rounded to paise; a leading Rs. or INR is dropped."""
    n = parse_money(F.regexp_replace(F.lower(c), r"\b(rs\.?|inr)\s*", ""))
    return F.when(n > 0, F.round(n, 2))


def money_words(c: Column) -> Column:
    """The first amount in the text, with its unit of crores, lakhs or thousands, as a whole number."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ",", ""), "₹", " "), r"(?i)\brs\.?\b", " ")
    pattern = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(cr(?:ore)?s?|l(?:ac|akh)?s?|k)?\b"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    times = F.when(unit.startswith("cr"), 1e7).when(unit.startswith("l"), 1e5).when(unit == "k", 1e3).otherwise(1.0)
    n = F.floor(F.regexp_extract(text, pattern, 1).try_cast("double") * times + 0.5).cast("long")
    return F.when(n > 0, n)


def amount_at_least(c: Column, least: float) -> Column:
    """An amount, null for a percentage or less than the least."""
    n = money_words(c)
    return F.when(~F.contains(c, F.lit("%")) & (n >= least), n)


def lost_unit(stored: Column, new: Column) -> Column:
    """The new amount where the stored one lost its unit: under 1,000 and at most a hundredth of it."""
    return F.when((stored < 1000) & (new >= 100 * stored), new).otherwise(stored)


def percent(ratio: Column, digits: int = 0) -> Column:
    return F.coalesce(F.concat(F.format_number(ratio * 100, digits), F.lit("%")), F.lit("—"))


def drop_class(share: Column) -> Column:
    return F.when(share >= 0.6, "CRITICAL").when(share >= 0.3, "INCOMPLETE").when(share >= 0.1, "WARNING").otherwise("HEALTHY")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371 * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def valid_point(lat: Column, lng: Column) -> Column:
    """Inside the country's box and not (0, 0)."""
    return F.coalesce(lat.between(6, 37.6) & lng.between(68, 97.5) & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the characters' code points."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))

    def step(h: Column, x: Column) -> Column:
        y = h.bitwiseXOR(x)
        low, high = y.bitwiseAND(F.lit(0xFFFF)), F.shiftright(y, 16)
        return (low * F.lit(16777619) + F.shiftleft((high * F.lit(16777619)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


#: Fixed value: an amount as notices print it.
NOTICE_AMOUNT = r"(?i)(?:rs\.?|₹|inr)?\s*(\d{1,3}(?:,\d{2,3})+|\d+)(\.\d+)?\s*(?:/-)?\s*(lakhs?|lacs?|crores?|cr\b)?"


def notice_amount(c: Column) -> Column:
    """The first amount of a notice: Indian grouping, "/-", lakhs and crores; a whole number."""

    def value(found: Column) -> Column:
        part = lambda k: F.regexp_extract(found, NOTICE_AMOUNT, k)
        n = F.concat(F.replace(part(1), F.lit(","), F.lit("")), part(2)).try_cast("double")
        times = once(F.lower(part(3)), lambda unit: F.when(unit.startswith("la"), 1e5).when(unit.startswith("cr"), 1e7).otherwise(1.0))
        return F.floor(n * times + 0.5).cast("long")

    # the text is searched once; the parts are read from what was found
    return once(F.regexp_extract(c, NOTICE_AMOUNT, 0), value)
