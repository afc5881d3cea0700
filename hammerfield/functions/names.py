"""Column functions on the names of places and institutions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, collapse, lookup, tidy_case, title_case

#: Other names of cities, states and banks.
CITY_ALIASES = {
    "bengaluru": "Bangalore", "bangalore": "Bangalore", "bombay": "Mumbai", "new delhi": "Delhi", "cochin": "Kochi", "trivandrum": "Thiruvananthapuram",
    "gurugram": "Gurgaon", "vizag": "Visakhapatnam", "calcutta": "Kolkata", "madras": "Chennai", "vasai virar": "Vasai", "vasai-virar": "Vasai",
    "vasai virar city": "Vasai", "bassein": "Vasai", "nalasopara": "Nallasopara", "nala sopara": "Nallasopara", "nalla sopara": "Nallasopara",
    "ambarnath": "Ambernath", "dombivali": "Dombivli", "mumbai city": "Mumbai", "greater mumbai": "Mumbai", "mira-bhayandar": "Mira Bhayandar",
    "mira road": "Mira Bhayandar", "pimpri-chinchwad": "Pimpri Chinchwad",
}
STATE_ALIASES = {
    "orissa": "Odisha", "telangana state": "Telangana", "andhra pradesh state": "Andhra Pradesh", "nct of delhi": "Delhi", "new delhi": "Delhi",
    "pondicherry": "Puducherry", "uttaranchal": "Uttarakhand", "dadra and nagar haveli and daman and diu": "Dadra And Nagar Haveli And Daman And Diu",
}
BANK_ALIASES = {
    "sbi": "State Bank of India", "state bank of india": "State Bank of India", "pnb": "Punjab National Bank", "punjab national bank": "Punjab National Bank",
    "bob": "Bank of Baroda", "bank of baroda": "Bank of Baroda", "boi": "Bank of India", "bank of india": "Bank of India", "ubi": "Union Bank of India",
    "union bank of india": "Union Bank of India", "union bank": "Union Bank of India", "iob": "Indian Overseas Bank", "indian overseas bank": "Indian Overseas Bank",
    "bom": "Bank of Maharashtra", "bank of maharashtra": "Bank of Maharashtra", "central bank of india": "Central Bank of India", "canara bank": "Canara Bank",
    "indian bank": "Indian Bank", "uco bank": "UCO Bank", "hdfc bank": "HDFC Bank", "icici bank": "ICICI Bank", "axis bank": "Axis Bank", "idbi bank": "IDBI Bank",
    "yes bank": "Yes Bank", "kotak mahindra bank": "Kotak Mahindra Bank",
}


def canon_city(c: Column) -> Column:
    key = F.lower(collapse(c))
    return F.coalesce(lookup(key, CITY_ALIASES), title_case(key))


def canon_city_in_state(city: Column, state: Column) -> Column:
    """canon_city(), and the one name that two states share."""
    canon = canon_city(city)
    renamed = (F.lower(canon) == "aurangabad") & (F.lower(F.trim(F.coalesce(state, F.lit("")))) == "maharashtra")
    return F.when(renamed, "Chhatrapati Sambhajinagar").otherwise(canon)


def canon_state(c: Column) -> Column:
    key = F.lower(collapse(F.regexp_replace(c, r"\s*&\s*", " and ")))
    return F.coalesce(lookup(key, STATE_ALIASES), title_case(key))


def state_variants(c: Column) -> Column:
    """Every spelling under which the state of c may be stored: canonical, as given, with "&", and its old names."""
    canon = canon_state(c)
    old = F.array(*[F.when(canon == name, title_case(F.lit(alias))) for alias, name in STATE_ALIASES.items()])
    with_sign = F.when(canon.rlike("(?i) and "), F.regexp_replace(canon, "(?i) and ", " & "))
    every = F.array_compact(F.concat(F.array(canon, F.trim(c), with_sign), old))
    return F.filter(F.array_distinct(every), lambda x: x != "")


def usable_city(c: Column) -> Column:
    """The canonical name where c is it apart from case and has at most 40 characters, else null."""
    canon = canon_city(c)
    return F.when((F.length(c) <= 40) & (F.lower(canon) == F.lower(F.trim(c))), canon)


def bank_key(c: Column) -> Column:
    """Lower case words without punctuation and legal forms."""
    text = F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9 ]+", " ")
    text = F.regexp_replace(text, r"\b(limited|ltd|the|co operative|cooperative)\b", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_bank_key(c: Column) -> Column:
    key = bank_key(c)
    return F.coalesce(bank_key(lookup(key, BANK_ALIASES)), key)


def canonical_bank_name(c: Column) -> Column:
    return F.coalesce(lookup(bank_key(c), BANK_ALIASES), F.substring(tidy_case(clean_text(c)), 1, 80))


def institution_key(c: Column) -> Column:
    """As bank_key, with asset reconstruction companies and co-operatives written one way."""
    text = F.regexp_replace(F.lower(c), r"asset\s+reconstruction\s+(company|co\.?)", "arc")
    text = F.regexp_replace(text, r"co-?\s?operative", "cooperative")
    text = F.regexp_replace(F.regexp_replace(text, r"^the\s+", ""), r"\b(private|pvt|limited|ltd)\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 ]+", " "), r"\s+", " "))
