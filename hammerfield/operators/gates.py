"""Gates of the import: which records come in, which need a person, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions import money as M
from ..functions import names as N
from ..functions import text as T

#: Movables beyond vehicles; places and PIN codes of the one state that is verified.
MOVABLES = r"(?i)\b(plant (and|&) machinery|machineries|machinery|jewel+ery|bullion|going concern)\b"
MOVABLE_TITLE = r"(?i)^\s*(gold|jewel|vehicle|car|truck|tractor|machinery|plant (and|&) machinery)\b"
INACTIVE_RECORD = r"(?i)(reject|duplicate|archiv|delet|inactive|removed)"
STATE = "Maharashtra"
DISTRICTS = [
    "Ahmednagar", "Ahilyanagar", "Akola", "Amravati", "Chhatrapati Sambhajinagar", "Beed", "Bhandara", "Buldhana", "Chandrapur", "Dhule", "Gadchiroli", "Gondia", "Hingoli",
    "Jalgaon", "Jalna", "Kolhapur", "Latur", "Mumbai City", "Mumbai Suburban", "Nagpur", "Nanded", "Nandurbar", "Nashik", "Osmanabad", "Dharashiv", "Palghar", "Parbhani",
    "Pune", "Raigad", "Ratnagiri", "Sangli", "Satara", "Sindhudurg", "Solapur", "Thane", "Wardha", "Washim", "Yavatmal",
]
CITIES = [
    "Mumbai", "Navi Mumbai", "Greater Mumbai", "Kalyan", "Dombivli", "Dombivali", "Vasai", "Virar", "Vasai Virar", "Panvel", "Bhiwandi", "Mira Bhayandar", "Mira Road", "Bhayandar", "Ulhasnagar",
    "Ambernath", "Badlapur", "Kalyan Dombivli", "Pimpri Chinchwad", "Pimpri-Chinchwad", "Pimpri", "Chinchwad", "Kolhapur", "Ichalkaranji", "Malegaon", "Shirdi", "Lonavala", "Alibag", "Baramati",
    "Nashik", "Nagpur", "Pune", "Thane", "Solapur", "Sangli", "Satara", "Latur", "Jalgaon", "Akola", "Amravati", "Nanded", "Ahmednagar",
]
AMBIGUOUS = ["Aurangabad", "Raigarh", "Bijapur", "Hamirpur", "Pratapgarh", "Bilaspur"]
OTHER_STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh",
    "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Orissa", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal",
    "Delhi", "Chandigarh", "Puducherry", "Jammu and Kashmir", "Ladakh", "Daman and Diu", "Dadra and Nagar Haveli",
]


def _given(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _listed(**conditions: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def quality_gate(title: Column, bank: Column, place: Column, category: Column, kind: Column, blocked: Column) -> Column:
    """Why a record does not come in; an empty array where it does. The first failing step gives its reasons alone."""
    shape = _listed(title_missing=~_given(title) | (F.length(title) < 8), address_missing=~_given(bank) & ~_given(place))
    movable = K.is_vehicle(title, category) | F.concat_ws(" ", title, kind).rlike(MOVABLES)
    none = F.array().cast("array<string>")
    return F.when(blocked, F.array(F.lit("source_on_do_not_fetch_list"))).when(F.size(shape) > 0, shape).when(movable, F.array(F.lit("invalid_property_type"))).otherwise(none)


def strict_gate(price: Column, start: Column, end: Column, place: Column, schedule: Column) -> Column:
    """What a record lacks to be published at once."""
    return _listed(reserve_price_missing=~_given(price), auction_date_missing=~(_given(start) | _given(end)), address_missing=~_given(place) & ~_given(schedule))


def row_verdict(title: Column, latest: Column, fetched: Column, parsed: Column, record: Column, kind: Column, blocked: Column) -> Column:
    """The first reason why a sheet row is left out, null where it is taken. Columns that a layout lacks are null and say nothing."""
    movable = F.coalesce(K.feed_kind(kind) == "EXCLUDED", F.lit(False)) | title.rlike(MOVABLE_TITLE)
    return (
        F.when(~_given(title), "no title")
        .when(F.upper(F.trim(latest)) != "TRUE", "older snapshot")
        .when(F.lower(F.trim(fetched)) != "success", "fetch error")
        .when(F.lower(F.trim(parsed)) == "unparsed", "not parsed")
        .when(record.rlike(INACTIVE_RECORD), "record not active")
        .when(movable, "movable asset (not real estate)")
        .when(blocked, "source is on the do-not-fetch list")
    )


def record_errors(title: Column, external_id: Column, reserve: Column, emd: Column, start: Column, end: Column) -> Column:
    rules = {
        "Missing title": ~_given(title),
        "Missing external auction/listing ID (needed for dedup)": ~_given(external_id),
        "Reserve price is not a positive number": reserve <= 0,
        "EMD is negative": emd < 0,
        "Auction start is after auction end": start > end,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def needs_review(category: Column, reserve: Column, start: Column) -> Column:
    return category.isNull() | reserve.isNull() | start.isNull()


def place_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def pin_in_state(pin: Column) -> Column:
    """Whether a PIN code is one of the state: 400 to 402 and 404 to 445; null where it is none at all."""
    bare = F.regexp_replace(pin, r"\s+", "")
    three = F.substring(bare, 1, 3).try_cast("int")
    return F.when(bare.rlike("^[0-9]{6}$"), three.between(400, 402) | three.between(404, 445))


def location_verdict(state: Column, district: Column, city: Column, area: Column, address: Column, pin: Column) -> Column:
    """accept, reject or review: is the property in the state, by its own evidence alone.

    Evidence for it: its state field, the state's name in the text, a PIN code, a place that only this state has.
    Evidence against it: another state's name or a PIN code of another. Both kinds together are for review, as are a
    name that several states have, and no evidence at all.
    """
    named = F.when(_given(state), N.canon_state(state))
    text = F.concat_ws(" ", *[F.when(_given(x), x) for x in (address, area, city, district)])
    in_text = F.regexp_replace(F.regexp_extract(text, r"(?i)pin\s*code\s*[-:]?\s*(\d{3}\s?\d{3})\b", 1), r"\s", "")
    own_pin = pin_in_state(F.when(_given(pin), F.trim(pin)).otherwise(in_text))
    unique = sorted({x.lower().replace("-", " ") for x in DISTRICTS + CITIES} - {x.lower() for x in AMBIGUOUS})
    parts = F.flatten(F.array(*[F.split(F.coalesce(x, F.lit("")), "[,/]") for x in (district, city, area)]))
    keys = F.transform(parts, place_key)
    here = F.exists(keys, lambda k: k.isin(*unique)) | F.concat(F.lit(" "), place_key(text), F.lit(" ")).rlike(" (" + "|".join(unique) + ") ")
    unclear = F.exists(keys, lambda k: k.isin(*[x.lower() for x in AMBIGUOUS]))
    elsewhere = text.rlike(r"(?i)\b(" + "|".join(x.replace(" ", r"\s+") for x in OTHER_STATES) + r")\b")
    stated = F.coalesce(named == STATE, F.lit(False)) | text.rlike(rf"(?i)\b{STATE}\b")
    against = elsewhere | F.coalesce(~own_pin, F.lit(False))
    return (
        F.when(named != STATE, "reject")
        .when(against, F.when(stated | here, "review").otherwise("reject"))
        .when(stated | here, "accept")
        .when(unclear & F.coalesce(own_pin, F.lit(False)), "accept")
        .otherwise("review")
    )


def review_verdict(title: Column, category: Column, kind: Column, place: Column, reserve: Column, start: Column) -> Column:
    """REMOVED for vehicles, PUBLISHED with a category, a place and a price or date, else PENDING_REVIEW."""
    known = F.coalesce(category, K.property_kind(kind), K.property_kind(title))
    vehicle = K.is_vehicle(title, known)
    whole = known.isNotNull() & _given(place) & (reserve.isNotNull() | start.isNotNull()) & (F.length(title) >= 8)
    return F.when(vehicle, "REMOVED").when(F.coalesce(whole, F.lit(False)), "PUBLISHED").otherwise("PENDING_REVIEW")


#: Fields of a record with their greatest lengths, and whether capitals are tidied.
TEXT_FIELDS = {"title": (200, True), "location": (300, True), "branch": (120, True), "officer_name": (120, True), "auction_type": (80, False), "auction_method": (80, False)}
AMOUNT_FIELDS = {"reserve_price": 1000, "emd": 100, "minimum_increment": 100}


def normalize_listing(df: DataFrame) -> DataFrame:
    """df with the listing fields that it has cleaned; null stays null, what cannot be read becomes empty."""
    out = {}
    for name, (most, tidy) in TEXT_FIELDS.items():
        if name in df.columns:
            plain = T.clean_text(F.col(name))
            out[name] = F.when(F.col(name).isNotNull(), F.substring(T.tidy_case(plain) if tidy else plain, 1, most))
    if "bank" in df.columns:
        out["bank"] = F.when(F.trim("bank") == "", "").otherwise(N.canonical_bank_name(F.col("bank")))
        out["bank"] = F.when(F.col("bank").isNotNull(), out["bank"])
    if "description" in df.columns:
        plain = F.regexp_replace(F.regexp_replace("description", "<[^>]+>", " "), r"\[([^\]]*)\]\([^)]*\)", "$1")
        plain = F.regexp_replace(F.regexp_replace(plain, "[ \t]+", " "), "\n{3,}", "\n\n")
        out["description"] = F.substring(F.regexp_replace(plain, r"^\s+|\s+$", ""), 1, 4000)
    for name, least in AMOUNT_FIELDS.items():
        if name in df.columns:
            out[name] = F.when(F.col(name).isNotNull(), F.coalesce(M.amount_at_least(F.col(name), least).cast("string"), F.lit("")))
    if "officer_email" in df.columns:
        mail = F.lower(F.trim("officer_email"))
        out["officer_email"] = F.when(mail.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), mail).when(mail.isNotNull(), "")
    if "officer_phone" in df.columns:
        out["officer_phone"] = F.substring(F.trim(F.regexp_replace("officer_phone", r"[^\d+,\-\s/]", "")), 1, 40)
    return df.withColumns(out)
