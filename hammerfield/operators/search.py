"""Search over listings: composable predicates over the listing and one of its rounds, ordering and pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import STATE_ALIASES
from .lifecycle import INACTIVE, OPEN, status_predicate


def all_of(parts: Sequence[Column | None]) -> Column:
    """Conjunction; None is no condition."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def any_of(parts: Sequence[Column | None]) -> Column:
    return reduce(lambda a, b: a | b, [p for p in parts if p is not None], F.lit(False))


def contains_ci(column: Column, text: str) -> Column:
    """Case-insensitive containment; % and _ are ordinary characters."""
    return F.coalesce(F.lower(column).contains(text.lower()), F.lit(False))


#: Fixed value: letters that a spelling variant doubles.
DOUBLED = "lnmtdrspkbgc"


def spelling_variants(term: str, most: int = 14) -> list[str]:
    """Other spellings of a lower-case word: double letters made single, single consonants made double."""
    if not re.fullmatch(r"[a-z]{4,}", term):
        return []
    out = [re.sub(r"(.)\1+", r"\1", term)]
    for i, c in enumerate(term):
        if c in DOUBLED and term[i - 1 : i] != c and term[i + 1 : i + 2] != c:
            out.append(term[:i] + c + term[i:])
    return [v for v in dict.fromkeys(out) if v != term][:most]


def keyword_predicate(text: str, columns: dict[str, Column], no_variants: Sequence[str] = ("description",), most: int = 8) -> Column | None:
    """Every word of text is in some column, or a spelling variant of it is in a column that allows variants.

    Two or more alphabetic words also match joined, when the joined word has five letters or more.
    """
    terms = [t for t in re.split(r"[\s,;]+", text.strip().lower()) if t][:most]
    if not terms:
        return None

    def found(term: str) -> Column:
        parts = [contains_ci(c, term) for c in columns.values()]
        parts += [contains_ci(c, v) for v in spelling_variants(term) for n, c in columns.items() if n not in no_variants]
        return any_of(parts)

    every = all_of([found(t) for t in terms])
    joined = "".join(terms)
    if len(terms) >= 2 and len(joined) >= 5 and all(re.fullmatch(r"[a-z]+", t) for t in terms):
        return every | found(joined)
    return every


@dataclass(frozen=True)
class Filters:
    """None means no condition."""

    q: str | None = None
    category: str | None = None
    state: str | None = None
    city: str | None = None
    bank_id: int | None = None
    min_price: float | None = None
    max_price: float | None = None
    group: str | None = None  # active or inactive


def round_predicate(f: Filters, now: Column) -> Column:
    """Conditions that one and the same round has to meet."""
    group = {"active": OPEN, "inactive": INACTIVE}.get(f.group or "")
    return all_of([
        F.col("bank_id") == f.bank_id if f.bank_id is not None else None,
        F.col("reserve_price") >= f.min_price if f.min_price is not None else None,
        F.col("reserve_price") <= f.max_price if f.max_price is not None else None,
        status_predicate(set(group), F.col("status"), F.col("auction_start"), F.col("auction_end"), now) if group else None,
    ])


def in_state(state: str) -> Column:
    """Stored under any spelling of the state; a listing without a place is looked for in its texts."""
    spellings = state_spellings(state)
    texts = any_of([contains_ci(F.col(c), x) for x in spellings for c in ("title", "address_text")])
    return F.coalesce(F.lower("geo_state").isin(*[x.lower() for x in spellings]), F.lit(False)) | (F.col("geo_city").isNull() & texts)


def state_spellings(state: str) -> list[str]:
    """As names.state_variants(), of a value that is known when the query is made."""
    title = lambda s: re.sub(r"(^|[\s-])([a-z])", lambda m: m[1] + m[2].upper(), s.strip().lower())
    key = re.sub(r"\s+", " ", re.sub(r"\s*&\s*", " and ", state.strip().lower()))
    canon = STATE_ALIASES.get(key) or title(key)
    out = [canon, state.strip(), re.sub("(?i) and ", " & ", canon), *(title(k) for k, v in STATE_ALIASES.items() if v == canon)]
    return [x for x in dict.fromkeys(out) if x]


def admin_predicate(status: str | None = None, q: str | None = None) -> Column:
    """Listings of a status, or all that are no duplicate and not removed, with a text in title or address."""
    wanted = F.col("status") == status if status else ~F.col("status").isin("DUPLICATE", "REMOVED")
    return all_of([wanted, any_of([contains_ci(F.col(c), q) for c in ("title", "address_text")]) if q else None])


def bulk_remove(properties: DataFrame, status: str | None = None, q: str | None = None) -> DataFrame:
    """properties with the status REMOVED where the filter fits, and changed; refused without a filter that narrows."""
    if not status and not (q and q.strip()):
        raise ValueError("give a status or a text: all listings cannot be removed at once")
    hit = admin_predicate(status, q) & (F.col("status") != "REMOVED")
    return properties.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn("status", F.when(F.col("changed"), "REMOVED").otherwise(F.col("status")))


@dataclass(frozen=True)
class ApiQuery:
    """The parameters of a request as they come, checked by api_query()."""

    filters: "Filters"
    updated_since: str | None
    page: int
    limit: int


def api_query(raw: dict[str, str], banks: set[str] = frozenset()) -> ApiQuery | None:
    """A request's parameters: active rounds unless told otherwise, page 1 and 20 rows (1 to 50) unless numbers say so.

    None where no row can be meant: a bank that does not exist. A date that is none raises.
    """
    number = lambda k, default, low, high: min(high, max(low, int(raw[k]))) if re.fullmatch(r"-?[0-9]+", raw.get(k, "")) else default
    price = lambda k: float(raw[k]) if re.fullmatch(r"[0-9]+(\.[0-9]+)?", raw.get(k, "")) else None
    if raw.get("bank") and raw["bank"] not in banks:
        return None
    since = raw.get("updatedSince")
    if since:
        datetime.fromisoformat(since.replace("Z", "+00:00"))
    group = raw.get("status", "active")
    filters = Filters(q=raw.get("q") or None, category=raw.get("category"), state=raw.get("state"), city=raw.get("city"), bank_id=int(raw["bank"]) if raw.get("bank") else None, min_price=price("min"), max_price=price("max"), group=group if group in ("active", "inactive") else None)
    return ApiQuery(filters, since, number("page", 1, 1, 1 << 30), number("limit", 20, 1, 50))


def listing_predicate(f: Filters) -> Column:
    place = [("title", F.col("title")), ("address", F.col("address_text")), ("city", F.col("geo_city")), ("state", F.col("geo_state"))]
    return all_of([
        F.col("status") == "PUBLISHED",
        F.col("category") == f.category if f.category else None,
        # a listing that has no place yet is looked for in its text
        in_state(f.state) if f.state else None,
        F.lower("geo_city") == f.city.lower() if f.city else None,
        keyword_predicate(f.q, dict(place)) if f.q else None,
    ])


def published(properties: DataFrame, auctions: DataFrame, f: Filters, now: Column) -> DataFrame:
    """Published listings with some round that meets every round condition; without any, with some round."""
    rounds = auctions.filter(round_predicate(f, now)).select(F.col("property_id").alias("id")).distinct()
    return properties.filter(listing_predicate(f)).join(rounds, "id", "left_semi")


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order, which must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page by offset in a total order, with the totals of all pages."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    return rows.join(F.broadcast(total)).withColumn("total_pages", pages).withColumn("has_more", F.lit(number) < pages)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    return df.filter(F.col(key) > after).orderBy(F.col(key).asc_nulls_last()).limit(size)


def capped(df: DataFrame, order: Sequence[Column], cap: int) -> DataFrame:
    """The first cap rows, and whether there were more: one row more is fetched to know."""
    rows = df.orderBy(*order).limit(cap + 1)
    n = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("_n", n).withColumn("capped", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > cap).filter(F.col("_n") <= cap).drop("_n")


def near_in_time(rows: DataFrame, key: str, name: str, at: str, seconds: int) -> DataFrame:
    """a, b: pairs of rows (by `name`, a < b) of one key whose times are less than so many seconds apart.

    Times are cut into stretches of that length: a row meets those of its own and the two adjoining stretches only, so a
    key with a long history makes no pairs across it.
    """
    moment = F.unix_timestamp(F.col(at).cast("timestamp"))
    held = rows.select(key, F.col(name).alias("b"), moment.alias("tb"), F.floor(moment / seconds).alias("stretch")).filter("stretch IS NOT NULL")
    asked = held.select(key, F.col("b").alias("a"), F.col("tb").alias("ta"), F.explode(F.array(*[F.col("stretch") + d for d in (-1, 0, 1)])).alias("stretch"))
    return asked.join(held, [key, "stretch"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) < seconds)).select("a", "b")
