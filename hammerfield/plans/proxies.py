"""Listing tables as views over the driver's tables: the same SQL for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The fixed instant of lifecycle queries.
NOW = "1998-06-15 08:00:00"

#: Wordings of listing fields; each row of the view `listing` has one of each, by its key.
WORDINGS = {
    "kind_text": ["Flat No 3, Shanti Nagar", "Movable Plant and Machinery", "Plant & Machinery with tractor shed", "Farm House at Lonavala", "Farmland near lake", "Agricultural land", "Office space", "Open land and building", "Open Plot", "Land & Building", "Commercial Vehicle", "Two-Wheeler (Honda)", "misc assets", None, "", "SCHOOL BUILDING", "gold ornaments", "Vacant site with villa", "Row House 4BHK", "Industrial Shed"],
    "title": ["FLAT NO 12, SHANTI APARTMENTS OF SBI", "Plot at Pune [Open in Maps →](https://maps.example.org/?q=21.01,73.15) ·", "Car (Honda City)", "the car park unit", "Sale of TRACTORS lot", "Short", None, "  House   in the  Nagpur city | - ", "2 BHK flat near o'hare road", "bus", "THE SHOP IN BUS STAND ROAD, THANE", "NH 4 GODOWN"],
    "city_text": ["navi-mumbai east", "  KOCHI ", "new  delhi", "Bombay", "vasai virar", "Vasai-Virar", "pune", "aurangabad", "AURANGABAD", None, "mira road", "greater  Mumbai", "x y-z"],
    "state_text": ["Jammu & Kashmir", "orissa", "TAMIL NADU", "Pondicherry", None, "maharashtra", " Maharashtra ", "Dadra & Nagar Haveli & Daman & Diu", "Bihar", "nct of delhi", "Andaman &Nicobar Islands"],
    "bank_text": ["SBI", "State Bank Of India Ltd.", "The Punjab National Bank Limited", "uco  bank", "Axis Bank & Co", "XYZ CO-OPERATIVE BANK LTD", None, "", "union bank", "PRIVATE LENDER PVT LTD", "Asset Reconstruction Company (India) Ltd"],
    "price_text": ["Rs. 35,00,000", "1.25 Cr", "40 lakhs", "12k", "nothing", "₹ 7.5 lac only", None, "10 %", "999", "Rs 45,00,000/-", "INR 1200", "-4", "5000.126", "1,00,00,000"],
    "emd_text": ["50,000", "10%", "99", "100", None, "Rs. 2 lakh", "1.5 crore/-", "nil", "45,00,000"],
    "date_text": ["07-10-2026 11:30 am", "31/12/2026", "31 Dec 2026", "12th November 2026 at 3", "32/1/2026", "31.02.2026 noon", "on 5/6/2019", "no date", None, "30 Sep 2026", "1-3-26", "date 03 . 04 . 2030 or 1st May 2027", "2nd may, 2031 or 01/01/2030"],
    "time_text": ["12:00 PM", "12:05 am", "3:15 pm", "14:20", None, "noon", "11:59 AM"],
    "status_text": ["Auction cancelled", "not cancelled", "unsold", "Sold", "live and cancelled", "cancelled / sold", "put on hold", "called off", "Withdrawn", "never been postponed", "closed", "", None, "a long description of the terms, under which it may be cancelled"],
    "document_text": ["Sale Notice", "Bid form and terms", "E-Auction notice", "corrigendum", "Inspection schedule", "Demand notice", "annexure II", "Proclamation of sale", "photo.jpg", "Possession Notice", "Application form", "tender document", "", "sale-notice.pdf", "Project brochure", "Notice of e-auction"],
    "officer_text": ["Contact The Authorized Officer : Mr Satish Trapasiya +91 9726962491, Mr Jitendra Patel +91 9974848487", "Ph: 022-26541234 email a.b@bank.co.in", "Mr. A K Rao; Ms B (2) / M: 98765 43210", None, "no contact", "John and Mary, 9876543210, 9876543210; John"],
}


def _wording(place: int, name: str, key: str) -> str:
    """A column of one of the wordings; strides without common factors with their number give every combination in time."""
    texts = WORDINGS[name]
    cases = " ".join(f"when {i} then " + ("null" if x is None else "'" + x.replace("'", "''") + "'") for i, x in enumerate(texts))
    return f"case ({key} * {2 * place + 1} + cast(floor({key} / {7 + 4 * place}) as bigint)) % {len(texts)} {cases} end as {name}"


VIEWS = {
    "listing": "\nselect o_orderkey as id, o_custkey as customer, o_totalprice as price, o_orderdate as start, " + ", ".join(_wording(i, name, "o_orderkey") for i, name in enumerate(WORDINGS)) + " from {orders}",
    "property": """
select c.c_custkey as id, c.c_name as title, c.c_acctbal as acctbal,
  case c.c_mktsegment when 'BUILDING' then 'RESIDENTIAL' when 'FURNITURE' then 'COMMERCIAL' when 'HOUSEHOLD' then 'LAND_PLOT' when 'MACHINERY' then 'INDUSTRIAL' end as category,
  case c.c_custkey % 20 when 0 then 'DUPLICATE' when 1 then 'REMOVED' when 2 then 'PENDING_REVIEW' else 'PUBLISHED' end as status,
  case when c.c_custkey % 7 = 0 then null else n.n_name end as geo_city, r.r_name as geo_state, n.n_name as city,
  concat(n.n_name, ', ', r.r_name) as address_text
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey""",
    "auction": """
select o.o_orderkey as id, o.o_custkey as property_id, l.bank_id, o.o_totalprice as reserve_price, o.o_orderdate as auction_start,
  case when o.o_orderkey % 3 = 0 then null else l.last_ship end as auction_end,
  case o.o_orderstatus when 'F' then 'COMPLETED' when 'P' then 'POSTPONED' else (case o.o_orderkey % 3 when 0 then 'UPCOMING' when 1 then 'AUCTION_TODAY' else 'LIVE' end) end as status,
  o.o_orderdate as created_at
from {orders} o left join (select l_orderkey, min(l_suppkey) as bank_id, max(l_shipdate) as last_ship from {lineitem} group by l_orderkey) l on l.l_orderkey = o.o_orderkey""",
    "bank": "select s_suppkey as id, s_name as name from {supplier}",
    "run_log": """
select event_id as id, concat('src', cast(user_id % 8 as {string})) as source, event_type as kind, ts as started_at,
  case when event_type = 'error' then 'error' else 'ok' end as status, cast(floor(value) as int) as created, props as message
from {events}""",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


class Views:
    """The tables and proxy views of one input directory, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            sql = VIEWS[name].replace("{string}", "string")
            return self.spark.sql(sql, **{t: getattr(self, t) for t in set(re.findall(r"\{(\w+)\}", sql))})
        if name in _TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def oracle_views(sql: str) -> str:
    """sql with the proxy views it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    views = ", ".join(f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v].replace('{string}', 'varchar'))})" for v in used)
    body = sql.strip()
    return f"WITH RECURSIVE {views}, {body[15:]}" if body[:15].upper() == "WITH RECURSIVE " else f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
