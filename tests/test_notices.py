"""Lots of sale notices: segmentation against all chains, and notices whose lots are stated by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hammerfield.operators import notices as N


def longest(numbers):
    """The first of the longest chains n, n + 1, n + 2 ..., each step to the nearest later place."""
    best = []
    for i in range(len(numbers)):
        run = [i]
        for j in range(i + 1, len(numbers)):
            if numbers[j] == numbers[run[-1]] + 1:
                run.append(j)
        if len(run) > len(best):
            best = run
    return best


def test_chain_equals_all_chains(spark):
    rng = random.Random(4)
    cases = [[], [7], [1, 1, 2], [3, 1, 2, 4, 3], list(range(1, 60))] + [[rng.randrange(1, 9) for _ in range(rng.randrange(0, 25))] for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, n array<int>")
    marks = F.transform("n", lambda x, k: F.struct(k.alias("line"), x.alias("n")))
    for r in frame.select("i", marks.alias("m")).select("i", N.chain(F.col("m")).alias("run")).collect():
        assert [m.line for m in r.run] == longest(cases[r.i]), cases[r.i]
    # no longer run exists by other steps
    for numbers in cases[5:30]:
        reach = max((len(c) for k in range(4, 8) for c in itertools.combinations(numbers[:14], k) if all(b == a + 1 for a, b in zip(c, c[1:]))), default=0)
        assert reach <= max(3, len(longest(numbers)))


HEAD = "SALE NOTICE dated 01.10.2026 under the rules of the act, to the public in general, of the assets listed below and their terms\n"
MANY = (
    HEAD + "Total 12 (twelve) properties\nDate and time of auction: 12.11.2026 at 11 am\n"
    + "\n".join(f"Lot No. {k}\nDescription of the property: Flat No {k}, Tower {k}, Shanti Nagar, Thane 40060{k % 10}\nUpset Price: Rs. {k + 30},00,000/-\nEarnest Money Deposit: Rs. {k + 2},00,000/-" for k in range(1, 13))
    + "\nTerms and Conditions\nReserve Price is as is where is. Address: deposit EMD before 5 pm"
)
NEXT_LINE = HEAD + "Property 1\nReserve Price\n: Rs. 62,50,000\nEMD\n6.25 lakhs\nAuction Date 15.11.2026\nLocation: House at Nashik road near the station\nProperty 2\nEMD: 9,00,000 Reserve Price: 90 lacs\nAddress - Shop in Nashik city market area, auction on 16-Nov-2026\nProperty 3\nReserve Price 5,00,000 EMD 5,00,000\nAddress: House at Pune near the temple"
MISSING = HEAD + "Date of sale: 20th November 2026\nSr. No. 1\nAddress: Plot at Satara near the lake\nReserve Price: 15,00,000\nEMD 1,50,000\nSr. No. 2\nAddress: Plot at Karad near the hill\nReserve Price: to be informed\nEMD: 1,50,000\nSr. No. 3\nReserve Price 1,20,00,000 Auction date: 31.02.2026"
TWICE = HEAD + "1. Asset at the corner\nAddress: House in Pune city 012345\nReserve Price: 20,00,000 Reserve Price: 21,00,000 auction date: 12.12.2026 auction date 13.12.2026\n 3. not counted\n2) Asset two\nReserve Price: 900\nDate of Auction: 01/01/2026\nAddress: short"
TABLE = HEAD + "Sr No | Property | EMD | Reserve Price\n1 House in Satara city near fort 5,50,000 55,00,000 12.11.2026\n\n2 Land in\n Satara taluka 1,00,000 10,00,000\n4 no row of the table\n3 Broken 12,00,000 31/04/2027\nNote : terms\n4 House 1,00,000 2,00,000"


@pytest.fixture(scope="module")
def found(spark):
    texts = [MANY, NEXT_LINE, MISSING, TWICE, TABLE, None, "too short", "word " * 60, "upset price 3 lakhs and reserve price 4 lakhs " + "word " * 60, "Reserve price 3 lakhs auction on 1.1.2027 " + "word " * 60]
    rows = N.segment(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc int, text string, blocks string"))
    segments = {r.doc: r for r in rows.collect()}
    lots: dict[int, list] = {i: [] for i in range(len(texts))}
    for r in N.lots(rows).collect():
        lots[r.doc].append(r)
    return segments, {d: sorted(x, key=lambda r: int(r.lot)) for d, x in lots.items()}


def test_status_and_strategy(found):
    got = {d: (r.status, r.strategy, r.claimed) for d, r in found[0].items()}
    assert got == {
        0: ("OK", "marker:lot", 12), 1: ("OK", "marker:lot", None), 2: ("OK", "marker:serial", None), 3: ("OK", "numbered", None), 4: ("OK", "table", None), 5: ("NEEDS_OCR", None, None),
        6: ("NEEDS_OCR", None, None), 7: ("NO_LOTS", None, None), 8: ("AMBIGUOUS", None, None), 9: ("OK", "single", None),
    }
    assert {r.notice_date for d, r in found[0].items() if d < 5} == {"2026-10-01"}


def test_twelve_lots_take_the_date_of_the_head_and_nothing_of_the_terms(found):
    lots = found[1][0]
    assert [r.lot for r in lots] == [str(k) for k in range(1, 13)] and all(r.complete for r in lots)
    assert [(r.reserve, r.emd) for r in lots] == [((k + 30) * 100_000, (k + 2) * 100_000) for k in range(1, 13)]
    assert {(r.date, r.date_source, r.confidence) for r in lots} == {("2026-11-12", "notice", 0.9)}
    assert len({r.address for r in lots}) == 12 and "EMD" not in lots[-1].address


def test_values_are_read_by_label_not_by_place(found):
    a, b, c = found[1][1]
    assert (a.reserve, a.emd, a.date, a.date_source, a.confidence) == (6_250_000, 625_000, "2026-11-15", "lot", 1.0)
    assert (b.reserve, b.emd, b.date, b.complete) == (9_000_000, 900_000, "2026-11-16", True) and "Nashik" in b.address
    assert (c.reserve, c.emd, c.complete) == (None, None, False) and "price_inconsistent" in c.issues


def test_missing_values_stay_empty_with_a_reason(found):
    a, b, c = found[1][2]
    assert a.complete and (a.date, a.date_source) == ("2026-11-20", "notice")
    assert (b.reserve, b.emd, b.issues, b.complete) == (None, 150_000, ["reserve_missing"], False)
    assert (c.address, c.date) == (None, None) and c.issues == ["emd_missing", "date_invalid", "address_missing"]


def test_what_is_said_twice_differently_is_not_guessed(found):
    a, b = found[1][3]
    assert (a.reserve, a.date) == (None, None) and a.issues == ["reserve_conflicting", "emd_missing", "date_conflicting", "pincode_invalid"]
    assert a.confidence == 0.0 and not a.complete and "not counted" in a.excerpt
    assert b.issues == ["reserve_implausible", "emd_missing", "address_missing", "auction_before_notice"] and b.date is None


def test_rows_of_a_table(found):
    a, b, c = found[1][4]
    assert (a.reserve, a.emd, a.date, a.complete, a.address) == (5_500_000, 550_000, "2026-11-12", True, "House in Satara city near fort")
    assert (b.reserve, b.emd, b.date, b.address) == (1_000_000, 100_000, None, "Land in Satara taluka")
    assert c.issues == ["reserve_missing", "emd_missing", "date_missing", "address_missing", "columns_not_aligned", "date_invalid"]
    assert found[1][9][0].reserve == 300_000 and found[1][9][0].date == "2027-01-01"


def test_records_of_complete_lots_alone(spark, found):
    rows = N.segment(spark.createDataFrame([(1, MANY), (2, TWICE)], "doc int, text string"))
    got = N.listing_records(N.lots(rows), F.lit("https://www.bank.example/a.pdf"), F.lit(None).cast("string"), lambda u: F.lit("h")).collect()
    assert len(got) == 12 and {r.external_id for r in got} == {f"src:bank.example:pdf-h-lot{k}" for k in range(1, 13)}
    assert {r.bank for r in got} == {""} and {r.emd for r in got} == {str((k + 2) * 100_000) for k in range(1, 13)}


def test_a_plot_of_six_digits_is_no_pin_code_and_a_label_no_address(spark):
    lots = HEAD + "Lot No. 1\nDescription of Property: Plot 123456, Sector 3, Navi Mumbai {pin}\nReserve Price: 20,00,000\nAuction Date: 12.12.2026"
    table = HEAD + "Sr No | Property | EMD | Reserve Price\n1 Broken row 12,00,000 12.11.2026"
    rows = [(1, lots.format(pin="012345")), (2, lots.format(pin="400701")), (3, table)]
    got = {r.doc: r for r in N.lots(N.segment(spark.createDataFrame(rows, "doc int, text string"))).collect()}
    assert "pincode_invalid" in got[1].issues and not got[1].complete and got[2].complete
    assert got[3].address is None and "address_missing" in got[3].issues and got[3].date == "2026-11-12"


def test_documents_whose_addresses_share_32_bits_keep_their_own_ids(spark, tmp_path):
    import duckdb

    from hammerfield.functions.money import fnv1a
    from hammerfield.plans.registry import ORACLE_SQL, QUERIES, load

    load()
    docs = [479199, 662782]
    urls = spark.createDataFrame([(f"https://www.bank.example/notice-{d}.pdf",) for d in docs], "u string")
    assert urls.select(fnv1a(F.col("u")).alias("h")).distinct().count() == 1
    orders = spark.createDataFrame([(k + 1, d, "O", 200_000.0) for k, d in enumerate(docs)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    orders.selectExpr("*", "timestamp_ntz'1996-05-05' AS o_orderdate").write.parquet(f"file://{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert QUERIES["tx13_record_ids"](spark, f"file://{tmp_path}").first().ids == con.execute(ORACLE_SQL["tx13_record_ids"]).fetchone()[0] == 2


def test_a_filter_of_complete_lots_does_not_search_a_block_again(spark):
    blocks = spark.createDataFrame([], "doc long, strategy string, header_date string, notice_date string, blocks array<struct<num:string,text:string,issues:array<string>,raw:string>>")
    records = N.listing_records(N.lots(blocks), F.lit("http://bank.example/a"), F.lit(None).cast("string"), N.document_hash)
    assert records._jdf.queryExecution().optimizedPlan().toString().count("time\\s*of\\s*") <= 1


def test_what_follows_a_label_ends_at_the_next_one(spark):
    import re

    rng = random.Random(1)
    bits = ["Reserve Price", "EMD", "emd", "Address", "Date", "lot no", "Rs. 5,000/-", "12 lakhs", "x", "remd", ":", " - ", "–", "\n", "  ", "=", "upset price", "Location:"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(300)]

    def plain(text, label, most):
        rests = [m.group(1) for m in re.finditer(rf"(?i){label}(?=([\s\S]{{0,{most}}}))", text)]
        cut = lambda r: (lead := re.match(r"[\s:\-–.=|]*", r).group(0)) + re.sub(rf"(?is){N.STOP}.*$", "", r[len(lead) :])
        return [cut(r) for r in rests]

    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for label, most in ((N.RESERVE, 80), (N.EMD, 12), (N.ADDRESS, 420)):
        got = {r.i: r.x for r in frame.select("i", N._after(F.col("t"), label, most).alias("x")).collect()}
        assert got == {i: plain(t, label, most) for i, t in enumerate(texts)}
