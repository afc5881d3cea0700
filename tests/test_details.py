"""Detail pages of an auction site: stated pages with their records and errors."""

from datetime import datetime

from hammerfield.sources.details import detail_records
from hammerfield.sources.readers import wrap_source
from pyspark.sql import functions as F

PAGE = """<html><head><title>Auction</title><link rel="canonical" href="https://x.org/properties/77"></head><body>
<a class="text-dark fw-bold" href="#">Auction ID : # 77</a><h1>House   at Thane</h1>
<div><strong>Borrower Name :</strong></div><div><strong>Borrower Name:</strong> <em>A</em> Ltd</div>
<div><strong>Property Type</strong><span>Row House</span><span>more</span></div><div><strong>EMD :</strong><p>₹1,000.50</p></div>
<div><strong>Reserve Price :</strong><span>₹1,10,00,000.00</span></div><div><strong>Auction Start Date :</strong><a>23-12-2026 12:05 AM</a></div>
<div><strong>Auction End Time</strong><span>soon</span></div><div><strong>Application Submission Date</strong><span>01-12-2014 05:00 PM</span></div>
<div><strong>City/Town</strong><span>bombay</span></div><div><strong>Area/Town</strong><span>kalwa east.;</span></div><strong>Contact details</strong>
<div class="card"><h5>Description</h5><div class="card-body"><p>A house, Pin Code 400601.</p></div></div>
<li id="notice-1"><a href="https://x.org/n.pdf">n</a></li><li id="other"><a href="https://x.org/o.pdf">o</a></li></body></html>"""


def read(spark, *pages, wrap=False):
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    frame = frame.withColumn("html", wrap_source(F.col("html"))) if wrap else frame
    return [r.asDict(True) for r in detail_records(frame, "x.org").orderBy("page_id").collect()]


def test_a_whole_page_and_its_source_view(spark):
    for wrap in (False, True):
        r = read(spark, PAGE, wrap=wrap)[0]
        assert r["errors"] == [] and (r["auction_id"], r["canonical_id"], r["source_title"], r["has_contact"], r["pincode"]) == ("77", "77", "House at Thane", True, "400601")
        m = r["record"]
        assert (m["title"], m["category"], m["geo_city"], m["geo_locality"], m["borrower"]) == ("Row House for sale in kalwa east.;, bombay", "RESIDENTIAL", "Mumbai", "Kalwa East", "A Ltd")
        assert (m["reserve_price"], m["emd"], m["auction_start"], m["auction_end"], m["application_deadline"]) == (11000000.0, 1000.5, datetime(2026, 12, 22, 18, 35), None, None)
        assert (m["external_id"], m["source_url"], m["documents"]) == ("src:x.org:77", "https://www.x.org/properties/77", [{"type": "SALE_NOTICE", "title": "Sale Notice 1", "url": "https://x.org/n.pdf"}])


def test_errors(spark):
    cases = [
        (PAGE.replace("# 77", "# 78"), ["number of another property"]),
        (PAGE.replace("//x.org/prop", "//y.org/prop"), ["canonical address on another host"]),
        (PAGE.replace("properties/77", "lots/77"), ["canonical address of no property"]),
        (PAGE.replace("canonical", "other"), ["no canonical address"]),
        (PAGE.replace("Auction ID", "Number"), ["no number"]),
        (PAGE.replace("₹1,10,00,000.00", "on request"), ["unreadable reserve price", "no reserve price"]),
        (PAGE.replace("23-12-2026", "31-02-2026"), ["unreadable auction start"]),
        (PAGE.replace("12:05 AM", "13:05 PM"), ["unreadable auction start"]),
        (PAGE.replace("Row House", "Gold jewellery"), ["no real estate"]),
        ("<title>Just a moment...</title><body></body>", ["check page"]),
        (PAGE.replace("<title>Auction", "<title>Just a moment"), []),
        ("", ["empty page"]),
        (None, ["empty page"]),
        ("<p>x</p>", ["no canonical address", "no number", "no reserve price", "no place", "no type or title"]),
    ]
    got = read(spark, *[html for html, _ in cases])
    assert [r["errors"] for r in got] == [errors for _, errors in cases]
    assert all((r["record"] is None) == bool(r["errors"]) for r in got)


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "y"), (None, PAGE, None)], "page_id long, html string, record string")
    assert detail_records(frame.withColumn("told", F.lit(1)), "x.org").filter("record is not null").count() == 3
    assert detail_records(frame.limit(0), "x.org").count() == 0
