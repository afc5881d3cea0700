"""Rendered property pages: stated pages with the records that they show."""

from datetime import datetime

from hammerfield.sources.rendered import absolute_url, page_time, rendered_records
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, text string"


def read(spark, *rows):
    return {r.page_id: r.asDict(True) for r in rendered_records(spark.createDataFrame(list(rows), SCHEMA)).collect()}


def test_a_whole_page(spark):
    html = """<h1>Flat at
      Thane</h1><table><tr><td>Bank:</td><td><b>Uco</b> Bank</td></tr><tr><td>City</td><td>Thane</td><td>x</td></tr></table>
      <dl><dt>City</dt><dd>Kalwa</dd><dt>District</dt><p>none</p></dl><a href="files/a.PDF">The
      notice</a><a href="http://o.org/b.docx?v=1"></a><a href="/faq.pdf">x</a><a href="/c.pdf">Privacy</a><a href="/d.html">y</a>"""
    text = """Auction ID
    77
    Property ID   AB-9
    Farm plot, Land at Thane
    Reserve Price (in Rs.): Rs. 12,34,567.50
    Upset Price: 5
    EMD
    EMD End Date & Time: 06/10/2026 12:05 am
    Bid Increment (each)
    1000
    Auction start: 5.1.2026, 3:15 PM
    Auction End Date
    2026-01-06T18:00
    Address
    Terms & Conditions
    Pin Code: 400 601 India
    Authorised Officer's Name: -
    Officer Name: A Rao
    Mobile No.: +91 98765 43210 (day)
    Latitude and Longitude 19.2, 72.97
    State
    """
    r = read(spark, (1, "https://x.org/l/p?q=1", html, text))[1]
    assert (r["title"], r["bank"], r["city"], r["district"], r["address"], r["state"]) == ("Flat at Thane", "Uco Bank", "Kalwa", None, None, None)
    assert (r["auction_id"], r["property_id"], r["property_type"], r["category"]) == ("77", "AB-9", "Farm plot", "AGRICULTURAL")
    assert (r["reserve_price"], r["emd"]) == (1234567.5, None)
    assert (r["auction_start"], r["auction_end"], r["emd_deadline"]) == (datetime(2026, 1, 5, 15, 15), datetime(2026, 1, 6, 18), datetime(2026, 10, 6, 0, 5))
    assert (r["pincode"], r["officer_name"], r["officer_phone"], r["latitude"], r["longitude"]) == ("400601", None, "+91 98765 43210", 19.2, 72.97)
    assert r["documents"] == [{"title": "The notice", "url": "https://x.org/l/files/a.PDF"}, {"title": "Notice", "url": "http://o.org/b.docx?v=1"}]
    assert r["missing"] == ["borrower_name_missing"] and r["usable"]


def test_nulls_empty_pages_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, None, None, None), (None, "u", "", ""), (None, "u", "", "")], SCHEMA)
    got = rendered_records(frame.withColumns({"lines": F.lit(1), "told": F.lit(2), "named": F.lit(3), "title": F.lit("t")})).collect()
    assert len(got) == 3 and all(len(r.missing) == 7 and not r.usable and r.documents == [] and r.title is None for r in got)
    assert rendered_records(frame.limit(0)).count() == 0


def test_text_is_made_of_the_html_where_there_is_none(spark):
    r = read(spark, (1, "https://x.org/auction-detail/5", "<p>Bank: Axis</p><div>Borrower</div><div>A Ltd</div><p>Shop for sale in Kochi</p>", None))[1]
    assert (r["auction_id"], r["bank"], r["borrower"], r["title"], r["category"]) == ("5", "Axis", "A Ltd", "Shop for sale in Kochi", "COMMERCIAL")


def test_times_and_addresses(spark):
    times = {
        "06-10-2026 10:00:00": datetime(2026, 10, 6, 10), "on 6/1/2026": datetime(2026, 1, 6, 11), "6.1.2026 12:30 PM": datetime(2026, 1, 6, 12, 30), "31-02-2026": None,
        "2026-10-06": datetime(2026, 10, 6, 11), "2026-13-06": None, "soon": None, "1-1-2026 25:00": None, None: None,
    }
    frame = spark.createDataFrame([(t,) for t in times], "t string")
    assert [r.v for r in frame.select(page_time(F.col("t")).alias("v")).collect()] == list(times.values())
    urls = [("a.pdf", "https://x.org", "https://x.org/a.pdf"), ("a.pdf", "https://x.org/b/c?d=/e/", "https://x.org/b/a.pdf"), ("/a.pdf", "https://x.org/b/c", "https://x.org/a.pdf"), ("HTTP://y.org/a", "https://x.org", "HTTP://y.org/a")]
    frame = spark.createDataFrame(urls, "href string, base string, want string")
    assert all(r.v == r.want for r in frame.select("want", absolute_url(F.col("href"), F.col("base")).alias("v")).collect())
