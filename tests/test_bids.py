"""Landed answers of a bid API: every rule by which paging stops, records as said, sources by family."""

from __future__ import annotations

import json

import pytest
from noticeloom.sources import bids
from noticeloom.sources.records import Source
from pyspark.sql import functions as F



def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def answer(ids, total=None, code=200, **more):
    return json.dumps({"code": code, "response": {"response": {"numFound": total, "docs": [{"b_id": [i], "b_bid_number": [f"N/{i}"], **more} for i in ids]}}})


SOURCES = {
    "short": ([answer([1, 2]), answer([3]), answer([4, 5])], "short page", [1, 2]),
    "total": ([answer([1, 2], 4), answer([3, 4]), answer([5, 6])], "total", [1, 2]),  # the total is told once
    "again": ([answer([1, 2]), answer([2, 1]), answer([3, 4])], "nothing new", [1]),
    "empty": ([answer([1, 2]), answer([]), answer([3, 4])], "empty", [1]),
    "code": ([answer([1, 2]), answer([3, 4], code=500), answer([5, 6])], "error", [1]),
    "text": ([answer([1, 2]), "<html>\n<p>no</p>\n</html>", answer([5, 6])], "error", [1]),
    "cap": ([answer([1, 2]), answer([3, 4]), answer([5, 6]), answer([7, 8])], "cap", [1, 2, 3]),
    "hole": ([answer([1, 2]), None, answer([5, 6])], "missing page", [1]),
    "partly": ([answer([1, 2]).replace(", ", ",\n"), answer([2, 3]), answer([4])], "short page", [1, 2, 3]),
}


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    for name, (pages, _, _) in SOURCES.items():
        for i, body in enumerate(pages, 1):
            if body is not None:
                (root / f"source={name}" / f"page={i}").mkdir(parents=True)
                (root / f"source={name}" / f"page={i}" / "answer.json").write_text(body, encoding="utf-8")
    return bids.landed_pages(spark, str(root))


def test_every_rule_that_ends_paging(landed):
    rows = bids.with_stops(bids.answers(landed), size=2, cap=3).collect()
    for name, (_, rule, used) in SOURCES.items():
        own = sorted((r.page, r.used, r.stop) for r in rows if r.source == name)
        assert [p for p, u, _ in own if u] == used and [s for _, _, s in own if s] == [rule], name


def test_first_records_of_the_pages_used(landed):
    got = sorted((r.source, r.id, r.page) for r in bids.bid_docs(landed, size=2, cap=3).collect() if r.source in ("partly", "again"))
    assert got == [("again", "N/1", 1), ("again", "N/2", 1), ("partly", "N/1", 1), ("partly", "N/2", 1), ("partly", "N/3", 2), ("partly", "N/4", 3)]


def test_records_say_what_is_written(spark):
    docs = [
        {"b_id": [7], "b_bid_number": ["GEM/7"], "b_bid_type": [1], "b_category_name": ["Chairs", "x"], "b_buyer_status": [2], "b_total_quantity": [4.0], "final_start_date_sort": "2026-01-05T10:00:00Z", "b_cat_id": ["services_home"]},
        {"b_id": [8], "b_bid_number": [], "b_bid_type": "5", "bbt_title": ["T &amp; t"], "b_id_parent": [3], "b_bid_number_parent": ["GEM/3"], "ba_official_details_minName": ["M"], "ba_official_details_deptName": ["D"], "is_high_value": [True], "is_rc_bid": [1], "ba_is_global_tendering": 1},
        {"b_id": [9], "b_bid_type": [2], "b_eval_type": [1], "bd_category_name": ["Item"], "b_category_name": "Desks", "b_buyer_status": [9], "b_total_quantity": [2.5], "b_id_parent": 4}, {"b_id": [None]}, {},
    ]
    df = spark.createDataFrame([("s", json.dumps(d)) for d in docs], "source string, doc string")
    rows = sorted(bids.bids(df, "https://b", "https://b/all", now()).collect(), key=lambda r: r.identity.source_tender_id)
    assert [r.identity.source_tender_id for r in rows] == ["GEM/7", "bid:8", "bid:9"] and [r.status for r in rows] == ["closed", "active", "unknown"]
    one, two, three = rows
    assert (one.procurement.title, one.procurement.procurement_type, one.procurement.description, one.identity.reference_number) == ("Chairs", "services", "Quantity: 4", None)
    assert [d.source_url for d in one.documents] == ["https://b/showbidDocument/7"] and one.organization.authority is None
    assert str(df.sparkSession.range(1).select(F.date_format(F.lit(one.dates.published_at), "yyyy-MM-dd HH:mm")).first()[0]) == "2026-01-05 04:30"  # Indian time
    assert (two.procurement.title, two.procurement.procurement_type, two.identity.reference_number, two.organization.authority) == ("T & t", "auction", "GEM/3", "M — D")
    assert two.procurement.description == "High-value bid; Global tender enquiry; Rate contract bid; Reverse auction on bid GEM/3"
    assert [(d.title, d.source_url) for d in two.documents] == [("Reverse auction document (official PDF)", "https://b/showdirectradocumentPdf/8"), ("Parent bid document (GEM/3)", "https://b/showbidDocument/3")]
    assert (three.procurement.title, three.procurement.category, three.procurement.description) == ("Item", "Desks", "Quantity: 2.5; Item details: Item")
    assert [(d.title, d.source_url) for d in three.documents] == [("Reverse auction document (official PDF)", "https://b/list-ra-schedules/9"), ("Parent bid document", "https://b/showbidDocument/4")]


def test_sources_are_read_by_family(spark, landed):
    assert bids.read_source(landed, Source("short", "gem", "https://b", options={"page_size": 2}), now()).count() == 3
    with pytest.raises(PermissionError):
        bids.read_source(landed, Source("short", "gem", "https://b", status=bids.RESTRICTED), now())
    assert bids.read_source(landed, Source("short", "gem", "https://b", status=bids.RESTRICTED), now(), restricted=True).count() == 2
    with pytest.raises(ValueError):
        bids.read_source(landed, Source("short", "other", "https://b"), now())
    page = "<table><tr><th>S.No</th></tr><tr><td>1</td><td>1234567</td><td>Rails</td><td></td><td>closes 05/01/2026 15:00 hrs</td></tr><tr><td>2</td><td>no</td><td>Sleepers</td><td>x</td></tr><tr><td>x</td><td>1</td><td>2</td><td>3</td></tr></table>"
    pages = spark.createDataFrame([("zone", 1, page), ("zone", 2, None)], "source string, page int, body string")
    for family in bids.FAMILIES:
        assert bids.read_source(pages, Source("zone", family, "https://z", options={}), now()).columns
    found = bids.read_source(pages, Source("zone", "ireps", "https://z"), now())
    assert [tuple(r)[1:] for r in found.collect()] == [("1", "1234567", "1234567 | Rails", "05-01-2026 15:00"), ("2", None, "no | Sleepers | x", None)]
    rows = bids.listings.zone_notices(found, F.lit("NR")).orderBy("source_tender_id").collect()
    assert [(r.source_tender_id, r.closing_at is None) for r in rows] == [("1234567", False), ("ireps:NR:2", True)]


def test_crawl_of_included_states(spark):
    df = spark.createDataFrame([("a", 1, "Goa"), ("a", 0, "Kerala"), ("b", 2, None), ("c", 3, "Goa"), (None, 4, "Goa")], "k string, o int, state string")
    got = lambda **how: sorted((r.k or "", r.o) for r in bids.crawled(df, "k", "o", **how).collect())
    assert got() == [("", 4), ("a", 0), ("b", 2), ("c", 3)] and got(include=("Goa",)) == [("", 4), ("a", 1), ("c", 3)] and got(skip=("Goa",)) == [("a", 0), ("b", 2)]


def test_windows_over_pages_do_not_hold_their_records(spark, landed):
    found = bids.with_stops(bids.answers(landed), 2)
    text = spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    sections = [part for part in text.split("\n\n") if ") Window" in part.split("\n")[0]]
    assert sections and not any("docs#" in part for part in sections)
    twice = bids.with_stops(bids.answers(landed.unionByName(landed)), 2)  # a page that landed twice stays two rows
    assert twice.count() == 2 * found.count() and twice.columns == found.columns
