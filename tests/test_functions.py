from __future__ import annotations

from datetime import datetime

import pytest
from noticeloom.functions import amounts, dates, ids, text
from pyspark.sql import functions as F


def apply(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r.o for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_amounts(spark):
    raw = ["Rs 2.45 Cr", "₹ 5 crore", "INR 1.2 crores", "Rs. 12,34,567.50", "about 3 lakhs", "₹10 lakh", "no money", None, "", "Rs 0", "room 12"]
    assert apply(spark, raw, amounts.parse_amount) == [24500000.0, 50000000.0, 12000000.0, 1234567.5, 300000.0, 1000000.0, None, None, None, None, None]
    assert apply(spark, ["1,23,456", " 12.5 ", "12a", "", None, "1,234,567", "₹ 12,34,567.89", "Rs. 500", "INR 7", "0"], amounts.parse_plain_number) == [123456.0, 12.5, None, None, None, 1234567.0, 1234567.89, 500.0, 7.0, None]
    values = [25000000.0, 320000.0, 5000.0, None, 10625000.0]
    assert apply(spark, values, amounts.format_compact, "double") == ["₹2.50 Cr", "₹3.20 L", "₹5,000", None, "₹1.06 Cr"]
    assert apply(spark, [25000000.0, 320000.0, 20000000.0], amounts.format_trimmed, "double") == ["₹2.5 Cr", "₹3.2 L", "₹2 Cr"]
    assert apply(spark, [1234567.0, 999.0, 100000.0, 12345678.4], amounts.format_grouped, "double") == ["₹12,34,567", "₹999", "₹1,00,000", "₹1,23,45,678"]


def test_datetimes(spark):
    raw = ["05-Aug-2026 03:30 PM", "05-Aug-2026", "5/8/2026 15:30", "2026-08-05 10:00:00", "5 Aug 2026", "5 August 2026", "2026-08-05T10:00:00Z", "2026-08-05T10:00:00+05:30", "NA", " - ", "", None, "soon", "05.08.2026 09:15"]
    got = apply(spark, raw, lambda c: F.date_format(dates.parse_datetime(c), "yyyy-MM-dd HH:mm"))
    assert got == ["2026-08-05 10:00", "2026-08-04 18:30", "2026-08-05 10:00", "2026-08-05 04:30", "2026-08-04 18:30", "2026-08-04 18:30", "2026-08-05 10:00", "2026-08-05 04:30", None, None, None, None, None, "2026-08-05 03:45"]


def test_days_floor_and_ceil(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    at = [datetime(2026, 1, 9, 23), datetime(2026, 1, 10, 1), datetime(2026, 1, 17), None]
    assert apply(spark, at, lambda c: dates.days_until(c, now), "timestamp") == [-1, 0, 7, None]
    assert apply(spark, at, lambda c: dates.days_remaining(c, now), "timestamp") == [0, 1, 7, None]
    assert apply(spark, at, lambda c: dates.deadline_bucket(c, now), "timestamp") == ["urgent", "urgent", "soon", None]
    assert apply(spark, at, lambda c: dates.relative_deadline(c, now), "timestamp") == ["Closes today", "1 day left", "7 days left", "No deadline"]
    end = spark.range(1).select(F.date_format(dates.ist_month_end(F.lit("2026-01-31 20:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss.SSS").alias("e")).first().e
    assert end == "2026-02-28 18:29:59.999"


def test_portal_timestamps(spark):
    got = apply(spark, ["1767225600000", "1767225600", "2026-01-01T05:30:00Z", "x", None], lambda c: F.date_format(dates.portal_timestamp(c), "yyyy-MM-dd HH:mm"))
    assert got == ["2026-01-01 00:00", "2026-01-01 00:00", "2026-01-01 00:00", None, None]


def test_texts(spark):
    assert apply(spark, ["a &amp;amp; b", "x  y\t z", "  ", None, "1\n\n\n\n2", "l" * 20], lambda c: text.clean_text(c, 10)) == ["a & b", "x y z", None, None, "1\n\n2", "l" * 10 + "…"]
    assert apply(spark, ["../a/b c?.pdf", "", None, "...", "a__b_._c", "C:\\x\\y.zip"], text.safe_filename) == ["b_c.pdf", "download.bin", "download.bin", "download.bin", "a_b.c", "y.zip"]
    assert apply(spark, ["=1+1", "-x", "@y", "ok", "\tz"], text.csv_guard) == ["'=1+1", "'-x", "'@y", "ok", "'\tz"]
    assert apply(spark, ["Road & Bridge (Ph-2)", None, "सड़क X!"], text.normalise_title)[:2] == ["road bridge ph 2", ""]
    assert apply(spark, ["A||B || ||C", "A"], text.org_chain) == ["A › B › C", "A"]
    block = apply(spark, ["Road works [2026_XY_1_2] [REF/1]", "[Only title] [R][2026_XY_1_2]", "[T]", "plain", "Road [REF/2]"], text.split_title_block)
    assert [(b.title, b.ref, b.native) for b in block] == [("Road works", "REF/1", "2026_XY_1_2"), ("Only title", "R", "2026_XY_1_2"), ("T", None, None), ("plain", None, None), ("Road", "REF/2", None)]
    assert apply(spark, ["a;b,c\nd"], text.ics_escape) == ["a\\;b\\,c\\nd"]
    assert apply(spark, ["feeds/all.xml", "../x", "http://x", "/abs"], text.feed_href) == ["feeds/all.xml", None, None, None]
    assert apply(spark, ["x\u0001y퟿"], text.xml_legal) == ["xy퟿"]
    assert apply(spark, ["J&K", " Jammu  and Kashmir ", None], text.state_key) == ["j and k", "jammu and kashmir", ""]
    assert apply(spark, ["<img src=CaptchaImage>", "ok", None], text.captcha_seen) == [True, False, False]
    assert apply(spark, ["a/b_c-d e", ""], text.term_count) == [5, 0]


def test_ids(spark):
    import hashlib

    df = spark.createDataFrame([("gem", "GEM/1", "T", "R"), ("gem", " ", "T", "R")], "s string, i string, t string, r string")
    got = df.select(ids.canonical_id(F.col("s"), F.col("i")).alias("c"), ids.fallback_id(F.col("i"), F.col("t"), F.col("r")).alias("f")).collect()
    assert got[0].c == hashlib.sha256(b"gem::GEM/1").hexdigest()[:24] and got[0].f == "GEM/1"
    assert got[1].f == "hash:" + hashlib.sha256(b"T|R").hexdigest()[:16]


@pytest.mark.parametrize("pin, state", [("110001", "Delhi"), ("160017", "Chandigarh"), ("160055", "Punjab"), ("396230", "Dadra and Nagar Haveli and Daman and Diu"), ("396001", "Gujarat"), ("682555", "Lakshadweep"), ("403 001", "Goa"), ("605001", None), ("012345", None), ("11000", None), ("744101", "Andaman and Nicobar Islands"), ("814112", "Jharkhand"), ("246001", "Uttarakhand"), ("244001", None), ("262001", "Uttarakhand"), ("829001", "Jharkhand"), ("823001", "Bihar")])
def test_pins(spark, pin, state):
    from noticeloom.operators.geo import pin_state

    assert apply(spark, [pin], pin_state) == [state]
