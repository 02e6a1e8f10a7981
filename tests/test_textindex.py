"""The stored inverted index against the scan, near words against all edit distances, and what a query reads."""

from __future__ import annotations

import random

import pytest
from noticeloom.operators import search, textindex
from pyspark.sql import functions as F

KIND = "id string, ref string, title string, tender_number string, authority string, category string, state string, city string"


def near(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def notices(spark):
    r = random.Random(8)
    words = ["road", "raod", "roads", "bridge", "bridges", "water", "wafer", "pump", "x1", "supply", "maintenance", "maintenence", "electrification", "electrifcation", "internationalisation", "é"]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randint(0, n)))
    rows = [(f"id{i}", f"REF/{i % 40}", text(12), f"T-{i}", f"{text(3)}› {text(2)}|{text(1)}", text(1) or None, r.choice(["Goa", None]), None) for i in range(300)]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def index(notices, tmp_path_factory):
    return textindex.build_index(notices, str(tmp_path_factory.mktemp("index") / "i"))


@pytest.mark.parametrize("asked", ["road bridge", "raod", "Maintanance water", "ref/7", "T-12", "id5", "x2", "electrificatoin", "internationalizaton", "zzzz", "", " ", "r", "ro_ad é", "bridge qqqq"])
def test_index_equals_the_scan(notices, index, asked):
    rounded = lambda df: sorted((r[0], round(r[1], 9)) for r in df.select("id", "score").collect())
    assert rounded(textindex.search_hits_index(index, asked)) == rounded(search.search_hits(notices, asked))
    boosts = {"title": 2.0, "category": 1.0}
    assert rounded(textindex.search_index(index, asked, boosts)) == rounded(search.search(notices, asked, boosts))


def test_near_words_by_deletions_equal_all_distances(spark, tmp_path):
    r = random.Random(9)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 15))) for _ in range(700)} | {"electrification", "electrifikatoin", "electrificationx"})
    index = textindex.build_index(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, title string"), f"{tmp_path}/i", ("title",))
    for term in [*r.sample(words, 12), "abcabc", "electrification"]:
        edits = search.edits_of(term, 0.2)
        for most in {edits, 2} - {0}:
            assert sorted(textindex.near_terms(index, term, most)) == [w for w in words if near(w, term) <= most and not w.startswith(term)]


def test_a_query_reads_ranges_of_terms_only(index):
    found = textindex.postings_of(index, ["road"], [["raod"]], ["title"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,road)" in plan and "EqualTo(term,raod)" in plan
    files = index.table("postings").groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("low"), F.max("term").alias("high")).orderBy("low").collect()
    assert all(x.high <= y.low for x, y in zip(files, files[1:], strict=False))  # ranges do not overlap but for a term that fills several


def test_one_word_in_every_row_fills_several_files(spark, tmp_path):
    df = spark.range(4000).select("id", F.lit("same").alias("title"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins small ones
    try:
        index = textindex.build_index(df, f"{tmp_path}/i", ("title",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = index.table("postings").select(F.input_file_name().alias("f")).distinct().count()
    assert textindex.search_index(index, "same").count() == 4000 and before >= 2


def test_rebuilt_and_empty(spark, notices, tmp_path):
    path = f"{tmp_path}/i"
    textindex.build_index(notices, path)
    index = textindex.build_index(notices.limit(0), path)
    assert index.table("postings").count() == 0 and textindex.search_hits_index(index, "road").count() == 0


def test_words_are_cut_and_counted_once_a_row(spark, tmp_path):
    texts = ["", None, " . ", "A b|a › B_c", "Ünï É é ½ ٣ 中文 x²", "İstanbul ΣΑΣ ﬁ", "7 007 7", "a" * 40]
    df = spark.createDataFrame([(i if i else None, t, t and t[::-1]) for i, t in enumerate(texts)], "id int, title string, category string").repartition(3)
    index = textindex.build_index(df, f"{tmp_path}/i", ("title", "category"))
    cells = df.select("id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), search.tokens(F.col(f)).alias("w")) for f in ("title", "category")])))
    want = cells.select("id", "field", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("term", "field", "id", "n").agg(F.count("*").cast("int").alias("tf")).select("term", "field", "id", "tf", "n")
    assert sorted(map(str, index.table("postings").collect())) == sorted(map(str, want.collect()))
    assert {r.field: (r.rows, r.mean) for r in index.table("fields").collect()} == {r.field: (r.r, r.m) for r in cells.groupBy("field").agg(F.count("*").alias("r"), F.avg(F.size("w")).alias("m")).collect()}


def test_numbers_have_no_variants_and_are_found_near(spark, tmp_path):
    """They grow with the rows: 37 variants of each number of 8 digits."""
    index = textindex.build_index(spark.createDataFrame([(i, str(10_000_000 + i)) for i in range(50)] + [(90, "word 12 1a")], "id int, title string"), f"{tmp_path}/i", ("title",))
    assert sorted(r.term for r in index.table("variants").select("term").distinct().collect()) == ["1a", "word"]
    words = [r.term for r in index.table("terms").collect()]
    for term in ("10000003", "1000000x", "1b", "ab", "abc", "wrod"):
        assert sorted(textindex.near_terms(index, term, 2)) == sorted(w for w in words if near(w, term) <= 2 and not w.startswith(term))
