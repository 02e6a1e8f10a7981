"""Sharding, URL rules, HTML text, top-k products, and the pipeline's stages."""

from __future__ import annotations

import math
import operator
import random
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from noticeloom.llm import htmltext, queries, sharding, topk, urlrules
from pyspark.sql import functions as F

from .conftest import DOCS, prose, rows


def test_shards_are_even_and_stay_when_one_goes(spark):
    names = [f"s{i}" for i in range(7)]
    table = {r.slot: r.shard for r in sharding.lookup_table(spark, names, 701).collect()}
    assert sorted(table) == list(range(701)) and max(Counter(table.values()).values()) - min(Counter(table.values()).values()) <= 1
    less = {r.slot: r.shard for r in sharding.lookup_table(spark, names[:-1], 701).collect()}
    moved = sum(table[s] != less[s] for s in table if table[s] != "s6")
    assert moved < 0.2 * 701
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 700)


def test_shard_of_odd_rows(spark, odd_docs, no_docs):
    got = sharding.place(odd_docs, "doc_id", ["a", "b", "c"], 101).collect()
    assert len(got) == odd_docs.count() and all(r.shard in "abc" for r in got)
    assert len({r.shard for r in got if r.doc_id == 6}) == 1 and len({r.slot for r in got if r.doc_id is None}) == 1
    assert sharding.place(no_docs, "doc_id", ["a"], 11).count() == 0


def judged(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_against_every_rule(spark):
    r = random.Random(2)
    labels = ["com", "net", "a", "b", "example", "www"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "en", "7", "x/"]) for _ in range(r.randint(0, 5)))
    rules = sorted({(host(), "/" + path(), "block") for _ in range(25)} | {(host(), "", "allow") for _ in range(4)})
    rules = [(h, p, r.choice(["allow", "block"])) for h, p in sorted({(h, p) for h, p, _ in rules})]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{host().upper() if r.random() < 0.3 else host()}{'/' + path() if r.random() < 0.9 else ''}{r.choice(['', '?q=/en', '#/7', '?a://b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "x://a.b?c", "http://com/en/\n7", "a://b://c/d", urls[0], urls[0]]
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    known = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    want = {i: judged(u, rules) for i, u in enumerate(urls)}
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlrules.judge_urls(table, known).collect()} == want
    odd = table.withColumnRenamed("host", "Host").withColumn("_key", F.lit("k")).withColumn("Reversed_Host", F.lit("r")).withColumn("range_number", F.lit("n"))
    got = urlrules.judge_urls(odd, known)
    assert got.columns == ["page_id", "url", "_key", "Reversed_Host", "range_number", "host", "path", "rule", "verdict"]
    got = got.collect()
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got} == want and {(x._key, x.Reversed_Host, x.range_number) for x in got} == {("k", "r", "n")}
    assert urlrules.judge_urls(table.limit(0), known).count() == 0
    assert {x.verdict for x in urlrules.judge_urls(table, known.limit(0)).collect()} == {"allow"}


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    assert queries.URL_RULES == [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    urls = ["http://a.net/de/x", "http://www.example.net/de/9", "http://example.net/de/8", "http://b.com/en/1", "http://m.example.com/en/71", "http://c.org/es/", "http://c.org/de/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op2_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(urls))] == [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]


def test_a_hot_url_fills_several_ranges(spark):
    urls = [(i, "http://www.example.com/en/7") for i in range(3000)] + [(3000 + i, f"http://h{i}.example.{'net' if i % 2 else 'org'}/de/{i}") for i in range(600)]
    rules = [("com", "/en", "block"), ("example.com", "/en/7", "allow"), ("net", "/", "block"), *((f"h{i}.example.org", f"/de/{i}", "block") for i in range(0, 600, 4))]
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(4)
    got = urlrules.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).withColumn("task", F.spark_partition_id())
    rows_ = got.collect()
    assert sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in rows_) == sorted((i, *judged(u, rules)) for i, u in urls)
    hot = Counter(x.task for x in rows_ if x.page_id < 3000)
    assert len(hot) >= 3 and max(hot.values()) < 2000


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="ad">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div id="cookie-notice">We use cookies</div><!-- <p>gone</p> -->
<article><header><h1>Head &eacute;</h1><p>by me</p></header><p>One&nbsp;<b>bold  <i>x</i></b><br>next
line<p>Two &lt;tag&gt; &amp; &#x41; &amp<div class="share-box"><p>Share</p></div><aside>side</aside><form><p>name</p></form><ul><li>a</li><li>b</li></ul></article>
<section class="comments"><article class="comment"><p>first!</p></article></section><footer>&copy; me</footer>"""


def test_article_of_a_page():
    assert htmltext.extract([PAGE])[0][0] == "Head é\n\nOne bold x next line\n\nTwo <tag> & A &\n\na\n\nb"
    assert [t for t, _ in htmltext.extract([None, "", "just text", "<p>a<p>b", "<article>x", "<"])] == ["", "", "just text", "a\n\nb", "x", "<"]


def test_no_text_is_lost_to_odd_markup():
    one = lambda page: htmltext.extract([page])[0][0]
    assert one('<div class="layout no-sidebar"><p>a b</p></div>') == "a b"
    assert one('<div class="has-menu page"><p>a</p></div>') == "a"
    assert one('<div class="main-banner-layout"><article><p>a</p></article></div>') == "a"
    assert one('<div class="post-widget"><p>all there is</p></div>') == "all there is"
    assert one('<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>') == "so x=1 holds"
    for tag in ("svg", "select", "object", "iframe", "noscript"):
        assert one(f"<article><p>a</p><{tag}><p>b</p></article>") == "a\n\nb"
        assert one(f"<article><p>a</p><{tag}><p>no</p></{tag}><p>b</p></article>") == "a\n\nb"
    assert one("<article><p title=it's>a</p><p>b 'c'</p></article>") == "a\n\nb 'c'"
    assert one('<article><p title="x>y">a</p><p title=\'>\'>b</p><p title="never closed>c</p></article>') == "a\n\nb\n\nc"
    assert one("<article><p>a</p><!-- open <p>b</p></article>") == "a\n\nb"
    assert one("<p>1 < 2</p>") == "1 < 2"


def test_what_stands_around_or_in_an_article_by_its_text():
    one = lambda page: htmltext.extract([page])[0][0]
    story = "a long story with many words that goes on and on " * 8
    assert one('<form id="aspnetForm"><div><p>whole page body</p></div></form>') == "whole page body"
    assert one(f'<form><input type="hidden" name="v"><input type="text"><p>{story}</p></form>') == story.strip()
    assert one('<p>text</p><form><label>name</label><input><button>go</button></form>') == "text"
    assert one("<article><p>a</p><form><p>mail me</p><textarea>x</textarea></form></article>") == "a"
    assert one("<form><article><p>a</p></article><input></form>") == "a"
    assert one('<article class="menu"><p>all there is</p></article>') == "all there is"
    assert one('<article><p>the story</p></article><article class="promo"><p>other</p></article>') == "the story"
    for tag in ("nav", "aside"):
        assert one(f"<{tag}><a>menu</a><article><p>story</p></article><{tag}>more</{tag}>") == "story"  # the first is never closed
        assert one(f"<{tag}><article><p>a card</p></article></{tag}><article><p>story</p></article>") == "story"
    assert one('<article><p hidden>x</p><p style="display:none">y</p><p aria-hidden="true">z</p></article>') == "x\n\ny\n\nz"
    assert one(f'<p>a line</p><div class="post-widget-area"><p>{story}</p></div>') == f"a line\n\n{story.strip()}"
    assert one(f'<p>{story}</p><div class="post-widget-area"><p>a line</p></div>') == story.strip()
    assert one(f'<article><p>story</p><section id="responses"><article><p>{story}</p></article></section></article>') == "story"
    assert one(f'<p>story</p><div class="post-comments-area"><p>{story}</p></div>') == "story"


def test_a_page_of_open_menus_takes_linear_time():
    began = time.time()
    htmltext.blocks("<aside><article><p>x</p></article></aside>" * 20_000)
    htmltext.blocks("<nav>x<article><p>y</p></article>" * 20_000)
    assert time.time() - began < 20


def test_a_page_of_open_quotes_takes_linear_time():
    began = time.time()
    htmltext.blocks('<p title="' * 200_000)
    htmltext.blocks("<p a='" * 100_000 + "<svg>" * 50_000)
    assert time.time() - began < 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffixes_and_their_common_prefixes_equal_a_plain_sort(tokens):
    order, levels = htmltext.suffix_array(np.array(tokens, np.int64))
    want = sorted(range(len(tokens)), key=lambda i: tokens[i:])
    assert order.tolist() == want
    shared = htmltext.common_prefixes(order, levels).tolist()
    for k in range(1, len(want)):
        a, b = tokens[want[k - 1] :], tokens[want[k] :]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a b c d e f g h", "h g f e d c b a", "x", "y z", "p q r s t u v w x y", "one two three"]), max_size=5).map(" ".join), min_size=1, max_size=7))
def test_unique_runs_equal_a_search_for_substrings(texts):
    """Brute force: a token goes if some 8 tokens around it stand, one after another, on 3 pages."""
    want = []
    for text in texts:
        words = text.split()
        gone = [False] * len(words)
        for i in range(len(words) - htmltext.REPEAT + 1):
            part = f" {' '.join(words[i : i + htmltext.REPEAT])} "
            if sum(part in f" {other} " for other in texts) >= htmltext.MIN_PAGES:
                gone[i : i + htmltext.REPEAT] = [True] * htmltext.REPEAT
        runs = "".join("\n" if g else f"{w} " for w, g in zip(words, gone, strict=True)).split("\n")
        want.append(("\n\n".join(x.strip() for x in runs if x.strip()), sum(gone)))
    assert htmltext.extract([f"<div>{t}</div>" for t in texts]) == want


def test_repetition_marks_what_surrounds_an_article_too():
    page = lambda i: f"<div>home news sport weather travel music films books</div><article><p>story {i} begins here and goes on</p></article>"
    assert htmltext.extract([page(i) for i in range(4)]) == [(f"story {i} begins here and goes on", 8) for i in range(4)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"<>/p ab&;!-\"'=", "<p>", "</p>", "<article>", "<script>", "</div>"]), max_size=60).map("".join))
def test_no_markup_crashes(page):
    htmltext.extract([page, page])


def test_repeated_runs_go_and_unique_ones_stay(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    pages = [(i, "http://h.example/x", f"<div>our menu has these nine fixed words each time</div><div>{body(i)}</div><div>all rights reserved by the owners of this site</div>") for i in range(40)]
    pages += [(100 + i, "http://other.example/", f"<article><p>shared passage that many pages print in full here</p><p>{body(i)}</p></article>") for i in range(10)]
    got = {r.page_id: r for r in htmltext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == body(i) and got[i].n_repeated > 0 for i in range(40))
    assert all(got[100 + i].text.startswith("shared passage") and got[100 + i].n_chars == len(got[100 + i].text) for i in range(10))


def test_slices_of_a_large_host_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "SLICE_PAGES", 8)
    pages = [(i, "http://big.example/", f"<p>text {i}</p>") for i in range(50)] + [(None, None, None), (7, "x", ""), (7, "x", ""), (8, "http://big.example/", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("c")).withColumn("n", F.lit(1))
    got = htmltext.main_text(df).collect()
    assert len(got) == len(pages) and max(r.n_chars for r in got) == 5 * 200_000 - 1
    assert {r.text for r in got if r.page_id is not None and r.page_id < 7} == {f"text {i}" for i in range(7)}
    assert htmltext.main_text(df.limit(0)).count() == 0


def brute_top(vectors, k):
    """Rows, not ids: repeated rows and ids count each."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (q, x) in enumerate(whole):
        if q % 50 == 0:
            scores = sorted((-min(max(sum(map(operator.mul, x, y)), 1 - 2**63), 2**63 - 1), i) for b, (i, y) in enumerate(whole) if a != b and len(x) == len(y))
            out.update((q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1))
    return out


def test_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8))
    vectors = [(i, [float(x) for x in centres[i % 6] * r.uniform(0.2, 2) + 0.05 * r.normal(size=8)]) for i in range(600)]
    vectors += [(600 + i, [1.0] * 8) for i in range(150)]  # one very frequent vector, with ties
    vectors += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, []), (1250, [0.5, 0.5]), (1251, [0.25, 0.5]), (1300, [0.0] * 8), (1350, [-1.0] * 8), (None, [1.0] * 8)]
    vectors += [(50, [2.0] * 8), (50, [-2.0] * 8), (7, [3.0] * 8), (7, [3.0] * 8), (7, [3.0] * 8), (100, vectors[100][1])]  # repeated ids and rows
    vectors += [(1400, [1e16] + [0.0] * 7), (1401, [1e16, 1.0] + [0.5] * 6), (1450, [1e12, -1e12] + [1.0] * 6)]  # long, but finite
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit("c")).withColumn("row", F.lit("c"))
    got = Counter(tuple(x) for x in topk.top_products(df, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(vectors, 5)
    assert topk.top_products(df.limit(0), F.lit(True), 5).count() == 0


def test_short_buckets_are_not_searched(spark, monkeypatch):
    """The k-th score among the longest vectors keeps queries from buckets that cannot reach it."""
    seen, search = [], topk.search_bucket
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.uniform(0.5, 1, 6) * (100 if i < 200 else 0.5)]) for i in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "_search", lambda cells, asked, *a, s=topk._search: (seen.append(asked.groupBy("bucket").count().collect()), s(cells, asked, *a))[1])
    got = Counter(tuple(x) for x in topk.top_products(df, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(vectors, 5)
    every = {x.bucket for x in topk.integer_vectors(df, F.lit(True), "vec_id", "embedding", 256).select(F.floor(F.log2("norm") * 8).alias("bucket")).distinct().collect()}
    assert len({x["bucket"] for x in seen[1]}) < len(every)
    assert search is topk.search_bucket


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    insult = "scum"
    docs = [(i, prose(i, 80)) for i in range(60)] + [(100 + i, f"{prose(500 + i, 40)} {insult} {prose(600 + i, 40)} {insult} trash") for i in range(40)]
    docs += [(200 + i, " | ".join(prose(700 + i, 60).split())) for i in range(40)]
    item = prose(9999, 20)
    docs += [(300, prose(0, 80)), (301, prose(1, 80) + " extra"), (302, f"{prose(801, 50)} {item} {prose(802, 50)}"), (303, None), (304, "")]
    labels = [(i, int(not 200 <= i < 300), int(100 <= i < 200)) for i, _ in docs]
    spark.createDataFrame(rows(docs), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, table = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        table = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept.append({r.doc_id for r in table.select("doc_id").collect()})
        assert name == "packing" or table.columns == columns
    before = {i for i, _ in docs}
    gone = [a - b for a, b in zip([before, *kept], kept, strict=False)]
    assert gone[0] == set(range(100, 140)) and set(range(200, 240)) <= gone[1] and not gone[1] & set(range(60))
    assert gone[2] == {300, 301} and gone[3] == {302} and gone[4] == set()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == kept[-1]


def test_cells_that_no_query_asks_for_are_not_copied(spark):
    dealt = spark.createDataFrame([(4, b, p, 10 * b + p, b, [1.0]) for b in range(3) for p in range(2)], "dim int, bucket int, part int, row long, id int, v array<double>")
    asked = spark.createDataFrame([(4, 1, 0, "x"), (4, 1, 0, "x"), (4, 1, 0, "y"), (4, 2, 1, "y")], "dim int, bucket int, part int, block string")
    assert sorted((r.bucket, r.part, r.block) for r in topk.wanted_cells(dealt, asked).collect()) == [(1, 0, "x"), (1, 0, "y"), (2, 1, "y")]


def test_every_query_is_registered():
    assert sorted(queries.QUERIES) == sorted([*(f"op{n}_{x}" for n, x in ((1, "sharding"), (2, "url_filter"), (3, "packing"), (4, "html_text"), (5, "quality"), (6, "minhash_dedup"), (7, "toxicity"), (8, "lm_score"), (9, "decontamination"), (10, "topk"), (11, "lexical_search"), (12, "simhash_dedup"), (13, "vector_codes"))), "pipeline"])


def test_runs_are_counted_over_all_slices_of_a_host(spark, monkeypatch):
    """A notice on 4 of 60 pages, rarely twice in a slice, goes, also from a block that is mostly unique; a page given 3 times stays."""
    monkeypatch.setattr(htmltext, "SLICE_PAGES", 4)
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    notice = "this rare notice stands on four of many pages"
    pages = [(i, "http://h.example/x", f"<div>{body(i)} {notice if i % 15 == 0 else ''}</div>") for i in range(60)] + [(99, "http://h.example/x", f"<div>{body(99)}</div>")] * 3
    got = htmltext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 63 and all(r.text == body(r.page_id) for r in got)
