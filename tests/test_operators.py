from __future__ import annotations

import random
from difflib import SequenceMatcher
from functools import reduce

import pytest
from noticeloom.operators import chunks, dedupe, filters, geo, graph, health, match, merge, publish, queue, search, snapshots, workspace
from noticeloom.sources import listings, records
from noticeloom.streaming import incremental
from pyspark.sql import functions as F


def test_components_equal_union_find(spark):
    r = random.Random(1)
    for edges in ([], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(99, i) for i in range(30)], [(r.randrange(80), r.randrange(80)) for _ in range(60)]):
        root: dict = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a is not None and b is not None and a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        got = {row.node: row.root for row in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        groups = lambda of: sorted(sorted(n for n in of if of[n] == g) for g in set(of.values()))
        assert groups(got) == groups({n: find(n) for n in root})


def test_query_text():
    q = search.parse_query("road works in Kerala above 2 crore closing within 10 days")
    assert (q.keywords, q.state, q.min_value, q.closing_within_days) == ("road works", "Kerala", 2e7, 10)
    q = search.parse_query("under 50 lakh gem printers this month new delhi")
    assert (q.keywords, q.state, q.max_value, q.source, q.closing_this_month) == ("printers", "Delhi", 5e6, "gem_bids", True)
    q = search.parse_query("GEM/2026/B/1 this week")
    assert (q.keywords, q.source, q.closing_within_days) == ("GEM/2026/B/1", None, 7)
    q = search.parse_query("J&K 33 kV cable > 1,50 lakhs")
    assert q.state == "Jammu and Kashmir" and q.keywords == "33 kV cable" and q.min_value == 150e5
    assert search.from_url(search.to_url(q)) == q
    assert search.merge_hints(filters.Query(state="Goa"), q, {"ireps"}).state == "Goa"


def test_merge_keeps_what_is_known(spark):
    store = spark.createDataFrame([(1, "a", 5.0, 1, 2), (2, "b", None, 0, 1)], "id int, title string, value double, corrigenda int, revision int")
    fresh = spark.createDataFrame([(1, None, 7.0, 0), (3, "c", 1.0, 0), (2, "b", None, 3)], "id int, title string, value double, corrigenda int")
    out = merge.upsert(store, fresh, "id", ["title", "value", "corrigenda"], {"financial.estimated_value": "value", "procurement.title": "title", "corrigenda.count": "corrigenda"}, grown=("corrigenda",))
    got = {r.id: r for r in out.withColumn("summary", merge.change_summary(F.col("changes"))).collect()}
    assert (got[1].title, got[1].value, got[1].revision, got[1].summary) == ("a", 7.0, 3, "estimated value: 5.0 → 7.0")
    assert got[3].is_new and got[3].revision == 1 and got[3].changes == []
    assert got[2].summary == "corrigendum added (3 total)" and got[2].revision == 2 and not got[2].is_noop
    again = out.select("id", "title", "value", "corrigenda", "revision")
    replay = merge.upsert(again, fresh, "id", ["title", "value"], {"financial.estimated_value": "value"})
    assert all(r.is_noop and r.changes == [] for r in replay.collect())


def test_history_is_capped(spark):
    for old, new, want in ((0, 3, list(range(3))), (49, 1, list(range(50))), (50, 2, list(range(2, 52))), (0, 60, list(range(10, 60)))):
        df = spark.createDataFrame([(list(range(old)), list(range(old, old + new)))], "o array<int>, n array<int>")
        assert df.select(merge.append_history(F.col("o"), F.col("n")).alias("h")).first().h == want


def test_dedupe_by_reference_and_similarity(spark):
    rows = [(1, "s1", " ref/1 ", "Road works phase two", "PWD", "Goa", "2026-01-01 10:00:00"), (2, "s1", "REF/1", "x", "PWD", "Goa", None), (3, "s2", "Ref/1", "y", "Z", "Goa", None),
            (4, "s3", None, "Road works phase 2", "pwd", "Goa", "2026-01-01 12:00:00"), (5, "s3", None, "Road works phase two", "PWD", "Goa", "2026-01-01 23:00:00")]
    df = spark.createDataFrame(rows, "id long, source string, ref string, title string, authority string, state string, closing_at string").withColumn("closing_at", F.col("closing_at").cast("timestamp"))
    links = dedupe.reference_links(df, F.col("ref")).collect()
    assert [(r.a, r.b) for r in links] == [(2, 3)]  # 1 and 2 are neighbours of one source
    similar = dedupe.similar_links(dedupe.blocked_pairs(df)).collect()
    assert [(r.a, r.b) for r in similar] == [(1, 4)] and similar[0].score >= 0.88


NOTICE = "id long, source string, ref string, title string, authority string, state string, closing_at string"


def noticed(spark, rows):
    return spark.createDataFrame(rows, NOTICE).withColumn("closing_at", F.col("closing_at").cast("timestamp"))


def test_the_forest_of_similar_links_joins_the_same_groups(spark):
    r = random.Random(21)
    titles = ["bacccbc", "bacbccc", "Bacccbc", "abcbacb", "bcbabcb", "road", "", None]  # some ratios differ by which title stands first
    forms = [(t, u) for t in titles[:5] for u in titles[:5]]
    ratio = lambda t, u: SequenceMatcher(None, t.lower(), u.lower()).ratio()
    assert any(ratio(t, u) != ratio(u, t) for t, u in forms)
    for threshold in (0.8, 0.88, 0.95):
        rows = [(r.randrange(140) if i % 9 == 0 else 200 + i, r.choice(["s1", "s2", "s3", None]), None, r.choice(titles), r.choice(["P", "p", "Q", ""]), r.choice(["Goa", "Goa", None]),
                 r.choice(["2026-01-01 05:59:59", "2026-01-01 06:00:00", "2026-01-01 12:00:00", "2026-01-03 00:00:00", None])) for i in range(260)]
        df = noticed(spark, rows)
        every = {(x.a, x.b) for x in dedupe.similar_links(dedupe.blocked_pairs(df), threshold).collect()}
        forest = {(x.a, x.b) for x in dedupe.similar_forest(df, threshold=threshold).collect()}
        groups = lambda links: sorted(map(sorted, reduce(lambda found, e: [g for g in found if not g & set(e)] + [set(e).union(*[g for g in found if g & set(e)])], links, [])))
        assert groups({e for e in every if e[0] != e[1]}) == groups({e for e in forest if e[0] != e[1]}) and 0 < len(forest) < len(every) and forest <= every


def test_links_of_copies_grow_with_the_rows(spark, monkeypatch):
    from noticeloom.plans import landed

    n, given = 300, []
    rows = [(i, f"portal_{i % 4}", None, "Road works", "PWD", "Goa", "2026-01-01 10:00:00") for i in range(n)]
    monkeypatch.setattr(landed, "notices", lambda *_: noticed(spark, rows))
    whole = dedupe.duplicate_groups
    monkeypatch.setattr(dedupe, "duplicate_groups", lambda links: (given.append(links.count()), whole(links))[1])
    found = landed.q_dedupe_links(spark, "").collect()
    assert sorted((x.id, x.possible_duplicate_group, x.members) for x in found) == [(i, "dup:0", n) for i in range(n)]
    assert given[0] <= 2 * n + 50  # all pairs are 33,750


def test_components_by_contraction_equal_union_find(spark, monkeypatch):
    r = random.Random(14)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {}
    for x in root:
        want.setdefault(find(x), set()).add(x)
    monkeypatch.setattr(graph, "REMNANT", 3)  # so that rounds of contraction come first
    found = {}
    for row in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        found.setdefault(row.root, set()).add(row.node)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_reference_links_over_ranges_equal_neighbours_in_plain_python(spark):
    r = random.Random(13)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (0, 1, 400):
            rows = [(f"k{i:03d}", r.choice(["s1", "s2", None]), r.choice(["na"] * 5 + [f" r{j}" for j in range(40)] + [None, " "])) for i in range(n)]
            groups = {}
            for k, source, ref in sorted(rows, key=lambda x: x[0]):
                if ref and ref.strip():
                    groups.setdefault(ref.strip().upper(), []).append((k, source))
            want = sorted((x[0], y[0]) for g in groups.values() for x, y in zip(g, g[1:]) if x[1] and y[1] and x[1] != y[1])
            df = spark.createDataFrame(rows, "id string, source string, ref string").repartition(3)
            assert sorted(tuple(x) for x in dedupe.reference_links(df, F.col("ref")).collect()) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_health_fold_and_stream_agree(spark, tmp_path):
    r = random.Random(4)
    runs = [(f"s{s}", i, r.random() < 0.8, r.choice([0, 0, 5, 9]), r.random() < 0.05) for s in range(4) for i in range(30)]
    df = spark.createDataFrame(runs, "source string, run_at int, ok boolean, discovered int, captcha boolean")
    batch = {x.source: x.status for x in health.status_fold(health.with_history(df)).collect()}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = incremental.health_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("health").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {x.source: x.status for x in spark.table("health").collect()} == batch


def test_duplicates_by_phase_and_the_bound_of_the_ratio(spark):
    from difflib import SequenceMatcher

    r = random.Random(12)
    titles = ["".join(r.choice("aab c1é") for _ in range(r.randint(1, 25))).strip() or "x" for _ in range(120)]
    pairs = spark.createDataFrame([(i, j, 0, titles[i], titles[j]) for i in range(120) for j in range(i)], "a long, b long, gap_s long, title_a string, title_b string")
    want = {(a, b) for a in range(120) for b in range(a) if 0.45 * SequenceMatcher(None, titles[a], titles[b]).ratio() + 0.55 >= 0.8}
    asked = dedupe.within_bound(pairs, 0.8).count()
    assert {(x.a, x.b) for x in dedupe.similar_links(pairs, 0.8).collect()} == want and len(want) <= asked < pairs.count() / 2
    links = lambda *ab: spark.createDataFrame(ab, "a long, b long")
    report = dedupe.duplicate_report(links((1, 2), (2, 3), (5, 6)), links((1, 3), (3, 5), (8, 9)), exact=4).first().asDict()
    assert report == {"exact_source_id": 4, "reference_number": 3, "possible_duplicate_groups": 2}
    assert tuple(dedupe.duplicate_report(spark.createDataFrame([], "a long, b long"), links((1, 2))).first()) == (0, 0, 1)


def test_history_in_stretches_equals_the_plain_fold(spark):
    r = random.Random(11)
    runs = [(f"s{s}", i, r.random() < 0.7, r.choice([0, 0, 5]), r.random() < 0.03) for s in range(5) for i in sorted(r.sample(range(400), 120))]
    df = spark.createDataFrame(runs, "source string, run_at int, ok boolean, discovered int, captcha boolean").repartition(3)
    want, status = {}, {}
    for s, i, ok, n, captcha in runs:
        state, prior, failures = status.get(s, ("PAUSED" if s == "s1" else "EXPERIMENTAL", 0, 0))
        good = ok and n > 0
        failures = 0 if good else failures + 1
        degraded = ok and n == 0 and prior >= 3 or not ok and failures >= 2
        want[s, i] = (prior, failures, degraded)
        if captcha:
            state = "CAPTCHA_LIMITED"
        elif degraded:
            state = "DEGRADED"
        elif good:
            state = "ACTIVE" if state in health.RECOVERABLE else state
        elif not ok:
            state = "TEMPORARILY_BROKEN"
        status[s] = (state, prior + good, failures)
    for size in (1, 7, 1000):
        found = health.with_history(df, cut=F.floor(F.col("run_at") / size))
        assert {(x.source, x.run_at): (x.prior_nonzero, x.consecutive_failures, x.degraded) for x in found.collect()} == want
        folded = {x.source: (x.status, x.runs) for x in health.status_fold(found, cut=F.floor(F.col("run_at") / size)).collect()}
        assert folded == {s: (state, 120) for s, (state, _, _) in status.items() if s != "s1"} | {"s1": folded["s1"]}
    quiet = found.where("source = 's1'").select("source", "run_at", F.lit(True).alias("ok"), F.lit(0).alias("discovered"), F.lit(False).alias("captcha"), F.lit(False).alias("degraded"))
    assert health.status_fold(quiet, initial="PAUSED").first().status == "PAUSED"


def test_closed_rows_move_from_the_store_to_the_archive(spark, tmp_path):
    schema = "k string, source string, closing_at timestamp, n int"
    rows = [("a", "s", "2025-01-05", 1), ("b", "s", "2025-12-30", 2), ("c", "t", "2025-02-01", 3), ("d", "t", None, 4)]
    spark.createDataFrame(rows, "k string, source string, closing_at string, n int").withColumn("closing_at", F.col("closing_at").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    incremental.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/s", ["k"], lambda store, batch: batch, f"{tmp_path}/c").awaitTermination()
    moved = lambda: incremental.move_to_archive(spark, f"{tmp_path}/s", ["k"], f"{tmp_path}/a", F.lit("2026-01-01").cast("timestamp"), 180)
    assert moved() == 2 and {r.k for r in incremental.stored(spark, f"{tmp_path}/s").collect()} == {"b", "d"}
    assert {(r.k, r.source, r.yyyy, r.mm) for r in spark.read.parquet(f"{tmp_path}/a").collect()} == {("a", "s", 2025, 1), ("c", "t", 2025, 2)} and moved() == 0


def test_an_upsert_blanks_neither_arrays_nor_fields(spark):
    kind = "k int, docs array<string>, place struct<state: string, tags: array<int>>, v int"
    store = spark.createDataFrame([(1, ["a"], ("Goa", [1]), 5), (2, ["b"], None, None), (3, None, ("Goa", None), 1)], kind)
    fresh = spark.createDataFrame([(1, [], (None, []), None), (2, ["c", "d"], ("Kerala", [2]), 7), (4, [], (None, None), None)], kind)
    got = {r.k: (r.docs, r.place and tuple(r.place), r.v, r.is_new, r.is_noop) for r in merge.upsert(store, fresh, "k", ["docs", "place", "v"], {"v": "v"}).collect()}
    assert got == {1: (["a"], ("Goa", [1]), 5, False, True), 2: (["c", "d"], ("Kerala", [2]), 7, False, False), 3: (None, ("Goa", None), 1, False, True), 4: ([], (None, None), None, True, False)}


def test_state_that_expires_goes_to_the_archive(spark, tmp_path):
    schema = "k string, at timestamp, n int"
    days = ("2026-01-01", "2026-03-01", "2026-07-15", "2026-12-01", "2027-09-01")
    for i, keys in enumerate(("ab", "b", "c", "d", "e")):
        rows = spark.createDataFrame([(k, f"{days[i]} 00:00:00", i) for k in keys], "k string, at string, n int").withColumn("at", F.col("at").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = incremental.expired(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), ["k"], "at", 180)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider)
    # a has not been seen for 180 days when c comes; b is seen again in March and lives on until December; e is the latest
    assert sorted((r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_chunks():
    pages = [(1, "1. Scope of work\n\nThe work is large.\n\nSecond paragraph."), (2, "2.1 Terms\n\n" + "T" * 1500 + "\n\nAfter")]
    got = chunks.chunk_document(pages)
    assert [(p, h) for p, h, _ in got] == [(1, "1. Scope of work"), (2, "2.1 Terms"), (2, "2.1 Terms")]
    assert got[0][2] == "1. Scope of work\nThe work is large.\nSecond paragraph."
    assert len(chunks.chunk_document([(1, "\n\n".join("P" * 1500 for _ in range(90)))])) == 60
    assert chunks.chunk_document([(1, ""), (2, None)]) == []


LISTING = """<table><tr><th>S.No</th><th>e-Published Date</th><th>Closing</th><th>Opening</th><th>Title and Ref</th><th>Chain</th></tr>
<tr><td>1.</td><td>01-Aug-2026 09:00 AM</td><td>20-Aug-2026 03:00 PM</td><td>21-Aug-2026</td><td><a href="/t?id=1">[Road works] [R/1][2026_PWD_1_1]</a></td><td>PWD||Div 1</td></tr>
<tr><td>2.</td><td>01-Aug-2026</td><td>NA</td><td></td><td>Bridge [R/2]</td><td>PWD</td></tr><tr><td>total</td></tr>
<table><tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr></table>"""


def test_plain_markup_gives_the_same_tables_without_the_parser(monkeypatch):
    r = random.Random(12)
    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<td class=x>", "<a href='/x?id=1'>", '<a href="q" href=z>', "<a href=\"\">", "</a>", "<br>", "text ", " x\n y", "1 > 2", "é", "&amp;", "<!-- c -->", "<script>", "<TD>", "<br/>"]
    for _ in range(2000):
        page = "".join(r.choice(pieces[: r.choice([17, 22])]) for _ in range(r.randint(0, 25)))
        parser = listings._Tables()
        parser.feed(page)
        parser.close()
        assert listings.tables(page) == parser.tables
    monkeypatch.setattr(listings._Tables, "feed", None)  # plain pages do not ask for it
    assert listings.tables('<table><tr><td>1</td><td><a class=k href="/t">T</a></td></tr></table>') == [[[("1", None), ("T", "/t")]]]


def test_listing_pages(spark):
    pages = spark.createDataFrame([("u", LISTING), ("v", None), ("w", "<table><tr><td>no")], "url string, html string")
    now = F.lit("2026-08-05 00:00:00").cast("timestamp")
    got = listings.to_notices(listings.parse_listings(pages), "pwd", now).orderBy("serial").collect()
    assert [(r.title, r.ref, r.native, r.status, r.authority) for r in got] == [("Road works", "R/1", "2026_PWD_1_1", "active", "PWD › Div 1"), ("Bridge", "R/2", None, "unknown", "PWD")]
    assert got[0].source_tender_id == "2026_PWD_1_1" and got[1].source_tender_id.startswith("hash:")
    details = [(got[1].id, 1, "Tender ID :", "[2026_PWD_2_7]"), (got[1].id, 2, "Tender Value", "Rs. 12,34,567"), (got[1].id, 3, "EMD Amount", "NA"), (got[1].id, 4, "Publish Date", "05-Aug-2026 03:30 PM"), (got[1].id, 5, "Period Of Work", "90 days"), (got[1].id, 6, "Organisation Chain", "A||B")]
    fields = listings.label_fields(spark.createDataFrame(details, "id string, ordinal int, label string, value string"))
    by = {r.path: r for r in fields.collect()}
    assert by["financial.estimated_value"].number == 1234567 and "financial.emd_amount" not in by and by["work.period_of_work_days"].number == 90 and by["organization.authority"].text == "A › B"
    assert by["dates.published_at"].instant.hour == 10 and by["identity.source_tender_id"].text == "2026_PWD_2_7"
    again = {r.serial: r for r in listings.rekeyed(listings.to_notices(listings.parse_listings(pages), "pwd", now), fields).collect()}
    assert again[2].source_tender_id == "2026_PWD_2_7" and again[2].id != got[1].id and again[1].id == got[0].id
    assert got[0].link == "/t?id=1" and len(got[0].id) == 24
    orgs = spark.createDataFrame([("<table><tr><td>1.</td><td>Alpha</td><td><a href='/a'>12</a></td></tr><tr><td>2</td><td>Beta</td><td><a href='/b'>30</a></td></tr></table>",)] * 2, "html string")
    assert [(r.name, r.n) for r in listings.largest(listings.organisations(orgs), 5).collect()] == [("Beta", 30), ("Alpha", 12)]
    tail = spark.createDataFrame([("Supply of 1/2 inch pipe/REF 9/ID7",), ("plain",)], "c string").select(listings.title_tail(F.col("c")).alias("t")).collect()
    assert tuple(tail[0].t) == ("Supply of 1/2 inch pipe", "REF 9", "ID7") and tail[1].t.title == "plain"


def test_json_records_and_paging(spark):
    body = ['{"bid_number":["GEM/1"],"title":["Chairs"],"status":[0],"start":["1767225600000"],"value":"12.5","quantity":[4]}', '{"b_id":7,"title":"","category":"Desks","status":3}', "oops"]
    got = records.json_records(spark.createDataFrame([(b,) for b in body], "body string"), "gem").orderBy("title").collect()
    assert [(r.source_tender_id, r.title, r.status) for r in got] == [("GEM/1", "Chairs", "active"), ("bid:7", "Desks", "awarded")]
    assert got[0].description == "Quantity: 4" and got[0].value == 12.5
    rows = [(1, 6, "a"), (1, 6, "b"), (2, 6, "c"), (2, 6, "d"), (3, 6, "a"), (3, 6, "b"), (4, 6, "z")]
    assert records.paged(spark.createDataFrame(rows, "page int, total int, id string"), 2, 10).count() == 4


def test_geography_decisions(spark):
    gazetteer = spark.createDataFrame([("Kerala", "state", "Kerala", None), ("Goa", "state", "Goa", None), ("Kochi", "place", "Kerala", "Ernakulam"), ("Rampur", "village", "Goa", "North"), ("Mine", "weak", "Goa", None), ("North Goa", "place", "Goa", "North Goa")], "name string, kind string, state string, district string")
    rows = [(1, "Works at Kochi, Kerala", "Dept"), (2, "Kerala and Goa road", ""), (3, "Works PIN: 403001", "Kerala dept"), (4, "mine works", ""), (5, "Rampur", "Rampur office"), (6, "Rampur", "x"), (7, "plain", "Goa dept"), (8, "Work in North Goa", ""), (9, "pin 110001 pin 403001", "")]
    got = {r.id: (r.state, r.district) for r in geo.infer(spark.createDataFrame(rows, "id int, title string, authority string"), gazetteer, {"title": "work", "authority": "org"}).collect()}
    assert got == {1: ("Kerala", "Ernakulam"), 3: ("Goa", None), 5: ("Goa", "North"), 7: ("Goa", None), 8: ("Goa", "North Goa")}
    filled = geo.overlay_state(spark.createDataFrame([(1, None), (3, "Punjab"), (4, "")], "id int, state string"), spark.createDataFrame([(1, "Kerala"), (3, "Goa")], "id int, state string")).collect()
    assert {r.id: (r.state, r.state_inferred) for r in filled} == {1: ("Kerala", True), 3: ("Punjab", False), 4: ("", False)}


def test_publishing(spark, tmp_path):
    df = spark.createDataFrame([(i, "s", f"T<{i}>&\u0001", f"http://x/{i}" if i % 2 else "javascript:x", "Goa", f"2026-01-{1 + i % 28:02d}") for i in range(250)], "id int, source string, title string, url string, state string, day string")
    docs = df.withColumn("first_seen_at", F.col("day").cast("timestamp"))
    feed = publish.feeds(docs)
    assert feed.groupBy("feed").count().where("count <> 200").count() == 0
    xml = publish.atom(feed.join(docs.select("id", "title", "url"), "id"))
    from xml.etree import ElementTree

    for r in xml.collect():
        assert len(ElementTree.fromstring(r.xml).findall("{http://www.w3.org/2005/Atom}entry")) == 200 and "javascript" not in r.xml
    assert publish.gate(docs, 300) == 250
    with pytest.raises(ValueError):
        publish.gate(docs, 1000)
    assert publish.gate(docs, 1000, force=True) == 250
    with pytest.raises(ValueError):
        publish.gate(docs.limit(0), None)
    assert not publish.changed(docs, docs.repartition(3), ("day",)) and publish.changed(docs, docs.limit(9))
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    assert {r.id: r.v for r in publish.merge_archive(old, old.where("id = 2").withColumn("v", F.lit("new"))).collect()} == {1: "old", 2: "new"}
    publish.write_csv(df, f"{tmp_path}/csv", ["id", "title"])
    parts = [p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*"))]
    lines = b"".join(p.removeprefix("\ufeffid,title\r\n".encode()) for p in parts)
    assert all(p.startswith("\ufeffid,title\r\n".encode()) for p in parts) and lines.count(b"\r\n") == lines.count(b"\n") == 250
    stamped = df.limit(1).select(F.lit("s").alias("source"), F.lit("2026").alias("yyyy"), F.lit("01").alias("mm"), F.lit(1).alias("id"), F.lit("new").alias("v"))
    publish.write_archive(stamped.unionByName(stamped.withColumns({"id": F.lit(2), "mm": F.lit("02")})), f"{tmp_path}/archive")
    publish.write_archive(stamped.withColumns({"id": F.lit(3)}).unionByName(stamped.withColumn("v", F.lit("newer"))), f"{tmp_path}/archive")
    assert {(r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/archive").collect()} == {(1, "newer"), (2, "new"), (3, "new")}


def test_queue_and_answers(spark):
    raw = ['```json\n{"a": 1}\n```', '{"b": 2}', 'text {"c": {"d": 3}} end', "no", None, "[1]", "{bad"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string").coalesce(1).orderBy("i")
    assert [r.o for r in df.select(queue.repair_json(F.col("v")).alias("o")).collect()] == ['{"a": 1}', '{"b": 2}', '{"c": {"d": 3}}', None, None, None, None]
    items = spark.createDataFrame([(i, "2026-01-01 00:00:00", i < 3) for i in range(50)], "id int, at string, interactive boolean").withColumn("at", F.col("at").cast("timestamp"))
    assert queue.admitted(items, cap=40).where("admitted").count() == 32
    late = items.withColumn("interactive", F.col("id") >= 45)  # 45 background requests spend 32, so the reserve is left for what follows
    assert [r.id for r in queue.admitted(late).where("admitted").orderBy("id").collect()] == [*range(32), *range(45, 50)]
    assert queue.admitted(items, cap=5, reserve=1.0).where("admitted").count() == 3 and queue.admitted(items.limit(0)).count() == 0
    value = spark.createDataFrame([("historical", 2e8), ("new", 1.0), ("new", 1e8), ("user_requested", 2e8), ("other", None), (None, None), ("changed", 1.0)], "r string, v double")
    got = [x.p for x in value.coalesce(1).select(queue.priority(queue.priority_name(F.col("r"), F.col("v"))).alias("p")).collect()]
    assert got == [7, 4, 3, 1, 7, 7, 2] and value.select(queue.priority(F.lit("?")).alias("p")).first().p == 99


def test_similar_counts_words_of_the_other_title(spark):
    rows = [(1, "X", "a", "q", "Supply of the pumps"), (2, "X", "b", "r", "of the of"), (3, "Y", "a", "r", "valves"), (4, None, "a", "q", "other"), (5, "X", "a", "q", "pump"), (6, None, None, None, "the pumps of"), (7, "X", "b", "q", None)]
    df = spark.createDataFrame([(*r, "closed" if r[0] == 5 else "active") for r in rows], "id int, state string, category string, authority string, title string, status string")
    assert [tuple(r) for r in match.similar(df, 1).collect()] == [(4, 5), (2, 4), (7, 4)]


def test_stream_upsert_over_several_batches(spark, tmp_path):
    schema = "k string, n int, v string"
    for i, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")], [("b", 3, "w"), ("c", 1, "q")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    merged = lambda store, batch: incremental.latest_by_key(batch if store is None else store.unionByName(batch.select(*store.columns)), ["k"], "n")
    incremental.upsert_stream(stream, f"{tmp_path}/out", ["k"], merged, f"{tmp_path}/state").awaitTermination()
    assert {(r.k, r.v) for r in incremental.stored(spark, f"{tmp_path}/out").collect()} == {("a", "z"), ("b", "w"), ("c", "q")}
    versions = snapshots.versions_of(spark, f"{tmp_path}/out")
    named = {(b, v) for n in versions for b, v in incremental._manifest(spark, f"{tmp_path}/out", n).items()}
    there = {(int(p.name.split("=")[1]), int(p.parent.name.split("=")[1])) for p in (tmp_path / "out" / "rows").glob("v=*/bucket=*")}
    assert there == named and versions == [1, 2]  # nothing else is kept, manifests included, and untouched buckets are not written again
    gone = incremental.take_out(spark, f"{tmp_path}/out", ["k"], F.col("k") != "b")
    assert {r.k for r in gone.collect()} == {"a", "c"} and [tuple(r) for r in incremental.stored(spark, f"{tmp_path}/out").select("k", "n", "v").collect()] == [("b", 3, "w")]
    assert incremental.take_out(spark, f"{tmp_path}/out", ["k"], F.lit(False)).count() == 0 and snapshots.versions_of(spark, f"{tmp_path}/out") == [2, 3]


def test_other_grammars(spark):
    pages = spark.createDataFrame([("u", """<table><tr><td><a href="/t">1. Road</a></td><td>R1</td><td>01-Jan-2026</td><td>02-Jan-2026</td></tr></table>
      <table><tr><th>Title</th><th>Start Date</th><th>End Date</th><th>File</th></tr><tr><td>Well</td><td>01/01/2026</td><td>05/01/2026</td><td><a href="w.pdf">View</a></td></tr></table>
      <a href="/f/20260102030405_x.pdf">Pump <b>set</b></a><a href="/f/20260102030405_x.pdf">again</a><select><option value="">All</option><option value="NR"> north  zone</option></select><a href="?page=3">3</a>"""), ("v", None)], "url string, html string")
    rows = lambda parse: [tuple(r)[1:] for r in parse(pages).collect()]
    assert rows(listings.parse_widget) == [("Road", "R1", "01-Jan-2026", "02-Jan-2026", "/t")]
    assert rows(listings.parse_district) == [("Well", "01/01/2026", "05/01/2026", "w.pdf")]
    assert rows(listings.parse_stamped)[0] == ("Pump set", "2026-01-02 03:04:05", "/f/20260102030405_x.pdf")
    assert rows(listings.parse_options) == [("NR", "north zone")]
    assert rows(listings.parse_documents) == [("w.pdf", "View"), ("/f/20260102030405_x.pdf", "Pump set")]
    assert [r.o for r in pages.select(listings.has_later_page(F.col("html"), 2).alias("o")).collect()] == [True, False]


def test_workspace(spark):
    raw = ['{"bookmarks": [{"id": " a ", "status": "won", "saved_at": "2026-01-01T00:00:00Z"}, {"id": ""}, {"id": "b", "status": "evil"}], "searches": [{"id": "1", "name": "n", "query": "q"}, {"id": "2"}]}', "[]", "junk", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string").coalesce(1)
    got = [r.o for r in df.select(workspace.parse_backup(F.col("v")).alias("o")).collect()]
    assert [(b.id, b.status) for b in got[0].bookmarks] == [("a", "won"), ("b", "new")] and len(got[0].searches) == 1 and got[1:] == [None, None, None]
    docs = spark.createDataFrame([(i,) for i in range(9)], "id int")
    chosen = spark.createDataFrame([(i, i) for i in range(7)], "id int, place int")
    assert [r.id for r in workspace.compare(docs, chosen).collect()] == [0, 1, 2, 3, 4] and workspace.compare(docs, chosen.limit(1)).count() == 0
    answer = spark.createDataFrame([('{"summary": " ", "requirements": [{"text": " "}, {"text": "EMD"}], "flags": [{"label": "x"}, {"label": "y", "basis": "p1"}], "confidence": 7}',)], "v string")
    a = answer.select(workspace.normalised_answer(F.col("v")).alias("a")).first().a
    assert (a.summary, [r.text for r in a.requirements], [f.label for f in a.flags], a.confidence) == (None, ["EMD"], ["y"], 1.0)
    urls = spark.createDataFrame([("http://h/a/b.html?x=1", u) for u in ("c d.pdf", "/r", "//o/x", "https://z/")], "b string, h string").coalesce(1)
    assert [r.u for r in urls.select(workspace.absolute_url(F.col("b"), F.col("h")).alias("u")).collect()] == ["http://h/a/c%20d.pdf", "http://h/r", "http://o/x", "https://z/"]


def test_chunks_without_caps_hold_the_whole_text(spark):
    from noticeloom.plans import domain

    long = ["x" * 7001, *(f"{i} " + "P" * 1500 for i in range(90))]
    got = chunks.chunk_document([(1, "\n\n".join(long))], most=None)
    assert max(len(t) for _, _, t in got) <= chunks.LONGEST
    assert "".join(t for _, _, t in got).replace("\n", "") == "".join(long)
    pages = spark.createDataFrame([(1, 1, "\n\n".join(long))], "doc long, page int, text string")
    assert chunks.chunks(pages, most=None).count() == len(got) > chunks.MOST
    assert {"q_chunk_pages", "q_title_normalize"} <= set(domain.QUERIES)


def test_pages_of_many_documents_are_folded_as_they_come(spark):
    """Documents dealt over tasks in any order, a null one among them; none is gathered into a group or a data frame."""
    r = random.Random(6)
    line = lambda: r.choice(["1. Scope of work", "Annexure B", "", "plain", "P" * 900, "Two words"])
    rows = [(d, p, "\n".join(line() for _ in range(r.randint(0, 9))) if r.random() < 0.9 else None) for d in [None, *range(60)] for p in range(r.randint(1, 5))]
    shuffled = r.sample(rows, len(rows))
    for most in (None, 3):
        found = chunks.chunks(spark.createDataFrame(shuffled, "doc long, page int, text string"), most=most)
        want = [(d, i, *c) for d in [None, *range(60)] for i, c in enumerate(chunks.chunk_document([(p, t) for e, p, t in rows if e == d], most=most))]
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_whole_titles_are_not_cut(spark, tmp_path):
    from noticeloom.plans import domain

    spark.createDataFrame([(1, "Word, " * 100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert domain.q_title_normalize(spark, str(tmp_path)).first()["title"] == " ".join(["word"] * 100)


def test_places_go_over_all_rows_and_ranges(spark):
    from noticeloom.plans import relational

    r = random.Random(4)
    rows = [(i, r.choice([None, 1.0, 2.0, r.random() * 9])) for i in range(1000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several ranges
    try:
        got = relational._placed(spark.createDataFrame(rows, "id long, value double").repartition(7), "value").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [x.id for x in sorted(got)] == [i for i, _ in want] and sorted(x.place for x in got) == list(range(1, 1001))
    assert relational._placed(spark.createDataFrame([], "id long, value double"), "value").count() == 0


def test_search_hits_and_quick_forms(spark):
    rows = [(1, "REF/7", "road works", "T1"), (2, "x", "REF/7 road", "T2"), (3, "y", "raod bridge", "T3"), (4, "z", "nothing", "T4"), (5, "w", "road bridge works", "T5")]
    df = spark.createDataFrame(rows, "id int, ref string, title string, tender_number string").withColumns({"authority": F.lit("a"), "category": F.lit("c")})
    got = search.search_hits(df, "ref/7").orderBy(F.desc("score")).collect()
    assert got[0].id == 1 and got[0].score >= 10 and {r.id for r in got} == {1, 2}
    assert {r.id for r in search.search_hits(df, "road bridge").collect()} == {5}  # rows with all terms
    assert {r.id for r in search.search_hits(df, "bridge zzzz").collect()} == {3, 5}  # else with any
    assert {r.id for r in search.search_hits(df, "bridgo").collect()} == {3, 5} and search.search_hits(df, "rxad").count() > 0
    assert search.search_hits(df, "t9").count() == 0 and search.search_hits(df, "").count() == 0
    assert {r.id for r in search.quick_search(df, "road works").collect()} == {1, 5} and search.quick_search(df, " ").count() == 0
    assert search.palette(df, "road", top=2).count() == 2


def test_places_of_names_and_pins(spark):
    rows = [(1, "Nagpur - 440030 road", "x"), (2, "Tender 440030 of 2026", "x"), (3, "PIN Code: 403001", "x"), (4, "Road at Goa, 403001", "x"), (5, "Punjab National Bank branch", "x"), (6, "Andhra works", "x"), (7, "pin–682555", "Kerala")]
    df = spark.createDataFrame(rows, "id int, title string, org string")
    got = {r.id: r.state for r in geo.infer(df, geo.gazetteer(spark), {"title": "work", "org": "org"}).collect()}
    assert got == {1: "Maharashtra", 3: "Goa", 4: "Goa", 6: "Andhra Pradesh", 7: "Lakshadweep"}
    assert [r.p for r in df.orderBy("id").select(geo.loose_pins(F.col("title")).alias("p")).collect()] == [["440030"], [], [], ["403001"], [], [], ["682555"]]


def test_digest_is_written_only_if_more_than_its_stamp_differs(spark, tmp_path):
    rows = [(1, "Road", "https://x/1", "PWD", "2026-01-02 10:00:00", "2026-01-01 20:00:00", "active", 2.5e7), (2, None, None, None, "2026-01-03 10:00:00", "2025-12-31 18:00:00", "active", 0.0), (3, "Old", "u", "A", None, "2026-01-02 17:00:00", "closed", None)]
    df = spark.createDataFrame(rows, "id int, title string, url string, authority string, closing_at string, first_seen_at string, status string, value double")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("closing_at", "first_seen_at")})
    at = F.lit("2026-01-02 04:00:00").cast("timestamp")
    text = publish.digest_text(df, at, "noon", "Digest")
    assert text.first().text == (  # the day is the Indian one
        "# Digest\n\n_Generated noon_\n\n## New Today (2)\n\n- [Road](https://x/1) — PWD — ₹2.50 Cr — closes 02 Jan 15:30\n- [Old](u) — A — value not disclosed — closes —\n\n"
        "## Closing Soon (7 days) (2)\n\n- [Road](https://x/1) — PWD — ₹2.50 Cr — closes 02 Jan 15:30\n- [Untitled]() —  — value not disclosed — closes 03 Jan 15:30\n"
    )
    assert publish.digest_text(df.limit(0), at, "x", "D").first().text.count("- none") == 2
    path = f"{tmp_path}/digest"
    assert publish.write_digest(text, path) and not publish.write_digest(publish.digest_text(df, at, "later", "Digest"), path)
    assert publish.write_digest(publish.digest_text(df.where("id > 1"), at, "later", "Digest"), path)


def test_publishing_by_difference(spark, tmp_path):
    path, schema = f"{tmp_path}/p", "id string, n int, v string"
    files = lambda: {(str(f.relative_to(tmp_path)), f.stat().st_mtime_ns) for f in (tmp_path / "p").rglob("*") if f.is_file()}
    shard, rows = F.substring("id", 1, 1), [(f"{c}{i}", i, None if i % 3 else "é\n") for c in "abc" for i in range(20)]
    first = snapshots.publish(spark.createDataFrame(rows, schema), path, shard, 0.5)
    assert (first.version, first.rows, first.written) == (0, 60, ("a", "b", "c"))
    before = files()
    again = snapshots.publish(spark.createDataFrame(rows[::-1], schema).repartition(5), path, shard, 0.5)
    assert again == snapshots.Published(0, 60) and files() == before  # nothing is written
    with pytest.raises(ValueError):
        snapshots.publish(spark.createDataFrame(rows[:20], schema), path, shard, 0.5)
    with pytest.raises(ValueError):
        snapshots.publish(spark.createDataFrame([], schema), path, shard, 0.5)
    assert files() == before and {tuple(r) for r in snapshots.published(spark, path, schema).collect()} == set(rows)
    new = [("a0", 99, "new"), *rows[1:40], ("d1", 1, None)]  # a differs, b stays, c goes, d comes
    third = snapshots.publish(spark.createDataFrame(new, schema), path, shard, 0.5)
    assert (third.version, third.written, third.removed) == (1, ("a", "d"), ("c",))
    assert {tuple(r) for r in snapshots.published(spark, path, schema).collect()} == set(new)
    assert {r.id for r in snapshots.published(spark, path, schema, ["d", "c"]).collect()} == {"d1"}
    snapshots.publish(spark.createDataFrame(new[20:], schema), path, shard, 0.9)
    assert not list((tmp_path / "p" / "rows" / "v=0").glob("shard=[ac]/*.gz")) and list((tmp_path / "p" / "rows" / "v=0").glob("shard=b/*.gz"))
    assert snapshots.versions_of(spark, path) == [1, 2] and snapshots.publish(spark.createDataFrame([], schema), path, shard, 0.5, force=True).rows == 0
    assert snapshots.published(spark, path, schema).count() == 0


def test_queue_lines_and_page_folders(spark, tmp_path):
    item = spark.createDataFrame([("t", 1, None, 5)], "task string, id int, priority int, line int")
    publish.write_queue(item, f"{tmp_path}/queue")
    publish.write_queue(item.withColumns({"line": F.lit(6), "priority": F.lit(2)}).withColumn("enqueued_at", F.lit(1)), f"{tmp_path}/queue")
    log = spark.read.json(f"{tmp_path}/queue")
    assert log.count() == 2 and [(r.id, r.priority) for r in queue.pending(log, log.limit(0)).collect()] == [(1, 2)]
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "doc string, page int, text string")
    publish.write_pages(pages, f"{tmp_path}/pages")
    publish.write_pages(pages.where("doc = 'a' and page = 1").withColumn("text", F.lit("new")), f"{tmp_path}/pages")
    assert {(r.doc, r.page, r.text) for r in spark.read.json(f"{tmp_path}/pages").collect()} == {("a", 1, "new"), ("b", 1, None)}
    assert list((tmp_path / "pages" / "doc=a").glob("*.json.gz"))
