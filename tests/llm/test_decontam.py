from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from noticeloom.llm import decontam
from .conftest import prose


def least(pattern: str, text: str) -> tuple[int, int]:
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before), before.index(min(before))


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", max_size=60))
def test_myers_equals_the_table(pattern, text):
    assert decontam.myers(pattern, text) == least(pattern, text)


def test_every_planted_item_is_found_and_nothing_else():
    r = random.Random(3)
    items = tuple((i, decontam.plain(prose(50 + i, r.randint(8, 30)))) for i in range(12))
    for trial in range(150):
        n = r.randrange(len(items))
        item = list(items[n][1])
        k = decontam.budget(items[n][1], decontam.EDIT_SHARE)
        for _ in range(r.randint(0, k)):
            at = r.randrange(len(item))
            item[at : at + r.randint(0, 1)] = r.choice(["", "q", "zz"[:1]])
        text = f"{prose(trial, 40)}  {''.join(item).upper()} \n{prose(trial + 999, 40)}"
        want = {j: least(items[j][1], decontam.plain(text))[0] for j in range(len(items))}
        got = {j: e for j, (e, _) in decontam.matches(text, decontam.Items(tuple(items), decontam.EDIT_SHARE)).items()}
        assert set(got) == {j for j, e in want.items() if e <= decontam.budget(items[j][1], decontam.EDIT_SHARE)}


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    items = [(1, prose(2, 60)[:80]), (2, None), (None, "x"), (3, ""), (4, "ünï cödé"), (5, "word"), (5, "word")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r.doc_id, r.item_id, r.edits) for r in decontam.benchmark_hits(odd_docs, benchmark).collect() if r.doc_id)
    assert {(4, 5, 0), (5, 5, 0), (6, 1, 0), (9, 4, 0)} <= set(want) and want.count((6, 1, 0)) == 2
    monkeypatch.setattr(decontam, "PORTION_CHARS", 10)  # several passes give the same
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontam.benchmark_hits(odd_docs, benchmark).collect() if r.doc_id) == want
    kept = decontam.without_contaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in odd_docs.collect()} - {r.doc_id for r in kept.collect()} == {d for d, _, _ in want}
    assert decontam.benchmark_hits(no_docs, benchmark).count() == 0
    assert decontam.benchmark_hits(odd_docs, benchmark.limit(0)).count() == 0
    assert decontam.without_contaminated(no_docs, benchmark).count() == 0
    assert decontam.without_contaminated(odd_docs, benchmark.limit(0)).count() == odd_docs.count()


def test_an_automaton_is_built_once(monkeypatch):
    built = []
    monkeypatch.setattr(decontam, "pieces", lambda item, k, of=decontam.pieces: (built.append(item), of(item, k))[1])
    known = decontam.Items(((1, "some benchmark item"), (2, "and another one")), 0.08)
    for _ in range(50):
        assert set(decontam.matches("x some benchmark item y", known)) == {0}
    assert len(built) == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", min_size=1, max_size=150), st.text("abcx ", max_size=180)), min_size=1, max_size=8))
def test_many_at_once_equal_one_by_one(pairs):
    known = decontam.Items(tuple((i, p) for i, (p, _) in enumerate(pairs)), 0.1)
    text, asked = "".join(w for _, w in pairs), []
    for n, (_, w) in enumerate(pairs):
        low = sum(len(x) for _, x in pairs[:n])
        asked.append((n, low, low + len(w) + 7 * n))  # some windows reach into others or beyond the end
    assert known.distances(text, asked) == [decontam.myers(pairs[n][0], text[low:high]) for n, low, high in asked]


def test_items_of_one_template_take_no_longer_than_few(monkeypatch):
    import time

    template = prose(1, 25)
    items = tuple((i, decontam.plain(f"{prose(100 + i, 4)} {template} {prose(5000 + i, 4)}")) for i in range(2000))
    known = decontam.Items(items, decontam.EDIT_SHARE)
    text = f"{prose(2, 60)} {items[7][1].replace('e', 'o', 3)} {prose(3, 60)}"
    known.automaton()
    began = time.time()
    got = decontam.matches(text, known)
    assert 7 in got and time.time() - began < 3
    monkeypatch.setattr(decontam, "MANY", 10**9)
    assert {n: got[n] for n in sorted(got)[:5]} == {n: x for n, x in decontam.matches(text, decontam.Items(items, decontam.EDIT_SHARE)).items() if n in sorted(got)[:5]}


def test_ids_of_any_type(spark):
    for kind, value in (("int", 3), ("string", "x"), ("short", 4), ("date", __import__("datetime").date(2026, 1, 2))):
        docs = spark.createDataFrame([(1, "a benchmark item stands here")], "doc_id int, text string")
        hits = decontam.benchmark_hits(docs, spark.createDataFrame([(value, "benchmark item")], f"item_id {kind}, text string"))
        assert [(r.doc_id, r.item_id, r.edits) for r in hits.collect()] == [(1, value, 0)]
