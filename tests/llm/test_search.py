"""Threshold-algorithm search, SimHash groups and vector codes against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from noticeloom.llm import lexical, simhash, skew, vectorcodes
from pyspark.sql import functions as F

from .conftest import prose, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, k):
    """(item, rank, doc, score) of every distinct item row, all in Python integers."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n_docs, all_terms = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        found = []
        for d, w in held:
            m, score = 100 - 25 + 25 * len(w) * n_docs // all_terms, 0
            for x in terms(text):
                if tf := w.count(x):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got_ranked(df, k):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_lexical_ranks_equal_plain_python(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Über", "x-ray", "naïve", "A1"]
    text = lambda n: " ".join(words[min(int(r.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i, text(r.choice([1, 5, 40, 300]))) for i in range(400)] + [(7, text(9)), (401, None), (402, "..."), (403, "")]
    items = [(i, text(r.randint(1, 30))) for i in range(25)] + [(3, "w1 W1 w1"), (3, "w1 W1 w1"), (50, None), (51, "—!"), (52, "unseen"), (53, "")]
    docs += [(500 + i, docs[5][1]) for i in range(30)]  # ties
    known, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = ranked([d for d in docs], [(i, t) for i, t in items if t is not None], 7)
    assert got_ranked(lexical.lexical_top(known, asked, k=7), 7) == want
    for name, value in (("SEGMENT", 500), ("FIRST_ROUND", 1), ("LAST_ROUND", 3), ("PORTION_CHARS", 300), ("GROUPS", 2)):
        monkeypatch.setattr(lexical, name, value)
    assert got_ranked(lexical.lexical_top(known, asked, k=7), 7) == want


def test_the_threshold_ends_the_lists_early(monkeypatch):
    """With one strong document in front, most of the lists is never read; scores stay those of a full scan."""
    n = 5000
    owner, term = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    impact = np.where(owner < 30, 900_000, 100_000 - owner)
    segment = lexical.Segment(n, owner, term, impact, 2)
    scored = []
    monkeypatch.setattr(lexical.Segment, "scores", lambda self, docs, weight, of=lexical.Segment.scores: (scored.extend(docs), of(self, docs, weight))[1])
    docs, score = segment.best(np.array([0, 1]), np.array([3, 5]), 20, np.empty(0, np.int64))
    assert set(docs[np.argsort(-score)][:20]) <= set(range(30)) and len(scored) < 200 and len(docs) == 30  # ties stay
    assert len(segment.best(np.array([0, 1]), np.array([3, 5]), 20, np.full(20, 10**9))[0]) == 0


def test_lexical_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "word one"), (None, "word"), (2, None)], "item_id long, text string").withColumn("score", F.lit("clash")).withColumn("item", F.lit("clash"))
    got = got_ranked(lexical.lexical_top(odd_docs, items), 20)
    assert got == ranked([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], [(1, "word one"), (None, "word")], 20)
    assert lexical.lexical_top(no_docs, items).count() == 0 and lexical.lexical_top(odd_docs, items.limit(0)).count() == 0
    assert lexical.lexical_top(odd_docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    texts = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", "y")], "doc_id string, text string")
    assert [r.doc_id for r in lexical.lexical_top(texts, spark.createDataFrame([("i", "x")], "item_id string, text string")).orderBy("rank").collect()] == ["a", "b", None]


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(pairs, radius=2):
    """id -> (fingerprint, least id of its component), over all pairs."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, f) in enumerate(pairs):
        for j in range(i):
            if (f ^ pairs[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(pairs)), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \t\n\x85é", max_size=30), max_size=8))
def test_fingerprints_of_any_text(texts):
    import pyarrow as pa
    from noticeloom.llm.wordhash import raw_strings

    data, offsets = raw_strings(pa.array(texts, pa.string()))
    assert simhash.fingerprints_of(data, offsets, 3).tolist() == [fingerprint(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63)), max_size=90), st.integers(0, 4))
def test_close_lanes_are_all_close_pairs(drawn, radius):
    drawn.sort()
    bucket = np.array([d[0] for d in drawn for _ in range(3)], np.int64)
    fps = np.array([x for _, f, a, b in drawn for x in (f, f ^ 1 << a, f ^ 1 << a ^ 1 << b)], np.uint64)
    want = {(i, j) for j in range(len(fps)) for i in range(j) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(zip(*(x.tolist() for x in simhash.close_lanes(fps, bucket, radius)), strict=True)) == want


def test_simhash_groups_equal_plain_python(spark, odd_docs, no_docs, monkeypatch):
    base = [prose(i, 80) for i in range(30)]
    texts = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " extra") for i, t in enumerate(base)] + [(200 + i, t.upper()) for i, t in enumerate(base[:9])] + [(300, None), (301, ""), (302, "\t"), (303, "a"), (304, "A")]
    want = grouped([(d, fingerprint(t)) for d, t in texts])
    got = lambda df: sorted((tuple(r) for r in simhash.simhash_groups(df).collect()), key=str)
    df = spark.createDataFrame(rows(texts), odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema).repartition(3)
    assert got(df) == want
    assert got(odd_docs) == grouped([(r.doc_id, fingerprint(r.text)) for r in odd_docs.select("doc_id", "text").collect()])
    assert got(no_docs) == []
    monkeypatch.setattr(simhash, "TOGETHER", 3)
    assert got(df) == want


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    """Fingerprints that agree in their upper half crowd into few buckets; every link is found all the same."""
    r = random.Random(5)
    fps = {r.getrandbits(64) & 0xFFF | 0xABCD << 40 for _ in range(300)} | {r.getrandbits(64) for _ in range(200)}
    fps = sorted(x - 2**64 if x >> 63 else x for x in fps)
    monkeypatch.setattr(simhash, "BUCKET", 8)
    classes = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    links = [(a % 2**64, b % 2**64) for a, b in simhash.fingerprint_links(classes, 2).collect()]
    root = {x % 2**64: x % 2**64 for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    mine = {}
    for x in root:
        mine.setdefault(find(x), set()).add(x)
    want = {}
    for d, _, c in grouped([(i, x % 2**64) for i, x in enumerate(fps)]):
        want.setdefault(c, set()).add(fps[d] % 2**64)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def codes_of(table, parts=16, entries=64, rounds=2):
    """(id, code, error, label_error, sha) by a full search in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : p * size + size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), e), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[best(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, y, [best(v, p) for p in range(parts)]) for i, v, y in kept]
    sums = {}
    for _, y, b in found:
        sums[y] = sums.get(y, 0) + sum(d for d, _ in b)
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{n:02x}" for _, n in b), sum(d for d, _ in b), sums[y], sha) for i, y, b in found), key=str)


def test_vector_codes_equal_a_full_search(spark, monkeypatch):
    r = random.Random(6)
    table = [(i * 3 % 211, [r.gauss(0, 0.2) for _ in range(32)], r.choice([None, 1, 2, 2, 2])) for i in range(211)]
    table += [(900, None, 1), (901, [0.5] * 31 + [None], 1), (902, [float("nan")] + [0.0] * 31, 1), (903, [float("inf")] + [0.0] * 31, None), (None, [0.1] * 32, 5)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumn("error", F.lit("clash")).withColumn("id", F.lit("clash")).repartition(3)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in table]
    out = vectorcodes.vector_codes(df)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = lambda: sorted((tuple(x) for x in vectorcodes.vector_codes(df).collect()), key=str)
    assert sorted((tuple(x) for x in out.collect()), key=str) == codes_of(single)
    monkeypatch.setattr(skew, "HOT_SHARE", 2.0)  # no key is hot
    assert got() == codes_of(single)


def test_few_empty_uneven_and_great_vectors(spark):
    kind = "vec_id long, embedding array<double>, label int"
    few = [(2, [0.5] * 16, None), (1, [-0.25] * 16, None), (1, [-0.25] * 16, 3)]
    assert sorted((tuple(r) for r in vectorcodes.vector_codes(spark.createDataFrame(few, kind)).collect()), key=str) == codes_of(few)
    assert vectorcodes.vector_codes(spark.createDataFrame([], kind)).count() == 0
    odd = vectorcodes.vector_codes(spark.createDataFrame([(1, [], 1), (2, [1.0, 2.0], 1), (3, [1.0] * 17, 1), (4, [1e300] * 16, 2), (5, [-1e300] * 16, 2)], kind)).collect()
    assert {r.vec_id: (len(r.code), r.error) for r in odd} == {i: (32, 0) for i in range(1, 6)} and len({r.codebooks_sha256 for r in odd}) == 4
    with pytest.raises(ValueError):
        vectorcodes.vector_codes(spark.createDataFrame([], kind), entries=257)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=20), st.randoms(), st.sampled_from([1, 2**24, 2**27]))
def test_exponion_search_finds_the_first_nearest(points, entries, r, scale):
    x, book = np.array(points, np.int64) * scale // 6, np.array(entries, np.int64) * scale // 6
    start = np.array([r.randrange(len(book)) for _ in points])
    index, far = vectorcodes.nearest(x, start, book)
    want = ((x[:, None, :] - book[None]) ** 2).sum(-1)
    assert index.tolist() == want.argmin(1).tolist() and far.tolist() == want.min(1).tolist()


def test_hot_and_cold_keys_meet_their_rows(spark):
    rows_ = spark.createDataFrame([(i, None if i % 3 == 0 else i % 50) for i in range(3000)], "i long, k long")
    table = rows_.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    want = {}
    for i, k in ((i, None if i % 3 == 0 else i % 50) for i in range(3000)):
        want[k] = want.get(k, 0) + i
    out = skew.looked_up(rows_, table.where("k is null or k != 7"), "k", "n", ["s"]).collect()
    assert len(out) == 3000 and all(r.s == (None if r.k == 7 else want[r.k]) for r in out)
