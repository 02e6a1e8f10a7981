from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import corpus_pipeline
import numpy as np
import pyarrow as pa
from noticeloom.llm import neardup, superminhash
from noticeloom.llm.superminhash import signatures
from noticeloom.llm.wordhash import Words, raw_strings, shingle_sets

from .conftest import DOCS, prose, rows

_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_sets(text: str | None, width: int) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(docs: list[tuple[int, str | None]], width: int) -> dict[int, tuple[int, int]]:
    """doc -> (set size, least id reachable)."""
    sets = {i: plain_sets(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbB é\t\n\x0b\x1c ß.")), max_size=40) | st.none(), max_size=6), st.integers(1, 5))
def test_shingle_counts_match_plain_python(texts, width):
    data, offsets = raw_strings(pa.array(texts, pa.string()))
    sets, ptr = shingle_sets(Words(data, offsets), width)
    assert np.diff(ptr).tolist() == [len(plain_sets(t, width)) for t in texts]
    pooled = {frozenset(plain_sets(t, width)) for t in texts}
    assert len({tuple(sets[ptr[i] : ptr[i + 1]].tolist()) for i in range(len(texts))}) == len(pooled)


def test_signature_agreement_estimates_similarity():
    r = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
        other = np.concatenate([base[:340], r.integers(0, 1 << 63, 60, dtype=np.uint64)])
        sig = signatures(np.concatenate([base, other]), np.array([0, 400, 800]), 112)
        errors.append((sig[0] == sig[1]).mean() - 340 / 460)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def near_copies(n: int, seed: int) -> list[tuple[int, str]]:
    """Groups of near copies around the threshold, in which not every pair is a link; plus exact copies."""
    r = random.Random(seed)
    out = []
    for g in range(n):
        words = prose(seed * 1000 + g, r.randint(5, 120)).split()
        for _ in range(r.randint(1, 8)):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(copy) // 18))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(copy))
    r.shuffle(out)
    return list(enumerate(out))


def test_components_equal_brute_force(spark):
    docs = near_copies(60, 5)
    for width in (4, 5):
        got = neardup.near_duplicates(spark.createDataFrame(rows(docs), DOCS), width).collect()
        want = brute(docs, width)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_large_group_in_blocks(spark, monkeypatch):
    """A group far larger than a block and than the listed size, whose members link in part only."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "LISTED", 8)
    r = random.Random(9)
    words = prose(77, 100).split()
    docs = []
    for i in range(150):
        copy = list(words)
        for _ in range(r.randint(0, 7)):
            copy[r.randrange(len(copy))] = f"y{r.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows(docs), DOCS), 4).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(docs, 4)


def test_odd_rows(spark, odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs, 4).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, x)
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[1].component_id == 1 and by[3].kept
    assert (by[5].component_id, by[5].kept, by[8].n_shingles) == (4, False, 1)
    assert by[6].kept and by[7].n_shingles > 1000
    assert neardup.near_duplicates(no_docs, 4).count() == 0


def test_edge_pairs_agree_far_above_the_least_share():
    """The measurement behind AGREE: pairs of sets with a similarity of exactly 0.8, by the size of their union."""
    r = np.random.default_rng(8)
    for union, n in ((10, 700), (50, 500), (200, 300), (1000, 100)):
        sets, ptr = [], [0]
        for _ in range(n):
            value = np.unique(r.integers(0, 2**63, union + 20).astype(np.uint64))[:union]
            value = value[r.permutation(union)]
            tenth = union // 10
            for own in (value[: 9 * tenth], np.concatenate([value[tenth : 9 * tenth], value[9 * tenth :]])):
                sets.append(np.sort(own))
                ptr.append(ptr[-1] + len(own))
        sig = superminhash.signatures(np.concatenate(sets), np.array(ptr), neardup.POSITIONS)
        share = (sig[::2] == sig[1::2]).mean(axis=1)
        keys = superminhash.band_keys(sig, neardup.ROWS)
        assert share.min() >= 0.62 > neardup.AGREE and (keys[::2] == keys[1::2]).any(axis=1).all()


def test_the_stage_tells_documents_with_one_id_apart(spark, odd_docs, tmp_path):
    a, b = prose(50, 80), prose(51, 80)
    docs = spark.createDataFrame(rows([(1, a), (1, b), (2, a + " more"), (3, b), (3, b), (4, ""), (4, ""), (None, prose(52, 60)), (None, prose(53, 60)), (5, prose(52, 60))]), DOCS)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()))
    assert got == sorted([(True, 1, a), (True, 1, b), (True, 4, ""), (True, 4, ""), (False, 0, prose(52, 60)), (False, 0, prose(53, 60))])
    kept = corpus_pipeline.near_duplicate_stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 6, 7, 8, 9}
