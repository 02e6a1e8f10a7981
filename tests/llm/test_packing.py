from __future__ import annotations

from collections import defaultdict
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from noticeloom.llm import packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_equal_the_tokenizer(texts):
    slow = Tokenizer.from_file(PATH)
    texts = [*texts, "<|endoftext|> it's  ok\n\n x", "\x85\xa0 ½a b 日本 १२"]
    assert [x.tolist() for x in packing._encoder(PATH)(texts)] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_bins_hold_what_they_are_given(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    where, offset = packing.sum_of_squares(lengths, 50)
    for b in set(where.tolist()):
        end = 0
        for i in np.flatnonzero(where == b)[np.argsort(offset[where == b])]:
            assert offset[i] == end
            end += lengths[i]
        assert end <= 50


def best_fit(lengths: list[int], capacity: int) -> int:
    gaps: list[int] = []
    for size in lengths:
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(capacity - size)
    return len(gaps)


def test_waste_is_small():
    """Against best fit, and against the volume where small items can fill the gaps."""
    r = np.random.default_rng(4)
    for low, high, n in ((1, 2048, 2500), (1, 900, 4000), (300, 2048, 1500)):
        lengths = np.sort(r.integers(low, high, n))[::-1]
        where, _ = packing.sum_of_squares(lengths, 2048)
        assert len(set(where.tolist())) <= 1.005 * best_fit(lengths.tolist(), 2048)
        if high < 1024:
            assert len(set(where.tolist())) <= 1.005 * np.ceil(lengths.sum() / 2048) + 1


def test_round_trip(spark, odd_docs, no_docs):
    got = packing.packed_sequences(odd_docs, PATH, capacity=512).collect()
    slow = Tokenizer.from_file(PATH)
    want = sorted([*slow.encode(r.text or "", add_special_tokens=False).ids, 0] for r in odd_docs.select("text").collect())
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 512 and (r.piece == 0 or r.length == 512)
        by_doc[r.doc_id].append((r.piece, r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) >= 0
    texts = []
    for doc, pieces in by_doc.items():
        firsts = [p for p in pieces if p[0] == 0]
        if len(firsts) == 1:
            whole = [t for p in sorted(pieces) for t in p[2]]
            assert [p[1] for p in sorted(pieces)] == list(np.cumsum([0, *[len(p[2]) for p in sorted(pieces)][:-1]]))
            texts.append(whole)
        else:
            texts += [p[2] for p in firsts]
    assert sorted(texts) == want
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 512
    assert packing.packed_sequences(no_docs, PATH).count() == 0


def test_a_very_long_document_makes_no_large_group(spark):
    """Its whole pieces are sequences as they are, and only what is shorter is grouped, by number."""
    docs = spark.createDataFrame([(1, "word " * 24_000)] + [(2 + i, "word") for i in range(20)], "doc_id long, text string").repartition(1)
    got = packing.packed_sequences(docs, PATH, capacity=4).collect()
    long = [r for r in got if r.doc_id == 1]
    assert len({r.sequence_id for r in long}) == len(long) > 4000 and sorted(r.piece for r in long) == list(range(len(long)))
    assert all(len(r.ids) == 4 * r.length for r in got)
    short = [r for r in got if r.length < 4]
    assert len({r.sequence_id for r in short}) == 10 + (len(short) > 20)
    pieces = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(3).cast("long").alias("length"), F.lit("x").alias("packing_group"), F.lit(1).alias("Offset"))
    dealt = packing.pack(pieces)
    assert dealt.columns == ["doc_id", "length", "packing_group", "sequence_id", "offset"]
    assert len({r.g for r in dealt.select(F.shiftright("sequence_id", 32).alias("g")).distinct().collect()}) >= 6
