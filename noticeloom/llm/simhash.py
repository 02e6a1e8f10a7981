"""Near duplicates by SimHash fingerprints, compared bit-sliced.

1. One pass over the texts gives each document its fingerprint of 64 bits; equal fingerprints form one class.
2. Two fingerprints within the radius ``r`` differ in at most ``r`` of ``r + 2`` slices of bits, so two slices agree: classes meet in
   buckets by every pair of slices.  A bucket above BUCKET classes is dealt again by the bits that are left, in which its members differ
   in at most ``r`` again.  Each dealing at least halves those bits for radius 2, so buckets are bounded whatever the data.
3. In a bucket the fingerprints stand vertically: plane ``b`` holds bit ``b`` of 64 lanes in each machine word.  A fingerprint is
   compared with all lanes of a word at once: the differing bits of two planes at a time go into carry-save counters, and a word is
   abandoned as soon as every lane has exceeded the radius.
4. A bucket yields a spanning forest of its links; components of all links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..operators.graph import connected_components
from .skew import looked_up
from .wordhash import _LOWER, _SPACE, Words, raw_strings, slices

BITS, SEED = 64, 42
#: Classes of a bucket that are compared at once; larger buckets are dealt again.
BUCKET = 2048
#: Small buckets are compared together up to about so many classes.
TOGETHER = 256
#: Planes added between two looks at which words are still open; shingles hashed at once.
LOOK, CHUNK = 8, 65_536
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingle_spans(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased text with single blanks between words, and begin, end and row of every shingle in it."""
    words = Words(data, offsets)
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    text = np.where(space, np.uint8(32), _LOWER[data])[keep].tobytes()
    start, end, n = place[words.start], place[words.end - 1] + 1, np.diff(words.ptr)
    whole = max(0, len(start) - width + 1)
    same = np.flatnonzero(words.doc[:whole] == words.doc[width - 1 :]) if whole else np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    begin = np.concatenate([start[same], start[words.ptr[short]]])
    stop = np.concatenate([end[same + width - 1], end[words.ptr[short + 1] - 1]])
    row = np.concatenate([words.doc[same], short])
    order = np.argsort(row, kind="stable")
    return text, begin[order], stop[order], row[order]


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """uint64 fingerprint of each row: a bit is set if more than half of the shingle hashes have it; without words 0."""
    text, begin, stop, row = _shingle_spans(data, offsets, width)
    n = len(offsets) - 1
    ones = np.zeros((n, BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(row), CHUNK):
        spans = zip(begin[at : at + CHUNK].tolist(), stop[at : at + CHUNK].tolist(), strict=True)
        own = row[at : at + CHUNK]
        h = np.fromiter((digest(text[a:b], SEED) for a, b in spans), "<u8", len(own))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    over = 2 * ones > np.bincount(row, minlength=n)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("t"))
            for first, last in slices(offsets):
                fp = fingerprints_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                yield pa.record_batch([batch.column("id").slice(first, last - first), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def close_lanes(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one bucket whose fingerprints differ in at most ``radius`` bits.

    ``fps`` are uint64, ``bucket`` numbers, equal ones adjacent.
    """
    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((BITS, words * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    repeated = np.where(bits[:, :n] == 1, _FULL, np.uint64(0))
    lane = np.arange(words * 64)
    end = np.searchsorted(bucket, bucket, "right")
    asked = (lane > np.arange(n)[:, None]) & (lane < end[:, None])
    asked = np.packbits(asked, axis=1, bitorder="little").view("<u8")
    row, word = np.nonzero(asked)
    exceeded = ~asked[row, word]
    counter = [np.zeros(len(row), np.uint64) for _ in range((radius + 1).bit_length())]
    for b in range(0, BITS, 2):
        x, y = planes[b][word] ^ repeated[b][row], planes[b + 1][word] ^ repeated[b + 1][row]
        half = counter[0] ^ x
        carry = (counter[0] & x) | (half & y)
        counter[0] = half ^ y
        for c in range(1, len(counter)):
            counter[c], carry = counter[c] ^ carry, counter[c] & carry
        exceeded = exceeded | carry
        if (b + 2) % LOOK == 0:
            above, equal = exceeded, np.full(len(row), _FULL)
            for c in reversed(range(len(counter))):
                if radius >> c & 1:
                    equal = equal & counter[c]
                else:
                    above, equal = above | equal & counter[c], equal & ~counter[c]
            exceeded = above
            open_ = exceeded != _FULL
            if not open_.all():
                row, word, exceeded = row[open_], word[open_], exceeded[open_]
                counter = [c[open_] for c in counter]
    hit = np.unpackbits((~exceeded).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(hit)
    return row[at], word[at] * 64 + bit


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` that connect what is linked in the buckets of ``rows`` (t, key, fp), each of at most BUCKET rows."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = close_lanes(fps.view(np.uint64), keys, radius)
        root = forest(len(fps), a, b)
        at = np.flatnonzero(root != np.arange(len(fps)))
        if len(at):
            yield pa.record_batch([pa.array(fps[root[at]]), pa.array(fps[at])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)  # from the last bucket on, which may go on in the next batch

        def walk(held: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(axis=0)) + 1
            bounds = np.concatenate([[0], cuts, [held.shape[1]] if last else []]).astype(np.int64)
            number = np.searchsorted(cuts, np.arange(held.shape[1]), "right")
            first = 0
            for i, end in enumerate(bounds[1:].tolist(), 1):
                if end - first >= TOGETHER or i + 1 == len(bounds):
                    yield from links(number[first:end], held[2, first:end])
                    first = end
            return held[:, first:]

        for batch in batches:
            fresh = np.stack([batch.column(c).to_numpy() for c in ("t", "key", "fp")])
            held = yield from walk(np.concatenate([held, fresh], axis=1), last=False)
        if held.shape[1]:
            yield from walk(held, last=True)

    ordered = rows.repartition("t", "key").sortWithinPartitions("t", "key")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _sliced(mask: int, parts: int) -> list[int]:
    """``mask`` in ``parts`` masks of about equally many neighbouring bits."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    cuts = [i * len(bits) // parts for i in range(parts + 1)]
    return [reduce(lambda m, b: m | 1 << b, bits[x:y], 0) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def fingerprint_links(classes: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links that connect every two of the distinct fingerprints ``fp`` within ``radius`` bits, directly or over others."""
    full = (1 << BITS) - 1
    rows, tables, links = classes.select(F.lit(0).alias("t"), "fp"), {0: 0}, None
    while True:
        wanted = {}  # number of a dealing -> bits that agree in its buckets
        dealt: dict[int, list] = {}
        for t, agreed in tables.items():
            for x, y in combinations(_sliced(full ^ agreed, radius + 2), 2):
                number = len(wanted)
                wanted[number] = agreed | x | y
                dealt.setdefault(t, []).append(F.struct(F.lit(number).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(agreed | x | y))).alias("key")))
        by_table = F.coalesce(*(F.when(F.col("t") == t, F.array(*keys)) for t, keys in dealt.items()))
        rows = durable(rows.select(F.explode(by_table).alias("k"), "fp").select("k.t", "k.key", "fp"))
        sizes = durable(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
        small = _compared(rows.join(sizes.where(F.col("n") <= BUCKET).select("t", "key"), ["t", "key"], "left_semi"), radius)
        links = small if links is None else links.unionByName(small)
        large = sizes.where(F.col("n") > BUCKET).select("t", "key")
        hot = sorted(r[0] for r in large.select("t").distinct().collect())
        if not hot:
            return links
        rows = rows.join(large, ["t", "key"], "left_semi").select("t", "fp")
        tables = {t: wanted[t] for t in hot}


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id reachable over links).

    A fingerprint bit is set if more than half of the text's shingles (``width`` words, repeats included; a shorter text is one
    shingle) have it in their XXH64.  Texts without words and null texts have fingerprint zero and are linked like others.  Fingerprints
    link if at most ``radius`` bits differ.  Repeated rows are copies of each other.  A null id loses every minimum; a component
    of null ids only has a null component_id.  Other columns are ignored; an empty table gives none.
    """
    sketched = durable(sketch(docs, width, id_col, text_col))
    classes = durable(sketched.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    roots = connected_components(durable(fingerprint_links(classes, radius)))
    owned = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "copies", F.coalesce("root", "fp").alias("root"))
    least = owned.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = durable(owned.join(least, "root").select("fp", "copies", "component_id"))
    out = looked_up(sketched, final, "fp", "copies", ["component_id"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
