"""Ranked lexical search by the threshold algorithm (Fagin, Lotem and Naor, 2001).

1. One pass over the texts writes a forward index: for each document its number of terms and the counts of those terms that
   some item holds.  Its corpus statistics (documents, terms, documents a term) follow by grouped counts.
2. Documents stay where they are.  A task takes them in segments of a bounded number of postings and sorts the postings of
   every term by impact.  For each item the lists of its terms are read in turn, deeper from round to round; every
   document met is scored whole from the forward index.  The greatest score that an unseen document could have is the
   sum of the impacts where the lists have been read to; as soon as it falls strictly below the k-th best score
   of the task, no other document counts, not even for a tie.
3. The best of all segments meet in two ranked windows, so that no task gets the candidates of all segments.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.durable import durable
from .wordhash import NOT_ALNUM, Words, raw_strings, slices

#: Items go to the tasks in portions of about so many characters; more of them mean more passes over the texts.
PORTION_CHARS = 1_000_000
#: Postings that a task sorts at once.
SEGMENT = 2_000_000
#: Entries of each list read in the first round of an item; later rounds read twice as many, up to the second number.
FIRST_ROUND, LAST_ROUND = 64, 4096
#: The best of the segments are first ranked in so many groups an item.
GROUPS = 64
TERM_SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 12, 25


def item_terms(texts: list[str]) -> list[Counter]:
    """``hash of a term -> occurrences`` of each text."""
    data, offsets = raw_strings(pa.array(texts, pa.string()))
    words = Words(data, offsets, NOT_ALNUM)
    h = words.hashes()
    return [Counter(h[words.ptr[i] : words.ptr[i + 1]].tolist()) for i in range(len(texts))]


def _portions(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(item, text) in portions of about PORTION_CHARS, of which the driver holds one at a time; repeated rows count once."""
    rows = items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // PORTION_CHARS))
    for at in range(n):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == at) if n > 1 else rows
        if found := [tuple(r) for r in own.distinct().collect()]:
            yield found


def forward_index(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, counts)``: a document's number of terms, and places in the sorted ``vocabulary`` with counts (int32 each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("t"))
            for first, last in slices(offsets):
                words = Words(data[offsets[first] : offsets[last]], offsets[first : last + 1], NOT_ALNUM)
                h = words.hashes()
                place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = vocabulary[place] == h
                pair, times = np.unique(words.doc[known] * len(vocabulary) + place[known], return_counts=True)
                bounds = 4 * np.searchsorted(pair, np.arange(last - first + 1) * len(vocabulary))
                terms, counts = (pair % len(vocabulary)).astype("<i4").tobytes(), times.astype("<i4").tobytes()
                cut = [slice(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        batch.column("id").slice(first, last - first),
                        pa.array(np.diff(words.ptr), pa.int64()),
                        pa.array([terms[c] for c in cut], pa.binary()),
                        pa.array([counts[c] for c in cut], pa.binary()),
                    ],
                    ["id", "n", "terms", "counts"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return texts.mapInArrow(run, f"id {kind}, n long, terms binary, counts binary").where("n > 0")


def _document_counts(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "docs"])

    out = np.zeros(size, np.int64)
    counted = index.select("terms").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    for term, n in counted.collect():  # one row a term of the portion
        out[term] = n
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(n_terms: np.ndarray, owner: np.ndarray, tf: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What each posting adds for a weight of 1: the saturated count, longer documents less."""
    if int(n_terms.max(initial=0)) * LENGTH_SHARE * n_docs < 2**63:
        share = LENGTH_SHARE * n_terms * n_docs // all_terms
    else:
        share = np.array([LENGTH_SHARE * int(n) * n_docs // all_terms for n in n_terms], np.int64)
    m = 100 - LENGTH_SHARE + share
    return TERM_SCALE * tf // (1000 * tf + SATURATION * m[owner])


class Segment:
    """The forward rows of some documents and their lists by term, each sorted by falling impact."""

    def __init__(self, n_docs: int, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        self.n, self.term, self.impact = n_docs, term, impact
        self.row = np.searchsorted(owner, np.arange(n_docs + 1))
        order = np.lexsort((-impact, term))
        self.docs, self.falling = owner[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(size + 1))

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores by look-ups in the forward rows; ``weight`` of every term of the vocabulary, 0 for those not asked."""
        size = self.row[docs + 1] - self.row[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.row[docs] - ends + size, size)
        sums = np.concatenate([[0], np.cumsum(weight[self.term[at]] * self.impact[at])])
        return sums[ends] - sums[ends - size]

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (and scores above 0) among which are all of the best ``k``, given ``known`` scores of others, ties included."""
        first, end = self.first[terms], self.first[terms + 1]
        seen, met, scored = np.zeros(self.n, bool), [], []
        top = known
        depth, step = 0, FIRST_ROUND
        while (first + depth < end).any():
            parts = [self.docs[a + depth : min(a + depth + step, b)] for a, b in zip(first.tolist(), end.tolist(), strict=True) if a + depth < b]
            fresh = np.unique(np.concatenate(parts))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            score = self.scores(fresh, weight)
            met.append(fresh)
            scored.append(score)
            top = np.concatenate([top, score])
            if len(top) > k:
                top = np.partition(top, len(top) - k)[len(top) - k :]
            depth, step = depth + step, min(2 * step, LAST_ROUND)
            reached = np.where(first + depth < end, weight[terms] * self.falling[np.minimum(first + depth, end) - 1], 0).sum()
            if len(top) == k and reached < top.min():
                break
        if not met:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, score = np.concatenate(met), np.concatenate(scored)
        fit = (score > 0) & (score >= (top.min() if len(top) == k else 1))
        return docs[fit], score[fit]


def _ranked(index: DataFrame, asked: list[dict[int, int]], weight: np.ndarray, n_docs: int, all_terms: int, k: int, base: int) -> DataFrame:
    """``(item, id, score, group)``: the best of each segment; ``asked`` holds ``place in the vocabulary -> occurrences`` of each item."""
    size = len(weight)
    lists = []
    for own in asked:
        terms = np.array(sorted(t for t in own if weight[t] > 0), np.int64)
        lists.append((terms, weight[terms] * np.array([own[t] for t in terms.tolist()], np.int64)))

    def segment_rows(held: list[pa.RecordBatch], known: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        rows = table.column("terms").to_pylist()
        owner = np.repeat(np.arange(len(rows)), [len(r) // 4 for r in rows])
        term = np.frombuffer(b"".join(rows), "<i4").astype(np.int64)
        tf = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4").astype(np.int64)
        impact = impacts(table.column("n").to_numpy(), owner, tf, n_docs, all_terms)
        segment = Segment(len(rows), owner, term, impact, size)
        ids = table.column("id").combine_chunks()
        place = np.empty(len(ids), np.int64)  # of the ids in their order, nulls last
        place[pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(ids))
        full = np.zeros(size, np.int64)
        item_of, doc_of, score_of = [], [], []
        for i, (terms, weights) in enumerate(lists):
            full[terms] = weights
            docs, score = segment.best(terms, full, k, known[i])
            full[terms] = 0
            order = np.lexsort((place[docs], -score))[:k]
            known[i] = np.sort(np.concatenate([known[i], score[order]]))[-k:]
            item_of.append(np.full(len(order), base + i))
            doc_of.append(docs[order])
            score_of.append(score[order])
        if item_of:
            yield pa.record_batch(
                [pa.array(np.concatenate(item_of), pa.int64()), ids.take(pa.array(np.concatenate(doc_of), pa.int64())), pa.array(np.concatenate(score_of), pa.int64())],
                ["item", "id", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.empty(0, np.int64) for _ in lists]
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += batch.column("terms").nbytes // 4
            if postings >= SEGMENT:
                yield from segment_rows(held, known)
                held, postings = [], 0
        if held:
            yield from segment_rows(held, known)

    kind = index.schema["id"].dataType.simpleString()
    out = index.where(F.length("terms") > 0).mapInArrow(run, f"item long, id {kind}, score long")
    return out.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))


def lexical_top(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of each item with the highest score above 0, ties by ascending id.

    Terms are runs of ASCII digits, letters and everything beyond ASCII; A-Z are lower-cased; they are compared by hashes of 64 bits.
    Texts that are null or without terms count nowhere; items without terms give no rows.  Items that repeat id and text
    count once, one id with several texts is ranked for each.  Documents that repeat an id are documents each; a null id sorts
    last.  Other columns are ignored; an empty table gives no rows.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    spark, parts, base = docs.sparkSession, [], 0
    for portion in _portions(items, item_col, item_text_col):
        asked = item_terms([t for _, t in portion])
        vocabulary = np.array(sorted(set().union(*asked)), np.uint64)
        if not len(vocabulary):
            continue
        index = durable(forward_index(docs, vocabulary, id_col, text_col))
        n_docs, all_terms = index.agg(F.count("*"), F.sum("n")).first()
        if n_docs:
            place = {h: i for i, h in enumerate(vocabulary.tolist())}
            weight = term_weights(_document_counts(index, len(vocabulary)), n_docs)
            best = _ranked(index, [{place[h]: c for h, c in own.items()} for own in asked], weight, n_docs, all_terms, k, base)
            names = spark.createDataFrame([(base + i, x) for i, (x, _) in enumerate(portion)], f"item long, item_id {item_type.simpleString()}")
            parts.append(durable(best).join(F.broadcast(names), "item"))
            base += len(portion)
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type}, score long")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    some = found.withColumn("nth", F.row_number().over(W.partitionBy("item", "group").orderBy(*order))).where(F.col("nth") <= k)
    rank = F.row_number().over(W.partitionBy("item").orderBy(*order)).cast("int")
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", F.col("id").alias("doc_id"), "score")
