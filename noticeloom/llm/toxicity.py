"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words, bare of ASCII punctuation and lower-cased, and their first 4 and 5 bytes, each hashed to
20 bits and present or not.  ``logit = w0 + sum(w_i) + sum_{i<j} <v_i, v_j>`` learns pairs, such as an insult with the
mention of a group, that additive weights miss.  Terms have weights if the training sample shows them to matter, alone or
with a word near by (by the G statistic of presence against label), so the length of a text adds no noise.  Both are grouped counts
in Spark; only what passes comes to the driver, and the threshold's place is found by cross-validation inside the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from .folds import labelled_texts, training_rows
from .wordhash import NOT_ALNUM, Words, raw_strings, slices

BITS = 20
PREFIXES = (4, 5)
THRESHOLD = 0.7
#: Least G statistic, and least texts, of a term; of a pair of words at most NEAR words apart, which has many more rivals.
TERM_GAIN, PAIR_GAIN, LEAST = 12.0, 40.0, 3
NEAR = 4


def _terms(data: np.ndarray, offsets: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs of some rows, sorted; only ``useful`` terms if given."""
    words = Words(data, offsets, NOT_ALNUM)
    doc, term = [], []
    size = words.end - words.start
    for cut in (None, *PREFIXES):
        pick = slice(None) if cut is None else size > cut
        start = words.start[pick]
        end = words.end[pick] if cut is None else start + cut
        found = (words.span_hash(start, end) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        owner = words.doc[pick]
        if useful is not None:
            keep = useful[found]
            found, owner = found[keep], owner[keep]
        doc.append(owner)
        term.append(found)
    both = np.unique((np.concatenate(doc) << BITS) | np.concatenate(term))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class FactorizationMachine:
    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """Probabilities of label 1; a text without a known term, such as an empty or null one, has the base rate."""
        useful = np.zeros(1 << BITS, bool)
        useful[self.terms] = True
        data, offsets = raw_strings(column)
        logit = np.full(len(column), self.bias)
        for first, last in slices(offsets):
            doc, term = _terms(data[offsets[first] : offsets[last]], offsets[first : last + 1], useful)
            at = np.searchsorted(self.terms, term)
            logit[first:last] += _machine(doc, at, last - first, self.weight, self.factor)[0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _machine(doc: np.ndarray, at: np.ndarray, n: int, weight: np.ndarray, factor: np.ndarray):
    """Logits without bias, and the factor sums of each row."""
    linear = np.bincount(doc, weight[at], n)
    sums = np.stack([np.bincount(doc, factor[at, k], n) for k in range(factor.shape[1])], axis=1)
    squares = np.bincount(doc, (factor[at] ** 2).sum(axis=1), n)
    return linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def _pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, pair) of some rows, sorted by row; a pair is two different words at most NEAR apart, the lesser term first."""
    words = Words(data, offsets, NOT_ALNUM)
    term = (words.span_hash(words.start, words.end) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    doc, pair = [], []
    for gap in range(1, NEAR + 1):
        a, b = term[:-gap], term[gap:]
        fine = (words.doc[:-gap] == words.doc[gap:]) & (a != b)
        a, b = a[fine], b[fine]
        doc.append(words.doc[:-gap][fine])
        pair.append((np.minimum(a, b) << BITS) | np.maximum(a, b))
    doc, pair = np.concatenate(doc), np.concatenate(pair)
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])[: len(doc)]
    return doc[fresh], pair[fresh]


def _gain(p: Column, q: Column, a: int, b: int) -> Column:
    """The G statistic of presence (in ``p`` of ``a`` toxic texts and ``q`` of ``b`` clean ones) against the label."""
    n = a + b
    cells = ((p, (p + q) * a / n), (q, (p + q) * b / n), (a - p, (n - p - q) * a / n), (b - q, (n - p - q) * b / n))
    return 2 * sum((F.when(o > 0, o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))


def _useful(sample: DataFrame, a: int, b: int) -> np.ndarray:
    """The terms that matter alone, or in a pair of words, by counts over the whole sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            y = batch.column("y").to_numpy()
            for first, last in slices(offsets):
                part, bounds, label = data[offsets[first] : offsets[last]], offsets[first : last + 1], y[first:last]
                for found, far in ((_terms(part, bounds), -1), (_pairs(part, bounds), 0)):
                    doc, key = found
                    name, at = np.unique(key, return_inverse=True)
                    p = np.bincount(at, label[doc], len(name)).astype(np.int64)
                    yield pa.record_batch([pa.array(name if far else name + (1 << BITS)), pa.array(p), pa.array(np.bincount(at, minlength=len(name)) - p)], ["key", "p", "q"])

    counts = sample.select("text", "y").mapInArrow(run, "key long, p long, q long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    alone = F.col("key") < 1 << BITS
    counts = counts.where(p + q >= LEAST).withColumn("gain", _gain(p, q, a, b)).where(F.col("gain") > F.when(alone, TERM_GAIN).otherwise(PAIR_GAIN))
    pair = F.col("key") - (1 << BITS)
    names = F.when(alone, F.array("key")).otherwise(F.array(F.shiftright(pair, BITS), pair.bitwiseAND((1 << BITS) - 1)))
    found = counts.select(F.explode(names).alias("term")).distinct().toArrow().column("term").to_numpy()
    return np.sort(found)  # at most 2**BITS


def _sgd(doc: np.ndarray, at: np.ndarray, y: np.ndarray, n_terms: int, factors: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Adam on the logistic loss; ``doc`` is sorted, ``at`` are the columns of its terms."""
    n = len(y)
    random = np.random.Generator(np.random.PCG64(seed))
    weight, factor = np.zeros(n_terms), random.normal(0, 0.05, (n_terms, factors))
    bias = np.array([np.log(max(y.sum(), 0.5) / max(n - y.sum(), 0.5))])
    first = [np.zeros_like(x) for x in (weight, factor, bias)]
    second, step = [np.zeros_like(x) for x in first], 0
    starts = np.searchsorted(doc, np.arange(n + 1))
    for _ in range(epochs):
        for part in np.array_split(random.permutation(n), max(1, n // 512)):
            sizes = starts[part + 1] - starts[part]
            index = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            own, cols = np.repeat(np.arange(len(part)), sizes), at[index]
            logit, sums = _machine(own, cols, len(part), weight, factor)
            miss = 1 / (1 + np.exp(-np.clip(logit + bias[0], -30, 30))) - y[part]
            g = np.bincount(cols, miss[own], n_terms) / len(part) + 1e-6 * weight
            v = np.stack([np.bincount(cols, miss[own] * (sums[own, k] - factor[cols, k]), n_terms) for k in range(factors)], axis=1)
            v = v / len(part) + 1e-5 * factor
            step += 1
            for x, grad, m, n2 in zip((weight, factor, bias), (g, v, np.array([miss.mean()])), first, second, strict=True):
                m += 0.1 * (grad - m)
                n2 += 0.01 * (grad**2 - n2)
                x -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(n2 / (1 - 0.99**step)) + 1e-8)
    return weight, factor, float(bias[0])


def _cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit that splits the labels with the least sum of both error rates, in the middle of the widest such gap."""
    order = np.argsort(logit, kind="stable")
    z, label = logit[order], y[order]
    missed = np.concatenate([[0], np.cumsum(label)]) / max(1, label.sum())
    alarms = np.concatenate([[0], np.cumsum(1 - label)])
    alarms = (alarms[-1] - alarms) / max(1, alarms[-1])
    errors = (missed + alarms)[1:-1]
    if not len(errors):
        return 0.0
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    at = best[np.argmax(z[best + 1] - z[best])]
    return float((z[at] + z[at + 1]) / 2)


def train(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, factors: int = 4, epochs: int = 60, folds: int = 4, seed: int = 7) -> FactorizationMachine:
    """A machine of ``terms``; ``rows`` are those of each text.

    Machines of ``folds - 1`` parts score the part they have not seen; the cut between these scores is put at THRESHOLD.
    """
    n, positives = len(rows), int(y.sum())
    if not positives or positives == n:
        return FactorizationMachine(np.zeros(0, np.int64), 6.0 if positives else -6.0, np.zeros(0), np.zeros((0, factors)))
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    at = np.searchsorted(terms, np.concatenate([np.empty(0, np.int64), *rows]))
    weight, factor, bias = _sgd(doc, at, y, len(terms), factors, epochs, seed)
    fold = np.random.Generator(np.random.PCG64(seed)).permutation(n) % folds
    unseen = np.zeros(n)
    for f in range(folds):
        here = fold != f
        number = np.cumsum(here) - 1
        keep = here[doc]
        w, v, b = _sgd(number[doc[keep]], at[keep], y[here], len(terms), factors, epochs, seed)
        unseen[~here] = (_machine(doc, at, n, w, v)[0] + b)[~here]
    cut = _cut(unseen, y)
    return FactorizationMachine(terms, bias + float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut, weight, factor)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", limits: dict[int, int] | None = None) -> FactorizationMachine:
    """Fits on at most ``limits[y]`` labelled documents of each class (4,000 toxic and 8,000 clean by default).

    Rows with a null id or label are left out, of repeated ids one text and the greater label count, other columns are ignored.
    Without toxic rows nothing is toxic; without clean ones everything is.
    """
    sample = durable(labelled_texts(docs, training_rows(labels, label, keep, limits or {1: 4000, 0: 8000})))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    a, b = n.get(1, 0), n.get(0, 0)
    terms = _useful(sample, a, b) if a and b else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        useful = np.zeros(1 << BITS, bool)
        useful[terms] = True
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            found = []
            for first, last in slices(offsets):
                doc, term = _terms(data[offsets[first] : offsets[last]], offsets[first : last + 1], useful)
                cuts = np.searchsorted(doc, np.arange(last - first + 1))
                found += [term[cuts[i] : cuts[i + 1]].astype("<i4").tobytes() for i in range(last - first)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "terms"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {id_type}, y int, terms binary").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    rows = [np.frombuffer(x, "<i4").astype(np.int64) for x in got.column("terms").to_pylist()]
    return train(rows, got.column("y").to_numpy().astype(np.int64), terms)


def toxicity_score(model: FactorizationMachine, text: str | Column) -> Column:
    """The probability that a text is toxic, over its whole length."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column), pa.float64())

    return score(text)
