"""Quality: attention-based multiple-instance learning (gated attention, Ilse et al., 2018).

A text is a bag of passages of 64 words.  Every passage is measured (lengths, shares of capitals, punctuation, digits and
repeated words, ...), its words are hashed into buckets whose embeddings are learned, and both are encoded by a small layer; gated attention weights, learned from the labels of whole documents,
mix the encodings; the mixture is scored.  So one bad passage can decide about a long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import labelled_texts, training_rows
from .wordhash import Words, raw_strings, slices

PASSAGE = 64
#: Columns of a passage: what is measured, and the buckets of its hashed words.
MEASURED, BUCKETS = 16, 64
MEASURES = MEASURED + BUCKETS
THRESHOLD = 0.3
#: Passages of a labelled text in the fit; of a longer text neighbours are averaged, so that all of it counts and its share is bounded.
BAG = 128
_CLASS = np.zeros((4, 256), np.int32)
for _b in range(256):
    _c = chr(_b)
    _CLASS[0, _b] = _b < 128 and _c.isupper()
    _CLASS[1, _b] = 33 <= _b < 127 and not _c.isalnum()
    _CLASS[2, _b] = _b < 128 and _c.isdigit()
    _CLASS[3, _b] = _b >= 128


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """float32 (passages, MEASURES) and the n+1 passage offsets of the rows; a row without words is one empty passage."""
    words = Words(data, offsets)
    count = np.diff(words.ptr)
    per_row = np.maximum(1, -(-count // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(count)), per_row)
    nth = np.arange(len(row)) - bounds[row]
    start = words.ptr[row] + nth * PASSAGE
    size = np.clip(count[row] - nth * PASSAGE, 0, PASSAGE)
    out = np.zeros((len(row), MEASURES), np.float32)
    filled = np.flatnonzero(size)
    if not len(filled):
        return out, bounds
    first, n = start[filled], size[filled]
    grid = first[:, None] + np.arange(PASSAGE)
    there = np.arange(PASSAGE) < n[:, None]
    grid = np.where(there, grid, first[:, None])
    sums = [np.concatenate([[0], np.cumsum(kind[words.data])]) for kind in _CLASS]
    letters = words.end - words.start
    per_word = [s[words.end] - s[words.start] for s in sums]
    total = lambda x: np.where(there, x[grid], 0).sum(axis=1)
    chars = total(letters)
    hashes = words.hashes()[grid]
    ordered = np.sort(np.where(there, hashes, hashes[:, :1]), axis=1)
    distinct = 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(axis=1)
    again = ((hashes[:, 1:] == hashes[:, :-1]) & there[:, 1:]).sum(axis=1)
    upper, punct, digit, high = (total(x) for x in per_word)
    f = [
        np.log1p(n) / 4, chars / n / 8, upper / chars, punct / chars, digit / chars, high / chars, distinct / n, again / n,
        total(per_word[1] == letters) / n, total(per_word[1] >= 2) / n, total(letters <= 3) / n, total(letters >= 9) / n,
        total((per_word[0] == letters) & (letters > 1)) / n, total(per_word[2] > 0) / n, total((per_word[0] >= 2)) / n,
        total(letters > 25) / n,
    ]
    out[filled, :MEASURED] = np.stack(f, axis=1)
    passage = np.repeat(bounds[:-1], count) + (np.arange(len(words.start)) - np.repeat(words.ptr[:-1], count)) // PASSAGE
    bucket = (words.hashes() >> np.uint64(32)).astype(np.int64) % BUCKETS
    out[:, MEASURED:] = np.bincount(passage * BUCKETS + bucket, minlength=len(row) * BUCKETS).reshape(-1, BUCKETS) / np.sqrt(np.maximum(size, 1))[:, None]
    return out, bounds


def bounded_bag(passages: np.ndarray) -> np.ndarray:
    """At most BAG rows: means of neighbouring passages, about as many in each, over the whole text."""
    n = len(passages)
    if n <= BAG:
        return passages
    first = np.arange(BAG) * n // BAG
    return (np.add.reduceat(passages, first, axis=0, dtype=np.float64) / np.diff(np.append(first, n))[:, None]).astype(passages.dtype)


@dataclass
class AttentionPooling:
    """``weights``: shift and scale of the measures, encoder, gates, attention and output layers."""

    weights: dict[str, np.ndarray]

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = raw_strings(column)
        out = np.zeros(len(column))
        for first, last in slices(offsets):
            x, bounds = measures(data[offsets[first] : offsets[last]], offsets[first : last + 1])
            out[first:last] = _forward(self.weights, (x - self.weights["shift"]) * self.weights["scale"], bounds)["p"]
        return out


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    s = (t * g) @ w["a"]
    bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    s = np.exp(s - np.maximum.reduceat(s, bounds[:-1])[bag])
    attention = s / np.add.reduceat(s, bounds[:-1])[bag]
    z = np.add.reduceat(attention[:, None] * h, bounds[:-1], axis=0)
    logit = z @ w["c"] + w["b"][0]
    return {"h": h, "t": t, "g": g, "bag": bag, "attention": attention, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    r = _forward(w, x, bounds)
    d = (r["p"] - y) / len(y)
    dz = d[:, None] * w["c"]
    da = (dz[r["bag"]] * r["h"]).sum(axis=1)
    mean = np.add.reduceat(r["attention"] * da, bounds[:-1])[r["bag"]]
    ds = r["attention"] * (da - mean)
    dt, dg = ds[:, None] * w["a"] * r["g"] * (1 - r["t"] ** 2), ds[:, None] * w["a"] * r["t"] * r["g"] * (1 - r["g"])
    dh = r["attention"][:, None] * dz[r["bag"]] + dt @ w["V"].T + dg @ w["U"].T
    du = dh * (1 - r["h"] ** 2)
    return {"E": x.T @ du, "e": du.sum(0), "V": r["h"].T @ dt, "U": r["h"].T @ dg, "a": (r["t"] * r["g"]).T @ ds, "c": r["z"].T @ d, "b": np.array([d.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 40, seed: int = 11) -> AttentionPooling:
    """Adam on the logistic loss of whole bags."""
    random = np.random.Generator(np.random.PCG64(seed))
    every = np.concatenate(bags)
    shift, scale = every.mean(0), 1 / (every.std(0) + 1e-3)
    init = lambda a, b: random.normal(0, a**-0.5, (a, b))
    w = {"E": init(MEASURES, hidden), "e": np.zeros(hidden), "V": init(hidden, gates), "U": init(hidden, gates),
         "a": random.normal(0, 0.1, gates), "c": random.normal(0, 0.1, hidden), "b": np.zeros(1)}
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    bags = [(x - shift) * scale for x in bags]
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(bags)), max(1, len(bags) // 128)):
            x = np.concatenate([bags[i] for i in part])
            bounds = np.concatenate([[0], np.cumsum([len(bags[i]) for i in part])])
            step += 1
            for k, g in _gradient(w, x, bounds, y[part]).items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return AttentionPooling({k: x.astype(np.float32) for k, x in {**w, "shift": shift, "scale": scale}.items()})


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", limits: dict[int, int] | None = None) -> AttentionPooling:
    """Fits on at most ``limits[y]`` labelled documents of each class (3,000 bad and 5,000 good by default), and on BAG rows of each.

    Rows with a null id or label are left out, of repeated ids one text and the greater label count, other columns are ignored.
    Without labelled rows every text is good.
    """
    sample = labelled_texts(docs, training_rows(labels, label, keep, limits or {0: 3000, 1: 5000}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            found = []
            for first, last in slices(offsets):
                x, bounds = measures(data[offsets[first] : offsets[last]], offsets[first : last + 1])
                found += [bounded_bag(x[bounds[i] : bounds[i + 1]]).astype("<f4").tobytes() for i in range(last - first)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "x"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {id_type}, y int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    bags = [np.frombuffer(x, "<f4").reshape(-1, MEASURES).astype(np.float64) for x in got.column("x").to_pylist()]
    y = got.column("y").to_numpy().astype(float)
    if not len(y):
        bags, y = [np.zeros((1, MEASURES))], np.ones(1)
    return train(bags, y)


def quality_score(model: AttentionPooling, text: str | Column) -> Column:
    """The probability that a text has label 1, over its whole length; empty and null texts have a score too."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column), pa.float64())

    return score(text)
