"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, and a unigram base.

Texts are lower-cased (A-Z) words and the end.  The model sees the subword ids of the words; an id is predicted in two
steps: its class, by self-attention over the ids before it, and the id within its class given the id before, from
smoothed counts over all training texts.  Both steps are normalised, so a text's score is a log-probability.  Attention runs in
overlapping windows: the queries are ``STRIDE`` ids, the keys those and the ``STRIDE`` before them, masked to the past, so each
id is scored once, with 8 to 15 ids before it.

Everything is learned from all training texts, whole: classes, frequent ids, counts, and the network, which starts from
weights fitted on a bounded sample; then each partition goes on by gradient steps over every window of its own training texts,
and the weights are averaged over the partitions by their ids.

A memory of phrases stands beside the network, since so small a network cannot remember a corpus.  Texts are cut into
phrases where two neighbouring ids have a hash divisible by ``PHRASE`` (and at the end), so equal passages are cut alike
wherever they stand.  A phrase has probability ``(1 - MEMORY) * network + MEMORY * count / all``, where the counts are those of
all training texts other than the one scored: a training text is judged by the others, like any other text.  Only phrases
that recur between texts are changed by it; their sum stays within one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from .wordhash import mix, raw_strings, slices

STRIDE, DIM, CLASSES, HIDDEN = 8, 8, 32, 16
#: Previous ids that are told apart within a class, ids that have counts of their own given them, and the smoothing mass.
KINDS, COLUMNS, SMOOTH = 512, 4096, 20.0
#: The network's first weights come from at most so many training texts, of which whole texts up to this many ids in all are used.
SAMPLE_TEXTS, SAMPLE_IDS = 3000, 500_000
#: Ids of a gradient step in a partition's pass over its training texts, and the rate of these steps.
STEP_IDS, STEP_RATE = 1 << 12, 0.003
#: Mean ids of a phrase, and the weight of the memory of phrases.
PHRASE, MEMORY = 64, 0.1
#: Ids that are classed by their neighbours, the neighbours that are told apart, and the least count of such ids.
CLASSED, NEIGHBOURS, CLASSED_LEAST = 4000, 256, 5
#: Bytes of text that are cut into words and encoded at once; a longer text is encoded alone.
ENCODED_BYTES = 1 << 23
#: So many of the most frequent words have their counts sent to the tasks; the counts of all others are joined.
HEAD_WORDS = 200_000
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Subwords:
    """Byte-level BPE ids of lower-cased words, each with a leading blank, then the end id."""

    def __init__(self, vocabulary_path: str):
        import base64

        import tiktoken

        with open(vocabulary_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encode = tiktoken.Encoding("words", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.begins = np.zeros(self.size, bool)  # ids that begin a word: no other holds a blank
        self.begins[[n for raw, n in ranks.items() if raw[:1] == b" "]] = True

    def __getitem__(self, word: bytes) -> bytes:
        return self.ids(word.decode())[:-1].astype(np.uint32).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, each with its end, and where each text begins and the last ends.  A word is encoded once."""
        data, offsets = raw_strings(texts)
        split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(_LOWER.take(data))))
        words, bounds = split.values, split.offsets.to_numpy().astype(np.int64)
        named = words.dictionary_encode()
        names, name = named.dictionary, named.indices.to_numpy()
        spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.scalar(" ", names.type))[0].as_py()
        flat = np.array(self._encode(" " + spelled), np.int32)
        size = np.zeros(len(names), np.int64)  # 0 for the empty piece beside white space at either end of a text
        size[pc.not_equal(names, "").to_numpy(zero_copy_only=False)] = np.diff(np.append(np.flatnonzero(self.begins.take(flat)), len(flat)))
        n = size.take(name)
        at = np.concatenate([[0], np.cumsum(n)])
        begin = at[bounds] + np.arange(len(bounds))  # an end stands behind each text
        out, word = np.full(begin[-1], self.end, np.int32), np.ones(begin[-1], bool)
        word[begin[1:] - 1] = False
        place = np.repeat((np.cumsum(size) - size).take(name) - at[:-1], n)
        place += np.arange(at[-1])
        out[word] = flat.take(place)
        return out, begin


@lru_cache(maxsize=1)
def keep_freed_memory() -> bool:
    """Lets a worker keep the memory it frees, up to some hundred megabytes.

    Temporary arrays of some hundred kilobytes are otherwise given back to the system and cleared by it again at every step, which
    takes as long as the arithmetic.  Where the C library has no such setting nothing changes.
    """
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    trim_threshold, top_pad, mmap_threshold = -1, -2, -3  # of glibc
    return set_option is not None and all(set_option(k, v) for k, v in ((mmap_threshold, 32 << 20), (trim_threshold, 256 << 20), (top_pad, 64 << 20)))


@lru_cache(maxsize=1)
def subwords_of(vocabulary_path: str) -> Subwords:
    """One for each worker."""
    return Subwords(vocabulary_path)


@dataclass
class AttentionModel:
    """``w``: query, key and value rows per kind of id (projections of one embedding), relative bias, output layers; ``group``: class of id."""

    w: dict[str, np.ndarray]
    group: np.ndarray
    kind: np.ndarray  # of a previous id: frequent ones are told apart, others by class
    column: np.ndarray  # of an id: frequent ones have their own, others share one for each class
    pair: np.ndarray = field(default_factory=lambda: np.zeros((KINDS, COLUMNS), np.float32))  # log P(column | class, kind)
    alone: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))  # log P(id | column)

    def count_pairs(self, ids: np.ndarray) -> np.ndarray:
        """How often each column follows each kind; ``ids``: whole texts, each with its end."""
        before = np.concatenate([[len(self.group) - 1], ids[:-1]])
        return np.bincount(self.kind.take(before) * COLUMNS + self.column.take(ids), minlength=KINDS * COLUMNS)

    def learn_counts(self, n_id: np.ndarray, n_pair: np.ndarray) -> None:
        """Sets the step within a class from counts of all ids, and of columns after kinds."""
        n_id = n_id + 0.05
        of_column = np.bincount(self.column, n_id, COLUMNS)
        self.alone = np.log(n_id / of_column[self.column]).astype(np.float32)
        group_of = np.zeros(COLUMNS, np.int64)
        group_of[self.column] = self.group
        share = of_column / np.maximum(np.bincount(group_of, of_column, CLASSES)[group_of], 1e-9)
        n_pair = n_pair.reshape(KINDS, COLUMNS).astype(np.float64)
        n_group = np.stack([np.bincount(group_of, row, CLASSES) for row in n_pair])
        with np.errstate(divide="ignore"):  # unused columns
            self.pair = np.log((n_pair + SMOOTH * share) / (n_group[:, group_of] + SMOOTH)).astype(np.float32)

    def log_probs(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log-probability of every id; ``bounds``: where the texts begin, and the end of the last."""
        size = np.diff(bounds)
        padded = np.concatenate([[0], np.cumsum(-(-size // STRIDE) * STRIDE)])  # windows begin with the texts
        place = np.repeat(padded[:-1] - bounds[:-1], size) + np.arange(len(ids))
        laid = np.full(padded[-1], len(self.group) - 1, ids.dtype)
        laid[place] = ids
        text = np.repeat(np.arange(len(size), dtype=np.int32), np.diff(padded))
        step = 1 << 13
        kinds, targets = self.kind.take(laid), self.group.take(laid)
        parts = [_class_log_probs(self.w, kinds, targets, self.kind[-1], text, i, min(i + step, len(laid)))[0] for i in range(0, len(laid), step)]
        out = np.concatenate([np.empty(0, np.float32), *parts]).take(place)
        before = np.concatenate([[len(self.group) - 1], ids[:-1]])
        out += self.pair.ravel().take(self.kind.take(before) * COLUMNS + self.column.take(ids))
        out += self.alone.take(ids)
        return out


def _context(kinds: np.ndarray, text: np.ndarray, first: int, last: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The kinds before each target, from STRIDE before the first to the last, padded to whole windows; and their texts.

    ``text`` is the number of the text of each id.  A text begins with the start mark in place of the last id of the one before.
    """
    end = first + -(-(last - first) // STRIDE) * STRIDE
    if first > STRIDE and end <= len(kinds):  # nothing to pad
        owner, context = text[first - STRIDE : end], kinds[first - STRIDE - 1 : end - 1].copy()
        context[np.flatnonzero(owner != text[first - STRIDE - 1 : end - 1])] = start
        return context, owner
    high = min(end, len(kinds))
    context, owner = np.full(end - first + STRIDE, start, kinds.dtype), np.full(end - first + STRIDE, -1, text.dtype)
    here = slice(max(0, first - STRIDE), high)  # the targets that the context stands before
    at = here.start - (first - STRIDE)
    owner[at : at + high - here.start] = text[here]
    before = slice(max(1, here.start), high)
    at = before.start - (first - STRIDE)
    inside = text[before] == text[before.start - 1 : high - 1]
    context[at : at + high - before.start] = np.where(inside, kinds[before.start - 1 : high - 1], start)
    return context, owner


_OFFSET = (np.arange(STRIDE)[:, None] + STRIDE) - np.arange(2 * STRIDE)[None, :]
_LAG = np.clip(_OFFSET, 0, None)
_CELLS = np.arange(KINDS * DIM).reshape(KINDS, DIM)
_ONES_KEYS, _ONES_CLASSES = np.ones((2 * STRIDE, 1), np.float32), np.ones(CLASSES, np.float32)


def _class_log_probs(w: dict[str, np.ndarray], kinds: np.ndarray, targets: np.ndarray, start: int, text: np.ndarray, first: int, last: int, keep: bool = False):
    """Log-probabilities of the classes ``targets`` of ids first..last, from the ``kinds`` before them; with ``keep`` what their gradient needs.

    ``take``, work in place and sums as products are several times faster here.  Products of small matrices are fastest where both
    lie as they are multiplied: keys and values are held by dimension too, so that a window of them is a view.  The hyperbolic
    tangent of the hidden layer is ``2 * u - 1`` with ``u = 1 / (1 + exp(-2 * z))``; the tables hold the layers around it in terms
    of ``u``, and what an id itself adds to ``z`` is looked up by its kind.
    """
    context, owner = _context(kinds, text, first, last, start)
    now = context[STRIDE:]
    q = w["Q"].take(now, axis=0).reshape(-1, STRIDE, DIM)
    k, v = (w[name].take(context, axis=0) for name in "KV")
    a = q @ _by_dimension(k)
    a += w["bias"]  # what lies ahead is far below zero
    if w["sharpest"] > 30:
        np.minimum(a, 30, out=a)
    np.exp(a, out=a)
    crossing = np.flatnonzero(owner[: -2 * STRIDE + 1 : STRIDE] != owner[2 * STRIDE - 1 :: STRIDE])
    if len(crossing):  # attention stays in its text
        t = owner[crossing[:, None] * STRIDE + np.arange(2 * STRIDE)]
        a[crossing] *= t[:, None, :] == t[:, STRIDE:, None]
    total = a.reshape(-1, 2 * STRIDE) @ _ONES_KEYS.astype(a.dtype, copy=False)
    n = last - first
    m = (a @ _windows(v)).reshape(-1, DIM)
    m /= total
    u = m[:n] @ w["mixed to u"]
    u += w["own to u"].take(now[:n], axis=0)  # the last column is -inf, so that of u is 1 and carries the bias
    with np.errstate(over="ignore"):  # 1 / inf is the limit
        np.exp(u, out=u)
    u += 1
    np.reciprocal(u, out=u)
    e = u @ w["u to classes"]
    if w["largest"] > 60:
        np.minimum(e, 60, out=e)
    cell = np.arange(0, n * CLASSES, CLASSES)
    cell += targets[first:last]
    at_target = None if keep else e.ravel().take(cell)
    np.exp(e, out=e)
    mass = e @ _ONES_CLASSES.astype(e.dtype, copy=False)
    if keep:
        return context, q, k, v, a, total, m, u, e, mass, cell
    return (at_target - np.log(mass),)


def _windows(rows: np.ndarray) -> np.ndarray:
    """(windows, 2 * STRIDE, DIM): a view of the rows."""
    return np.ndarray((len(rows) // STRIDE - 1, 2 * STRIDE, DIM), rows.dtype, rows, 0, (STRIDE * rows.strides[0], *rows.strides))


def _by_dimension(rows: np.ndarray) -> np.ndarray:
    """(windows, DIM, 2 * STRIDE): a view of the rows laid out by dimension."""
    laid = np.ascontiguousarray(rows.T)
    return np.ndarray((len(rows) // STRIDE - 1, DIM, 2 * STRIDE), laid.dtype, laid, 0, (STRIDE * laid.itemsize, *laid.strides))


def _classed(count: np.ndarray) -> np.ndarray:
    """The ids that are frequent enough to be classed by their neighbours, the most frequent first."""
    return np.argsort(-count, kind="stable")[: min(CLASSED, int((count >= CLASSED_LEAST).sum()))]


def _neighbour_keys(ids: np.ndarray, place: np.ndarray, end: int) -> np.ndarray:
    """Cells of the table of neighbours for whole texts: by place, the frequent ids before it, then those after it."""
    before = np.concatenate([[end], ids[:-1]])
    a, b = place.take(before), place.take(ids)
    left, right = (a >= 0) & (a < NEIGHBOURS) & (b >= 0), (b >= 0) & (b < NEIGHBOURS) & (a >= 0)
    return np.concatenate([b[left] * (2 * NEIGHBOURS) + a[left], a[right] * (2 * NEIGHBOURS) + NEIGHBOURS + b[right]])


def _places(top: np.ndarray, size: int) -> np.ndarray:
    place = np.full(size, -1, np.int64)
    place[top] = np.arange(len(top))
    return place


def _classes(count: np.ndarray, top: np.ndarray, table: np.ndarray, end: int, seed: int) -> np.ndarray:
    """Classes of ids by their neighbours: k-means on a reduced co-occurrence matrix; rare ids by two rules."""
    random = np.random.Generator(np.random.PCG64(seed))
    group = np.where(np.arange(len(count)) % 2 == 0, CLASSES - 3, CLASSES - 2)
    if len(top) > CLASSES:
        table = table.reshape(len(top), 2 * NEIGHBOURS).astype(np.float64)
        table = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))
        u, s, _ = np.linalg.svd(table - table.mean(axis=0), full_matrices=False)
        point = u[:, :16] * s[:16]
        centre = point[random.choice(len(point), CLASSES - 3, replace=False, p=count[top] ** 0.5 / (count[top] ** 0.5).sum())]
        weight = count[top].astype(float)
        for _ in range(25):
            near = np.argmin((point**2).sum(1)[:, None] - 2 * point @ centre.T + (centre**2).sum(1)[None], axis=1)
            mass = np.bincount(near, weight, len(centre))
            for d in range(point.shape[1]):
                centre[:, d] = np.where(mass > 0, np.bincount(near, weight * point[:, d], len(centre)) / np.maximum(mass, 1), centre[:, d])
        group[top] = near
    group[end] = CLASSES - 1
    return group.astype(np.int64)


def _layout(count: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, kind and column of every id."""
    frequent = np.argsort(-count, kind="stable")
    kind, column = KINDS - CLASSES + group, COLUMNS - CLASSES + group
    kind[frequent[: KINDS - CLASSES]] = np.arange(KINDS - CLASSES)
    column[frequent[: COLUMNS - CLASSES]] = np.arange(COLUMNS - CLASSES)
    return group, kind, column


def _gradient(p: dict[str, np.ndarray], w: dict[str, np.ndarray], kinds: np.ndarray, targets: np.ndarray, start: int, text: np.ndarray, first: int, last: int) -> dict[str, np.ndarray]:
    """Sums over ids first..last of the gradients of the cross-entropy; rows of tables are summed by kind first.

    Softmaxes are left undivided and the narrower factors beside them are divided instead.
    """
    context, q, k, v, a, total, m, u, d, mass, cell = _class_log_probs(w, kinds, targets, start, text, first, last, keep=True)
    n, dtype = last - first, u.dtype
    d.ravel()[cell] -= mass
    scaled = u * (1 / mass)[:, None]
    of_u = scaled.T @ d
    g = {"O": np.concatenate([2 * of_u[:-1] - of_u[-1], of_u[-1:]])}
    u *= scaled
    np.subtract(scaled, u, out=u)  # a quarter of the tangent's slope; 0 in the last column
    dz = d @ w["classes to u"]
    dz *= u
    now = context[STRIDE : STRIDE + n]
    by_m, by_x, by_1 = m[:n].T @ dz, w["X"].take(now, axis=0).T @ dz, np.ones((1, n), dtype) @ dz
    g["H"] = np.concatenate([by_m, by_x, by_1])[:, :HIDDEN]
    dm = np.zeros((len(q) * STRIDE, DIM), dtype)
    np.matmul(dz, w["u to mixed"], out=dm[:n])
    dm /= total
    shift = ((dm * m) @ _ONES_KEYS[:DIM].astype(dtype, copy=False)).reshape(-1, STRIDE, 1)
    dm = dm.reshape(-1, STRIDE, DIM)
    da = dm @ _by_dimension(v)
    da -= shift
    da *= a
    dv = a.transpose(0, 2, 1) @ dm
    dq, dk = da @ _windows(k), da.transpose(0, 2, 1) @ q
    g["r"] = np.bincount(_LAG.ravel(), np.ones(len(da), dtype) @ da.reshape(len(da), -1), 2 * STRIDE)

    cells = _CELLS.take(context, axis=0).ravel()
    x = dz @ w["u to own"]
    rows = {name: np.bincount(cells[STRIDE * DIM :][: y.size], y.ravel(), KINDS * DIM).reshape(KINDS, DIM) for name, y in (("q", dq), ("x", x))}
    for name, y in (("k", dk), ("v", dv)):  # a context id is a key of two windows
        placed = np.zeros((len(y) + 1, STRIDE, DIM), dtype)
        placed[:-1] = y[:, :STRIDE]
        placed[1:] += y[:, STRIDE:]
        rows[name] = np.bincount(cells, placed.ravel(), KINDS * DIM).reshape(KINDS, DIM)
    every = np.concatenate([rows[name] for name in "qkvx"], axis=1).astype(dtype)
    g["E"] = every @ np.concatenate([p[name] for name in "qkvx"], axis=1).T
    return {**g, **dict(zip("qkvx", np.split(p["E"].T @ every, 4, axis=1), strict=True))}


class _Adam:
    """Steps on all weights at once: the arrays of ``p`` become views of one, ``flat``, by name."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.names, self.t = sorted(p), 0
        self.flat = np.concatenate([p[k].ravel() for k in self.names])
        for k, part in zip(self.names, np.split(self.flat, np.cumsum([p[k].size for k in self.names])[:-1]), strict=True):
            p[k] = part.reshape(p[k].shape)
        self.m, self.s = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, g: dict[str, np.ndarray], n: int, rate: float) -> None:
        """``g``: sums of gradients over ``n`` ids."""
        self.t += 1
        grad = (np.concatenate([g[k].ravel() for k in self.names]) / n).astype(self.flat.dtype, copy=False)
        self.m += 0.1 * (grad - self.m)
        self.s += 0.01 * (grad * grad - self.s)
        self.flat -= (rate / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.s * (1 / (1 - 0.99**self.t))) + 1e-8)


def _model(p: dict[str, np.ndarray], layout: tuple[np.ndarray, np.ndarray, np.ndarray]) -> AttentionModel:
    return AttentionModel({k: x.astype(np.float32) for k, x in _tables(p).items()}, *layout)


def train(texts: list[np.ndarray], size: int, end: int, epochs: int = 4, seed: int = 5) -> AttentionModel:
    """A model of ``texts`` alone: classes and frequent ids are theirs too."""
    ids = np.concatenate([*texts, np.array([end], np.int32)])
    count = np.bincount(ids, minlength=size)
    top = _classed(count)
    table = np.bincount(_neighbour_keys(ids, _places(top, size), end), minlength=len(top) * 2 * NEIGHBOURS)
    layout = _layout(count, _classes(count, top, table, end, seed))
    return _model(train_weights(texts, layout, epochs, seed), layout)


def train_weights(texts: list[np.ndarray], layout: tuple[np.ndarray, np.ndarray, np.ndarray], epochs: int = 4, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy of classes, over windows of ``texts``."""
    random = np.random.Generator(np.random.PCG64(seed))
    group, kind, _ = layout
    end = len(group) - 1
    ids = np.concatenate([*texts, np.array([end], np.int32)])
    kinds, targets = kind[ids], group[ids]
    text = np.repeat(np.arange(len(texts) + 1), [*(len(t) for t in texts), 1])
    embed = random.normal(0, 0.5, (KINDS, 2 * DIM))  # frequent ids have their own embedding, others that of their class
    p = {"E": embed, "q": random.normal(0, 0.3, (2 * DIM, DIM)), "k": random.normal(0, 0.3, (2 * DIM, DIM)), "v": random.normal(0, 0.3, (2 * DIM, DIM)),
         "x": random.normal(0, 0.3, (2 * DIM, DIM)), "r": np.zeros(2 * STRIDE), "H": np.vstack([random.normal(0, 0.25, (2 * DIM, HIDDEN)), np.zeros(HIDDEN)]),
         "O": np.vstack([random.normal(0, 0.2, (HIDDEN, CLASSES)), np.log(np.bincount(targets, minlength=CLASSES) + 1.0) - np.log(len(ids))])}
    adam, chunk = _Adam(p), 2048
    starts = np.arange(0, len(ids) - 1, chunk)
    for epoch in range(epochs):
        for first in random.permutation(starts):
            last = min(first + chunk, len(ids))
            adam.step(_gradient(p, _tables(p), kinds, targets, kind[end], text, first, last), last - first, 0.01 * (1 - epoch / (epochs + 1)))
    return p


def _joined(batch: pa.RecordBatch, dtype: str, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and text numbers of some whole texts at a time, from a column of encoded ids."""
    held, size = [], 0
    for raw in [*batch.column("ids").to_pylist(), None]:
        if held and (raw is None or size + len(raw) > most * np.dtype(dtype).itemsize):
            ids = np.frombuffer(b"".join(held), dtype).astype(np.int32)
            yield ids, np.repeat(np.arange(len(held)), [len(x) // np.dtype(dtype).itemsize for x in held])
            held, size = [], 0
        if raw is not None:
            held.append(raw)
            size += len(raw)


def fit_everywhere(model: AttentionModel, p: dict[str, np.ndarray], encoded: DataFrame, dtype: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One pass over all training texts (``ids``): the averaged weights, and the counts of pairs.

    Each partition starts from ``p`` and takes a step for every ``STEP_IDS`` of its ids; of its weights the mean over its steps
    counts, by its ids.  At most one row for each weight and pair is gathered.
    """
    names = sorted(p)
    sizes = [p[k].size for k in names]
    kind, group = model.kind, model.group  # of the index type, which bincount and take want

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        own = {k: x.astype(np.float32) for k, x in p.items()}
        adam, n, steps = _Adam(own), 0, 0
        mean = np.zeros(adam.flat.shape)
        pairs = np.zeros(KINDS * COLUMNS, np.int64)
        for batch in batches:
            for ids, text in _joined(batch, dtype):
                pairs += model.count_pairs(ids)
                kinds, targets = kind.take(ids), group.take(ids)
                for first in range(0, len(ids), STEP_IDS):
                    last = min(first + STEP_IDS, len(ids))
                    g = _gradient(own, _tables(own), kinds, targets, kind[-1], text, first, last)
                    adam.step(g, last - first, STEP_RATE * (last - first) / STEP_IDS)
                    mean += adam.flat
                    steps += 1
                n += len(ids)
        if n:
            some = np.flatnonzero(pairs)
            at, x = np.concatenate([np.arange(-1, len(mean)), len(mean) + some]), np.concatenate([[n], mean * (n / steps), pairs[some]])
            yield pa.record_batch([pa.array(at), pa.array(x)], ["at", "x"])

    got = encoded.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    at, x = got.column("at").to_numpy(), got.column("x").to_numpy()
    found = np.zeros(1 + sum(sizes) + KINDS * COLUMNS)
    found[at + 1] = x
    if found[0]:
        parts = np.split(found[1 : 1 + sum(sizes)] / found[0], np.cumsum(sizes)[:-1])
        p = {k: part.reshape(p[k].shape) for k, part in zip(names, parts, strict=True)}
    return p, found[1 + sum(sizes) :]


def _tables(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rows looked up in the forward pass: projections are applied to the embeddings once, not to every id of a text."""
    out = {name: p["E"] @ p[low] for name, low in (("Q", "q"), ("K", "k"), ("V", "v"), ("X", "x"))}
    bias = np.where(_OFFSET >= 0, p["r"][_LAG], np.array(-1e4, p["r"].dtype))
    o, twice = p["O"], np.zeros((2 * DIM + 1, HIDDEN + 1), p["H"].dtype)
    np.multiply(p["H"], -2, out=twice[:, :HIDDEN])
    own = out["X"] @ twice[DIM:-1]
    own += twice[-1]
    own[:, HIDDEN] = -np.inf
    back = np.zeros((CLASSES, HIDDEN + 1), o.dtype)
    np.multiply(o[:HIDDEN].T, 4, out=back[:, :HIDDEN])
    return {
        **out, "bias": bias, "H": p["H"], "O": o, "mixed to u": twice[:DIM], "own to u": own, "u to classes": np.concatenate([2 * o[:HIDDEN], o[HIDDEN:] - o[:HIDDEN].sum(axis=0)]),
        "classes to u": back, "u to mixed": -0.5 * twice[:DIM].T, "u to own": -0.5 * twice[DIM:-1].T, "largest": np.abs(o).sum(axis=0).max(),
        "sharpest": np.sqrt(np.vecdot(out["Q"], out["Q"]).max() * np.vecdot(out["K"], out["K"]).max()) + p["r"].max(),  # at least any score of attention
    }


def phrases(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of some texts: where each begins and, last, where all end; and their hashes."""
    u = ids.astype(np.uint64)
    cut = np.zeros(len(ids) + 1, bool)
    with np.errstate(over="ignore"):
        pair = mix(u[:-1] * np.uint64(0x9E3779B97F4A7C15) + u[1:])
        cut[2:] = pair % np.uint64(PHRASE) == 0
        cut[bounds[1:-1] + 1] = False  # these two ids are of different texts
        cut[bounds] = True
    start = np.flatnonzero(cut)
    return start, _run_hashes(u, start, 0x5851F42D4C957F2D)


def words_of(ids: np.ndarray, bounds: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each word of some texts, and the hash of the word's ids; ends are no words.  Equal words have equal ids."""
    first = begins.take(ids)
    first[bounds[1:] - 1] = True
    start = np.flatnonzero(first)
    key = _run_hashes(ids.astype(np.uint64), np.append(start, len(ids)), 0xD1342543DE82EF95)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds)))
    word = np.ones(len(start), bool)
    word[np.searchsorted(start, bounds[1:] - 1)] = False
    return doc[word], key[word]


def _run_hashes(u: np.ndarray, start: np.ndarray, seed: int) -> np.ndarray:
    if len(start) < 2:
        return np.empty(0, np.uint64)
    n = np.diff(start)
    place = np.arange(len(u), dtype=np.int64)
    place -= np.repeat(start[:-1], n)
    term = mix(u + np.uint64(1) + (place.view(np.uint64) << np.uint64(32)))
    return mix(np.add.reduceat(term, start[:-1]) + n.astype(np.uint64) * np.uint64(seed))


class _Head:
    """Counts of frequent keys, found by their high bits: keys are hashes, so almost all of these tell them apart."""

    BITS = 20

    def __init__(self, key: np.ndarray, n: np.ndarray):
        order = np.argsort(key.view(np.uint64))
        self.key, self.n = np.append(key[order], 0), np.append(n[order], 0)
        top = (key[order].view(np.uint64) >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange(1 << self.BITS)).astype(np.int32)
        self.most = int(np.bincount(top, minlength=1).max(initial=0))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its count."""
        at = self.first.take((key.view(np.uint64) >> np.uint64(64 - self.BITS)).view(np.int64))
        hit, n = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        for _ in range(self.most):
            same = self.key.take(at) == key
            same &= at < len(self.key) - 1
            hit |= same
            n[same] = self.n.take(at[same])
            at = np.minimum(at + 1, len(self.key) - 1)
        return hit, n


def _remembered(network: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log10 of the mixture of a phrase's probability (``network``: its log10) and ``count`` of ``total`` phrases."""
    a = network + np.log10(1 - MEMORY)
    seen = (count > 0) & (total > 0)
    b = np.where(seen, np.log10(MEMORY) + np.log10(np.maximum(count, 1)) - np.log10(np.maximum(total, 1)), -np.inf)
    return np.where(seen, np.maximum(a, b) + np.log10(1 + 10 ** -np.abs(np.where(seen, a - b, 0))), a)


class _Tally:
    """Distinct keys and their counts so far, handed on when they become many."""

    LIMIT = 600_000

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, hashes: np.ndarray) -> bool:
        """Whether it is time to hand on."""
        key, n = np.unique(hashes, return_counts=True)
        self.keys.append(key)
        self.counts.append(n)
        self.size += len(key)
        return self.size > self.LIMIT

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate([np.empty(0, np.uint64), *self.keys]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.empty(0, np.int64), *self.counts]), len(key)).astype(np.int64)
        self.keys, self.counts, self.size = [], [], 0
        return key, n


def _key_counts(encoded: DataFrame, vocabulary_path: str, dtype: str) -> DataFrame:
    """``(key, phrase, n)`` of the hashed words and the phrases of ``encoded`` (ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, begins = _Tally(), subwords_of(vocabulary_path).begins

        def rows(key: np.ndarray, n: np.ndarray, phrase: bool) -> pa.RecordBatch:
            return pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.full(len(key), phrase)), pa.array(n)], ["key", "phrase", "n"])

        for batch in batches:
            for ids, text in _joined(batch, dtype):
                bounds = np.searchsorted(text, np.arange(text[-1] + 2))
                yield rows(*np.unique(phrases(ids, bounds)[1], return_counts=True), True)
                if tally.add(words_of(ids, bounds, begins)[1]):
                    yield rows(*tally.take(), False)
        yield rows(*tally.take(), False)

    return encoded.select("ids").mapInArrow(run, "key long, phrase boolean, n long").groupBy("key", "phrase").agg(F.sum("n").alias("n"))


def _decoded(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, and where each text begins and the last ends."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) // np.dtype(dtype).itemsize for x in raw])])


def _encoded(texts: DataFrame, vocabulary_path: str, dtype: str) -> DataFrame:
    """``(uid, id, learn, ids)`` of ``texts`` (uid, id, learn, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = subwords_of(vocabulary_path)
        for batch in batches:
            for first, last in slices(raw_strings(batch.column("t"))[1], ENCODED_BYTES):
                some = batch.slice(first, last - first)
                ids, bounds = subwords.batch(some.column("t"))
                at = (bounds * np.dtype(dtype).itemsize).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(at), pa.py_buffer(ids.astype(dtype))])
                yield pa.record_batch([*(some.column(c) for c in ("uid", "id", "learn")), texts], ["uid", "id", "learn", "ids"])

    return texts.mapInArrow(run, f"uid long, id {texts.schema['id'].dataType.simpleString()}, learn boolean, ids binary")


def _counted(encoded: DataFrame, keys, size: int, dtype: str) -> np.ndarray:
    """How often each of ``size`` keys occurs in all texts; ``keys``: of the ids of whole texts.  At most one row for a key is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for ids, _ in _joined(batch, dtype, 1 << 20):
                n += np.bincount(keys(ids), minlength=size)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], ["key", "n"])

    found = encoded.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out


def score_texts(docs: DataFrame, learn: Column, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row; scores are log10 probabilities.

    Tokens are the words and one end for each text.  Learns from the rows for which ``learn`` holds.  A null or empty text has
    one token, the end.  Repeated rows are scored each.  Without training rows the base is uniform.  Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("t"))
    subwords = subwords_of(vocabulary_path)
    vocabulary, end = subwords.size, subwords.end
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    every = durable(_encoded(rows, vocabulary_path, dtype))  # texts are encoded once
    training = every.where("learn")

    # a hash threshold leaves about twice the sample before it is ordered, so no task gathers more however many texts there are
    learned = training.count()
    mark = F.pmod(F.xxhash64("id", "ids"), F.lit(1 << 30))
    drawn = training.where(mark < int((1 << 30) * min(1.0, 2 * SAMPLE_TEXTS / max(1, learned))))
    texts, size = [], 0
    for raw in drawn.orderBy(mark, "ids").limit(SAMPLE_TEXTS).select("ids").toArrow().column("ids").to_pylist():
        ids = np.frombuffer(raw, dtype).astype(np.int32)
        if not texts or size + len(ids) <= SAMPLE_IDS:
            texts.append(ids)
            size += len(ids)
    n_id = _counted(training, lambda ids: ids, vocabulary, dtype)
    top = _classed(n_id)
    place = _places(top, vocabulary)
    table = _counted(training, lambda ids: _neighbour_keys(ids, place, end), len(top) * 2 * NEIGHBOURS, dtype)
    layout = _layout(n_id, _classes(n_id, top, table, end, 5))
    del table
    first = train_weights(texts, layout)
    weights, n_pair = fit_everywhere(_model(first, layout), first, training.select("ids"), dtype)
    model = _model(weights, layout)
    model.learn_counts(n_id, n_pair)
    del n_pair, texts

    counts = durable(_key_counts(training, vocabulary_path, dtype))
    # totals, and a histogram of some hundred rows
    step = F.floor(F.log2("n") * 8).cast("int")
    bars = counts.groupBy("phrase", step.alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()
    n_phrases = sum(r["n"] for r in bars if r["phrase"])
    words_n, words_v = (sum(r[c] for r in bars if not r["phrase"]) for c in ("n", "keys"))
    ends = int(n_id[end])  # one for each training text
    n_train, v_train = words_n + ends, words_v + (ends > 0)
    # the keys above a count that at most HEAD_WORDS reach
    keys, least = 0, None
    for level in sorted({r["level"] for r in bars}, reverse=True):
        keys += sum(r["keys"] for r in bars if r["level"] == level)
        if keys > HEAD_WORDS:
            break
        least = level
    head = counts.where(step >= least if least is not None else F.lit(False)).select("key", "n").toArrow()
    frequent = _Head(head.column("key").to_numpy(), head.column("n").to_numpy())
    base = np.log10(n_train + 0.5 * (v_train + 1))
    end_score = float(np.log10(ends + 0.5) - base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        begins = subwords_of(vocabulary_path).begins
        for batch in batches:
            size = pc.binary_length(batch.column("ids")).to_numpy()
            for first, last in slices(np.concatenate([[0], np.cumsum(size, dtype=np.int64)])):
                n = last - first
                ids, bounds = _decoded(batch.column("ids").slice(first, n), dtype)
                word_doc, h = words_of(ids, bounds, begins)
                h = h.view(np.int64)
                hit, count = frequent.find(h)
                known = np.bincount(word_doc[hit], minlength=n)
                part = np.bincount(word_doc[hit], np.log10(count[hit] + 0.5) - base, n)

                start, phrase = phrases(ids, bounds)
                phrase = phrase.view(np.int64)
                network = np.add.reduceat(model.log_probs(ids, bounds).astype(np.float64), start[:-1]) / np.log(10)
                doc = np.searchsorted(bounds, start[:-1], "right") - 1
                mine = np.where(batch.column("learn").slice(first, n).to_numpy(zero_copy_only=False), 1, 0)
                same = np.lexsort((phrase, doc))
                fresh = np.flatnonzero(np.concatenate([[True], (np.diff(doc[same]) != 0) | (np.diff(phrase[same]) != 0)]))
                own = np.empty(len(phrase), np.int64)  # how often the phrase is in its own text, if that is one of training
                own[same] = np.repeat(np.diff(np.append(fresh, len(same))), np.diff(np.append(fresh, len(same))))
                own *= mine[doc]
                others = n_phrases - mine * np.bincount(doc, minlength=n)
                seen, count = frequent.find(phrase)
                score = np.bincount(doc[seen], _remembered(network[seen], count[seen] - own[seen], others[doc[seen]]), n).astype(float)

                # what is left to the join: words (no network) and phrases, by text
                key, owner = np.concatenate([h[~hit], phrase[~seen]]), np.concatenate([word_doc[~hit], doc[~seen]])
                by_text, w = np.argsort(owner, kind="stable"), int((~hit).sum())
                word = (np.arange(len(key)) < w)[by_text]
                pad = lambda x, t: pa.array(np.concatenate([np.zeros(w, t), x[~seen].astype(t)])[by_text], mask=word)
                entries = pa.StructArray.from_arrays([pa.array(key[by_text]), pad(network, np.float32), pad(own, np.int32)], ["key", "network", "own"])
                cuts = np.searchsorted(owner[by_text], np.arange(n + 1))
                yield pa.record_batch(
                    [
                        batch.column("uid").slice(first, n), batch.column("id").slice(first, n), pa.array(np.bincount(word_doc, minlength=n) + 1, pa.int64()),
                        pa.array(known + (ends > 0), pa.int64()), pa.array(part + end_score), pa.array(score), pa.array(others, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entries),
                    ],
                    ["uid", "id", "n_tokens", "known", "part", "score", "others", "rare"],
                )

    entry = "struct<key: long, network: float, own: int>"
    scored = durable(every.mapInArrow(run, f"uid long, id {id_type}, n_tokens long, known long, part double, score double, others long, rare array<{entry}>"))
    rare = scored.select("uid", "others", F.inline("rare")).join(counts.select("key", "n"), "key", "left")
    count = F.coalesce("n", F.lit(0))
    a, left = F.col("network") + F.lit(float(np.log10(1 - MEMORY))), count - F.col("own")
    b = F.lit(float(np.log10(MEMORY))) + F.log10(left) - F.log10("others")
    mixed = F.when((left > 0) & (F.col("others") > 0), F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b)))).otherwise(a)
    word = F.col("network").isNull()
    sums = rare.groupBy("uid").agg(
        F.count(F.when(word, F.col("n"))).alias("more"), F.sum(F.when(word, F.log10(count + 0.5) - F.lit(float(base)))).alias("rest"), F.sum(F.when(~word, mixed)).alias("phrases")
    )
    out = scored.drop("rare", "others").join(sums, "uid", "left")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("phrases", F.lit(0.0))).alias("score"),
    )
