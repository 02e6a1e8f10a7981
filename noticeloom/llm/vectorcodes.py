"""Vector codes: every part of a vector is replaced by the number of its nearest codebook entry, found by exponion search.

Training follows fixed rounds of assignment and integer means.  A part starts at the entry it had before, ``a`` at distance ``u``.  An entry at
least as near lies within ``2 u`` of ``a`` (triangle inequality), so only the beginning of the list of ``a``'s neighbours, sorted
by distance, has to be scanned (after Newling and Fleuret, 2016).  All distances are squares of whole numbers and
exact, and ties go to the lower index, so the result is that of a full search.

Rows stay in the tasks: a round is one pass that assigns and one that sums, of which only sums by part and entry are gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.durable import durable
from .skew import looked_up

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Neighbours looked at in one step.
STEP = 8
_LONG = 2**63 - 1

Books = dict[int, list[np.ndarray]]


def held_at(dim: int) -> int:
    """Components are held within this bound, so that the error of a vector fits 63 bits; 2**27 for 64 dimensions."""
    return 1 << max(1, min(30, (62 - max(1, dim).bit_length()) // 2 - 1))


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part; sizes differ by one at most, longer ones first."""
    size, more = divmod(dim, parts)
    begins = [i * size + min(i, more) for i in range(parts + 1)]
    return list(zip(begins, begins[1:], strict=False))


def whole_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, dim, v)``: ``floor(scale * x)`` as int32 bytes; vectors that are null or hold null or non-finite components go."""
    x = F.col(vector_col).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                flat = np.floor(flat * scale)
            bound = np.repeat(np.array([held_at(int(d)) for d in size], float), size)
            data, ends = np.clip(flat, -bound, bound).astype("<i4").tobytes(), 4 * np.cumsum(size)
            rows = [data[e - 4 * s : e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(size, pa.int32()), pa.array(rows, pa.binary())], ["id", "label", "dim", "v"])

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    rows = df.where(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    return rows.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, dim int, v binary")


def first_books(vectors: DataFrame, parts: int, entries: int) -> Books:
    """For each size of vectors the parts of the ``entries`` smallest ids; of equal ids the smaller vector."""
    nth = F.row_number().over(W.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), "v"))
    rows = vectors.select("dim", "v", nth.alias("nth")).where(F.col("nth") <= entries).collect()
    books: Books = {}
    for dim in sorted({r.dim for r in rows}):
        own = sorted((r.nth, bytes(r.v)) for r in rows if r.dim == dim)
        matrix = np.frombuffer(b"".join(v for _, v in own), "<i4").reshape(len(own), dim).astype(np.int64)
        books[dim] = [matrix[:, a:b].copy() for a, b in cuts(dim, parts)]
    return books


def nearest(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance, by exponion search from ``start``; rows and entries are whole numbers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 16 * max(1, x.shape[1]) * top * top < 2**53 else np.int64  # either is exact
    x, book = x.astype(kind), book.astype(kind)
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(-1)
    order = np.argsort(apart, axis=1, kind="stable")
    apart = np.take_along_axis(apart, order, axis=1)
    best, index = ((x - book[start]) ** 2).sum(-1), start.astype(np.int64)
    #: d(a, j) <= 2 u, in squares without overflow: a quarter, rounded up, is at most u squared.
    quarter = np.ceil(apart / 4) if kind is np.float64 else -(-apart // 4)
    reach = np.empty(len(x), np.int64)
    for a in np.unique(start):
        own = start == a
        reach[own] = np.searchsorted(quarter[a], best[own], "right")
    for first in range(0, len(book), STEP):
        rows = np.flatnonzero(reach > first)
        if not len(rows):
            break
        entry = order[start[rows], first : first + STEP]
        far = ((x[rows, None, :] - book[entry]) ** 2).sum(-1)
        for c in range(entry.shape[1]):
            d, e = far[:, c], entry[:, c]
            better = (d < best[rows]) | (d == best[rows]) & (e < index[rows])
            best[rows[better]], index[rows[better]] = d[better], e[better]
    return index, best.astype(np.int64)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    dims, rows = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, np.frombuffer(b"".join(rows[i] for i in at), "<i4").reshape(len(at), dim).astype(np.int64)


def digest(book: list[np.ndarray]) -> str:
    """sha256 of all components as decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def assigned(vectors: DataFrame, books: Books, parts: int) -> DataFrame:
    """``vectors`` with ``codes`` (a byte a part), ``error`` and the digest of the codebooks; earlier codes are where the search starts."""
    sums = {dim: digest(book) for dim, book in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            codes, error, names = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64), np.empty(n, object)
            before = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts)
            for dim, at, matrix in _by_size(batch):
                names[at] = sums[dim]
                for p, (a, b) in enumerate(cuts(dim, parts)):
                    index, far = nearest(matrix[:, a:b], before[at, p].astype(np.int64), books[dim][p])
                    codes[at, p] = index
                    error[at] += far
            flat = codes.tobytes()
            new = [flat[parts * i : parts * i + parts] for i in range(n)]
            kept = [batch.column(c) for c in ("id", "label", "dim", "v")]
            yield pa.record_batch([*kept, pa.array(new, pa.binary()), pa.array(error), pa.array(names, pa.string())], ["id", "label", "dim", "v", "codes", "error", "books"])

    if "codes" not in vectors.columns:
        vectors = vectors.withColumn("codes", F.lit(bytes(parts)))
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("id", "label")]
    return vectors.select("id", "label", "dim", "v", "codes").mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, dim int, v binary, codes binary, error long, books string")


def moved(vectors: DataFrame, books: Books, parts: int) -> Books:
    """New entries: the componentwise floor of the mean of the parts assigned to each; unused ones stay."""
    shapes = {dim: (len(book[0]), dim) for dim, book in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {dim: np.zeros(shape, np.int64) for dim, shape in shapes.items()}
        count = {dim: np.zeros((shape[0], parts), np.int64) for dim, shape in shapes.items()}
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(batch), parts)
            for dim, at, matrix in _by_size(batch):
                for p, (a, b) in enumerate(cuts(dim, parts)):
                    np.add.at(total[dim][:, a:b], codes[at, p], matrix[:, a:b])
                    count[dim][:, p] += np.bincount(codes[at, p], minlength=shapes[dim][0])
        out = []
        for dim in shapes:
            for p, (a, b) in enumerate(cuts(dim, parts)):
                out += [(dim, p, e, int(count[dim][e, p]), total[dim][e, a:b].tolist()) for e in np.flatnonzero(count[dim][:, p]).tolist()]
        if out:
            dims, ps, es, ns, vs = zip(*out, strict=True)
            yield pa.record_batch([pa.array(dims, pa.int32()), pa.array(ps, pa.int32()), pa.array(es, pa.int32()), pa.array(ns, pa.int64()), pa.array(vs, pa.list_(pa.int64()))],
                                  ["dim", "part", "entry", "n", "total"])

    found = vectors.select("dim", "v", "codes").mapInArrow(run, "dim int, part int, entry int, n long, total array<long>")
    exact = F.sum(F.col("x").cast("decimal(38,0)")).alias("total")  # beyond 64 bits too
    found = found.select("dim", "part", "entry", "n", F.posexplode_outer("total").alias("at", "x")).groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), exact)
    out = {dim: [part.copy() for part in book] for dim, book in books.items()}
    for dim, part, entry, at, n, total in found.collect():  # as many rows as the codebooks have components
        if at is not None:
            out[dim][part][entry, at] = int(total) // n
    return out


def vector_codes(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of every vector without null or non-finite components.

    Vectors of another size have codebooks of their own; a size that ``parts`` does not divide has parts that differ by one component,
    longer ones first; of an empty vector all parts are empty.  Every row counts, repeated ids too; null ids come last among the first
    entries.  Components are held within ``held_at``, sums of errors at the end of 64 bits.  Null labels are one label.
    Other columns are ignored; an empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has to fit a byte")
    vectors = durable(whole_vectors(df, scale, id_col, vector_col, label_col))
    books = first_books(vectors, parts, entries)
    for _ in range(rounds):
        vectors = durable(assigned(vectors, books, parts))
        books = moved(vectors, books, parts)
    coded = durable(assigned(vectors, books, parts).select("id", "label", "codes", "error", "books"))
    exact = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(F.count("*").alias("n_"), exact.alias("label_error"))
    out = looked_up(coded, durable(sums), "label", "n_", ["label_error"])
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.col("books").alias("codebooks_sha256"))
