"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may be hidden in a text with up to ``k`` edits.  It is cut into ``k + 1`` pieces, one of
which must then occur unchanged.  All pieces of all items are searched at once by an Aho-Corasick automaton; around every
hit, Myers' bit-parallel algorithm finds the least edit distance of the item to a part of the text; where a text has many such
hits, as pieces of templated items give, they are verified in one numpy pass over blocks of 64 characters.
Texts and items are compared in lower case with white space squeezed to single blanks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import ClassVar

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.durable import durable

EDIT_SHARE = 0.08
#: Items are sent to the tasks in portions of at most so many characters; more of them mean more passes over the texts.
PORTION_CHARS = 1_000_000
#: From so many items of one text on, they are verified together, up to the second number at once.
MANY, TOGETHER = 6, 2048
#: Letter tables that a worker keeps.
KEPT_TABLES = 5_000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, share: float) -> int:
    return int(len(item) * share)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` non-empty pieces (fewer for a shorter item) and their places."""
    parts = min(k + 1, len(item))
    cuts = [i * len(item) // parts for i in range(parts + 1)]
    return [(cuts[i], item[cuts[i] : cuts[i + 1]]) for i in range(parts)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and the end of the first such part."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (full & ~(d | up))
        minus = up & d
        if score < best:
            best, end = score, j + 1
    return best, end


def letter_table(pattern: str, letters: dict[str, int]) -> np.ndarray:
    """For each block of 64 characters of the pattern and each letter, the places that have it; letter 0 is in no pattern."""
    table = np.zeros((-(-len(pattern) // 64), len(letters) + 1), np.uint64)
    place = np.arange(len(pattern))
    np.bitwise_or.at(table, (place // 64, [letters[c] for c in pattern]), np.uint64(1) << (place % 64).astype(np.uint64))
    return table


def myers_many(tables: list[np.ndarray], size: np.ndarray, code: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """``myers`` of many patterns (tables and sizes) and windows (a column of letters each, and its length) at once.

    A pattern is a column of blocks of 64 characters, taken block after block: a block takes the differences that leave the block above it at
    every character of the window and hands its own on.
    """
    n, one = len(tables), np.uint64(1)
    rows, best, end = np.arange(n), size.copy(), np.zeros(n, np.int64)
    enters = np.zeros(code.shape, np.int8)  # a match may begin anywhere: nothing enters the first block
    for block in range(int(-(-size.max(initial=1) // 64))):
        equal = np.stack([t[min(block, len(t) - 1)] for t in tables])
        last = (size - 1) // 64 == block
        high = np.where(last, (size - 1) % 64, 63).astype(np.uint64)
        plus, minus = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(n, np.uint64)
        for j in range(len(code)):
            eq, enter = equal[rows, code[j]], enters[j]
            down_in, up_in = (enter < 0).astype(np.uint64), (enter > 0).astype(np.uint64)
            vertical = eq | minus
            eq = eq | down_in
            diagonal = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(diagonal | plus), plus & diagonal
            leaves = ((up >> high) & one).astype(np.int8) - ((down >> high) & one).astype(np.int8)
            enters[j] = leaves
            up, down = up << one | up_in, down << one | down_in
            plus, minus = down | ~(vertical | up), up & vertical
        if last.any():  # below lies the score of a match that ends at each character
            run = size[last] + np.cumsum(enters[:, last].astype(np.int64), axis=0)
            run[np.arange(len(code))[:, None] >= length[last]] = np.iinfo(np.int64).max
            if len(code):
                at = run.argmin(axis=0)
                least = run[at, np.arange(run.shape[1])]
                better = least < size[last]
                where = np.flatnonzero(last)[better]
                best[where], end[where] = least[better], at[better] + 1
    return list(zip(best.tolist(), end.tolist(), strict=True))


class Items:
    """Benchmark items ``(id, plain text)`` and the automaton of their pieces, built once in a worker."""

    _built: ClassVar[dict[str, ahocorasick.Automaton]] = {}

    def __init__(self, items: tuple[tuple[int, str], ...], share: float):
        self.items, self.share, self.name = items, share, uuid.uuid4().hex
        self.budgets = [budget(item, share) for _, item in items]
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for _, item in items for c in item}))}
        self.tables: dict[int, np.ndarray] = {}

    def distances(self, text: str, asked: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Least edits, and where they end, of items ``n`` in ``text[low:high]``, all in one pass."""
        for n, _, _ in asked:
            if n not in self.tables:
                if len(self.tables) >= KEPT_TABLES:
                    self.tables.clear()
                self.tables[n] = letter_table(self.items[n][1], self.letters)
        own = [self.tables.get(n) if n in self.tables else letter_table(self.items[n][1], self.letters) for n, _, _ in asked]
        first, last = min(low for _, low, _ in asked), max(high for _, _, high in asked)
        part = np.fromiter((self.letters.get(c, 0) for c in text[first:last] + "\0"), np.intp)
        low = np.array([x for _, x, _ in asked]) - first
        length = np.minimum([x for _, _, x in asked], min(last, len(text))) - first - low
        code = part[np.minimum(low + np.arange(int(length.max(initial=0)))[:, None], len(part) - 1)]
        return myers_many(own, np.array([len(self.items[n][1]) for n, _, _ in asked]), code, length)

    def automaton(self) -> ahocorasick.Automaton:
        found = self._built.get(self.name)
        if found is None:
            uses: dict[str, list[tuple[int, int]]] = {}
            for n, (_, item) in enumerate(self.items):
                for at, piece in pieces(item, self.budgets[n]):
                    uses.setdefault(piece, []).append((n, at))
            found = ahocorasick.Automaton()
            for piece, where in uses.items():
                found.add_word(piece, (len(piece), where))
            found.make_automaton()
            self._built.clear()  # one portion at a time
            self._built[self.name] = found
        return found


def matches(text: str, known: Items) -> dict[int, tuple[int, int]]:
    """``item number -> (edits, end)`` of the best match of every item that occurs within its error budget."""
    best: dict[int, tuple[int, int]] = {}
    tried: dict[int, list[int]] = {}
    text, items = plain(text), known.items
    asked: list[tuple[int, int, int]] = []

    def verify() -> None:
        if len(asked) >= MANY:
            found = known.distances(text, asked)
        else:
            found = [myers(items[n][1], text[low:high]) for n, low, high in asked]
        for (n, low, _), (edits, end) in zip(asked, found, strict=True):
            if edits <= known.budgets[n] and (n not in best or edits < best[n][0]):
                best[n] = (edits, low + end)
        asked.clear()

    for last, (size, uses) in known.automaton().iter(text) if items else ():
        for n, at in uses:
            start = last + 1 - size - at
            if n in best and best[n][0] == 0:
                continue
            before = tried.setdefault(n, [])
            if before and any(abs(start - x) <= known.budgets[n] // 2 for x in before[-4:]):
                continue  # the window tried reaches k further on either side than an alignment needs
            before.append(start)
            if start >= 0 and text.startswith(items[n][1], start):
                best[n] = (0, start + len(items[n][1]))
                continue
            asked.append((n, max(0, start - 2 * known.budgets[n]), start + len(items[n][1]) + 2 * known.budgets[n]))
            if len(asked) >= TOGETHER:
                verify()
    verify()
    return best


def _portions(benchmark: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """(id, plain text) in portions of about PORTION_CHARS, of which the driver holds one at a time.

    Items without an id or without text match nothing and are left out; repeated items count once.
    """
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // PORTION_CHARS))
    for i in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows
        items = sorted({(r[0], plain(r[1])) for r in own.collect()})
        if items := tuple(x for x in items if x[1]):
            yield items


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, edits, n_chars, end_at)``: every document that holds an item within ``int(share * length)`` edits.

    ``n_chars`` is the item's length, ``end_at`` where its best match ends, both in the squeezed text.  Empty and null texts
    hold nothing; repeated rows are reported each; an empty benchmark gives no rows.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, edits int, n_chars int, end_at int"
    found: DataFrame | None = None
    for items in _portions(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items, known=Items(items, share)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, out = [], []
                for row, text in enumerate(batch.column("t").to_pylist()):
                    for n, (edits, end) in sorted(matches(text, known).items()) if text else ():
                        rows.append(row)
                        out.append((items[n][0], edits, len(items[n][1]), end))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.record_batch(
                        [batch.column("id").take(pa.array(rows)), pa.array(columns[0], kind), *(pa.array(c, pa.int32()) for c in columns[1:])],
                        ["doc_id", "item_id", "edits", "n_chars", "end_at"],
                    )

        hits = texts.mapInArrow(run, schema)
        found = hits if found is None else durable(found).unionByName(hits)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """The rows whose text holds no item of ``benchmark`` within the error budget; all columns are kept."""

    def holds(known: Items) -> Column:
        @F.arrow_udf("boolean")
        def hit(column: pa.Array) -> pa.Array:
            return pa.array([bool(t) and bool(matches(t, known)) for t in column.to_pylist()], pa.bool_())

        return hit(F.col(text_col))

    for i, items in enumerate(_portions(benchmark)):
        docs = (durable(docs) if i else docs).where(~holds(Items(items, share)))
    return docs
