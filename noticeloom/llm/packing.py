"""Packing documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A document longer than a sequence is cut into whole sequences, preceded by the rest; so one shorter piece of each document
has to be placed; whole sequences are never grouped.  Shorter pieces are dealt evenly into groups of a few thousand, whatever
their number, and every group is packed by itself: larger pieces first, each where the sum, over the gaps, of the squared number of open sequences with
that gap becomes smallest (Csirik et al., 2006).  A group wastes at most a few sequences of some thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from .urlrules import fresh_names

CAPACITY = 2048
GROUP = 4000
#: Characters below this are classified alike by both tokenizer libraries; other texts take the slower one.
_PLAIN = 0x250


@lru_cache(maxsize=2)
def _encoder(tokenizer_path: str):
    """``texts -> list of uint32 arrays``, the ids of ``tokenizers`` without special tokens added.

    The file's byte-level BPE is run by ``tiktoken`` on the same vocabulary, four times as fast with equal ids, for texts of
    Latin characters without the special token's string; all other texts go through ``tokenizers`` itself.
    """
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = {**{i: i for r in (range(33, 127), range(161, 173), range(174, 256)) for i in r}}
    extra = iter(range(256, 512))
    to_byte = {chr(plain[i] if i in plain else next(extra)): i for i in range(256)}
    specials = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("|".join([f"[^\\x00-\\x1b\\x20-\\x84\\x86-{chr(_PLAIN - 1)}]", *map(re.escape, specials)]))

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if odd.search(text) is None:
                out.append(fast.encode_to_numpy(text))
            else:
                out.append(np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32))
        return out

    return encode


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids)`` per piece: ids are little-endian unsigned 32-bit, as binary.

    A document is its text's ids (none for an empty or null text), then ``end_id``.  Repeated rows are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, piece, start, length, ids = [], [], [], [], []
                for row, tokens in enumerate(encode([t or "" for t in part.column("t").to_pylist()])):
                    tokens = np.append(tokens, end_id).astype("<u4")
                    first = len(tokens) % capacity or capacity
                    cuts = [0, *range(first, len(tokens) + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        owner.append(row)
                        piece.append(k)
                        start.append(cuts[k])
                        length.append(cuts[k + 1] - cuts[k])
                        ids.append(tokens[cuts[k] : cuts[k + 1]].tobytes())
                names = ["doc_id", "piece", "start", "length", "ids"]
                yield pa.record_batch(
                    [part.column("id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names,
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the order given; a new bin is opened only where nothing open fits."""
    gaps = np.zeros(capacity + 1, np.int64)  # open bins with that gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of, offset_of, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        if size == capacity:
            bin_of[i], offset_of[i] = opened, 0
            opened += 1
            continue
        # the change of the sum of squares, halved and without constants, for a bin with gap size..capacity-1
        change = -gaps[size:capacity].astype(np.float64)
        change[1:] += gaps[1 : capacity - size] + 1
        change[gaps[size:capacity] == 0] = np.inf
        best = int(np.argmin(change)) if len(change) else 0
        if not len(change) or change[best] == np.inf:
            bin_of[i], offset_of[i], gap = opened, 0, capacity - size
            where = opened
            opened += 1
        else:
            gap = size + best
            where = bins[gap].pop()
            gaps[gap] -= 1
            bin_of[i], offset_of[i] = where, capacity - gap
            gap -= size
        if gap:
            gaps[gap] += 1
            bins[gap].append(where)
    return bin_of, offset_of


def pack(pieces: DataFrame, n_groups: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` (1 to ``capacity``); all other columns are kept.

    Whole pieces are sequences as they are.  Shorter ones are dealt round robin inside each input partition, so that no key, not
    even a null one, makes a group large; ``n_groups`` follows from their number unless it is given.  Existing columns named
    ``sequence_id`` or ``offset``, in any case, are replaced.
    """
    pieces = pieces.select(*(F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")))
    columns = pieces.columns
    short = pieces.where(F.col("length") < capacity)
    if n_groups is None:
        n_groups = groups_for(short.count())
    (name,) = fresh_names(pieces, "packing_group")
    dealt = short.withColumn(name, F.pmod(F.monotonically_increasing_id() + F.spark_partition_id() * 7919, F.lit(max(1, n_groups))).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("length", ascending=False, kind="stable")
        where, offset = sum_of_squares(frame["length"].to_numpy(), capacity)
        group = int(frame[name].iloc[0])
        return frame[columns].assign(sequence_id=where + (group << 32), offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = dealt.groupBy(name).applyInPandas(run, f"{schema}, sequence_id long, offset long")
    whole = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)


def groups_for(n_pieces: int, group: int = GROUP) -> int:
    return max(1, round(n_pieces / group))


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All of ``docs`` packed: the columns of :func:`token_pieces` (with ids) and those of :func:`pack`."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    columns = pieces.columns
    pieces = durable(pieces.withColumn("piece_number", F.monotonically_increasing_id()))  # document ids may repeat or be null
    packed = pack(pieces.drop("ids"), capacity=capacity)
    return packed.join(pieces.select("piece_number", "ids"), "piece_number").select(*columns, "sequence_id", "offset")
