"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, components.

Plan, for ``n`` documents:

1. One pass over the texts gives each document its set size, a 128-bit fingerprint of its set, the band keys and a
   byte per signature position.  The texts themselves are never shuffled here.
2. Documents with equal sets form one class; everything later works on classes, so exact copies cost nothing more.
3. Classes that share a band key form a bucket.  All pairs of a bucket are never listed.  Each class is first paired with
   the least class of its buckets only; pairs whose signatures agree enough are verified on full sets, and linked
   classes become components.
4. Only buckets that still hold several components are looked at again, and only pairs between components count.  Two
   rounds take each class's best partner by signature; a last round takes every remaining pair, so that no link is
   lost.  Buckets are dealt out in blocks: all members go to one block each, those outside the largest component meet
   every block.  In the last round the pairs of large buckets are not listed; their blocks carry the full sets and
   yield links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..operators.graph import connected_components
from .superminhash import band_keys, signatures
from .wordhash import Words, mix, raw_strings, shingle_sets, slices

POSITIONS, ROWS = 112, 4
#: Least share of equal signature positions for a verification.  The measurement is a test: of thousands of pairs with a
#: similarity of exactly 0.8 and unions of 10 to 1,000, none agreed in less than 0.66 of the positions.
AGREE = 0.60
BLOCK = 512
#: In the last round, pairs are listed in buckets of at most so many classes; larger ones are verified block by block.
LISTED = 64
#: Up to so many document ids are broadcast to find the texts to verify; beyond, the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _fingerprints(sets: np.ndarray, ptr: np.ndarray) -> list[bytes]:
    n, size = len(ptr) - 1, np.diff(ptr).astype(np.uint64)
    out = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        out[some, 0] = mix(np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), ptr[some]) + size[some])
        out[some, 1] = mix(np.add.reduceat(mix(sets + np.uint64(0x632BE59BD9B4E019)), ptr[some]) ^ size[some])
    flat = out.astype("<u8").tobytes()
    return [flat[16 * i : 16 * i + 16] for i in range(n)]


def _sets_of(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = raw_strings(batch.column(column))
    for first, last in slices(offsets):
        words = Words(data[offsets[first] : offsets[last]], offsets[first : last + 1])
        yield first, last, *shingle_sets(words, width)


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, cls (fingerprint), bands array<long>, sig binary.  Rows keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets, ptr in _sets_of(batch, "t", width):
                sig = signatures(sets, ptr, POSITIONS)
                keys = band_keys(sig, ROWS).astype(np.int64)
                small = (mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()
                yield pa.record_batch(
                    [
                        batch.column("id").slice(first, last - first),
                        pa.array(np.diff(ptr), pa.int64()),
                        pa.array(_fingerprints(sets, ptr), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel())),
                        pa.array([small[i * POSITIONS : (i + 1) * POSITIONS] for i in range(last - first)], pa.binary()),
                    ],
                    ["id", "n_shingles", "cls", "bands", "sig"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {id_type}, n_shingles long, cls binary, bands array<long>, sig binary"
    )


def _class_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(cls, shingles)`` of the classes in ``wanted`` (cls, rep), from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets, ptr in _sets_of(batch, "t", width):
                flat = sets.astype("<u8").tobytes()
                rows = [flat[8 * ptr[i] : 8 * ptr[i + 1]] for i in range(last - first)]
                yield pa.record_batch([pa.array(_fingerprints(sets, ptr), pa.binary()), pa.array(rows, pa.binary())], ["cls", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    ids = wanted.select("rep").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = texts.join(ids, texts["id"].eqNullSafe(ids["rep"]), "left_semi").select("t")
    found = texts.mapInArrow(run, "cls binary, shingles binary")
    return found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sig_a", "sig_b"))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= AGREE)).select(["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b, linked)`` of distinct pairs: den * intersection >= num * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                if not len(x) or den * len(x) < num * len(y):
                    linked.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return durable(pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary, linked boolean"))


def _block_pairs(block: pa.Table, every: bool) -> list[tuple[bytes, bytes]]:
    """A block's candidates: each guest's best partner in another component, or every agreeing one."""
    guest = np.array(block.column("guest").to_pylist(), bool)
    comps, names = (np.array(block.column(c).to_pylist(), object) for c in ("comp", "cls"))
    sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint8).reshape(-1, POSITIONS)
    hosts = np.flatnonzero(~guest)
    host_sig, host_comp = sig[hosts], comps[hosts]
    found = []
    for at in np.flatnonzero(guest) if len(hosts) else ():
        share = (host_sig == sig[at]).mean(axis=1)
        share[host_comp == comps[at]] = 0
        hits = np.flatnonzero(share >= AGREE)
        if not every and len(hits):
            hits = hits[[np.argmax(share[hits])]]
        found += [(min(names[at], other), max(names[at], other)) for other in names[hosts[hits]]]
    return found


def _block_links(block: pa.Table, num: int, den: int) -> list[tuple[bytes, bytes]]:
    """One verified link of each guest to every other component in its block, if there is any; rows carry full sets."""
    guest = np.array(block.column("guest").to_pylist(), bool)
    comps, names = (np.array(block.column(c).to_pylist(), object) for c in ("comp", "cls"))
    sets = [np.frombuffer(x, "<u8") for x in block.column("shingles").to_pylist()]
    hosts = np.flatnonzero(~guest)
    if guest.all() or not guest.any():
        return []
    size = np.array([len(sets[i]) for i in hosts])
    value, owner = np.concatenate([sets[i] for i in hosts]), np.repeat(np.arange(len(hosts)), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    host_comp, found = comps[hosts], []
    for at in np.flatnonzero(guest):
        own = sets[at]
        first, last = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
        runs = last - first
        index = np.repeat(first - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        both = np.bincount(owner[index], minlength=len(hosts))
        linked = np.flatnonzero((den * both >= num * (size + len(own) - both)) & (host_comp != comps[at]))
        seen = set()
        for host in linked:
            if host_comp[host] not in seen:
                seen.add(host_comp[host])
                found.append((min(names[at], names[hosts[host]]), max(names[at], names[hosts[host]])))
    return found


def _blockwise(dealt: DataFrame, of_block) -> DataFrame:
    """Distinct (a, b) of ``of_block`` over all blocks (key, i, j); a block has at most about two BLOCKs of rows."""

    def walk(table: pa.Table, last: bool):
        table = table.combine_chunks()
        marks = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), len(table)]
        found = []
        for first, end in zip(bounds[:-1] if last else bounds[:-2], bounds[1:] if last else bounds[1:-1], strict=True):
            if end - first > 1:
                found += of_block(table.slice(first, end - first))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        return table.slice(bounds[-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last block so far; it may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = yield from walk(table if held is None else pa.concat_tables([held, table]), last=False)
        if held is not None and len(held):
            yield from walk(held, last=True)

    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _dealt(members: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, dealt into blocks; members: (key, cls, comp, sig).

    Members of all components are hosts of one block each; those outside the bucket's largest component are also guests and
    meet all hosts.  Adds guest, i (host block), j (guest block) and n (the bucket's size).
    """
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    totals = counts.groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")
    )
    totals = durable(
        totals.where("comps > 1").select(
            "key",
            "n",
            F.col("main.comp").alias("main"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
            F.greatest(F.ceil((F.col("n") - F.col("main.n")) / BLOCK), F.lit(1)).cast("int").alias("guest_blocks"),
        )
    )
    rows = members.join(totals, "key").withColumn("h", F.xxhash64("cls"))
    columns = ["key", "n", "cls", "comp", "sig"]
    hosts = rows.select(*columns, F.lit(False).alias("guest"), F.pmod("h", "blocks").cast("int").alias("i"),
                        F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)).alias("j"))
    guests = rows.where("comp != main").select(*columns, F.lit(True).alias("guest"),
                        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.shiftright("h", 20), "guest_blocks").cast("int").alias("j"))
    return hosts.unionByName(guests)


def near_duplicates(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable over links), kept.

    Two documents are linked if ``den * |A & B| >= num * |A | B|`` for their sets of distinct ``width``-word shingles;
    a shorter text has its whole word sequence as one shingle.  Texts without words, empty and null texts are linked
    with nothing.  Repeated rows are copies of each other.  A null id takes part like any other and loses every minimum;
    a component of null ids only has a null component_id.  Other columns are ignored; an empty table gives none.
    """
    sketched = durable(sketch(docs, width, id_col, text_col))
    full = sketched.where("n_shingles > 0")
    classes = durable(full.groupBy("cls").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count("*").alias("copies")))
    banded = classes.select(F.explode("bands").alias("key"), "cls")
    buckets = durable(banded.groupBy("key").agg(F.min("cls").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    members = durable(banded.join(buckets, "key").select("key", "cls", "lead"))
    near = durable(members.select("cls").distinct().join(classes.select("cls", "rep", "sig"), "cls"))
    sig = near.select("cls", "sig")

    star = members.where("cls != lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    star = star.join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a")), "a")
    star = _agreeing(star.join(sig.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b")), "b"))
    sets = durable(_class_sets(docs, near, width, id_col, text_col))
    checked = _verified(star, sets, num, den)
    linked = checked.where("linked").select("a", "b")
    for last in (False, False, True):
        roots = connected_components(linked)
        owned = near.select("cls", "sig").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        owned = durable(owned.select("cls", "sig", F.coalesce("root", "cls").alias("comp")))
        dealt = _dealt(members.select("key", "cls").join(owned, "cls"))
        if last:
            dealt = durable(dealt)
            large = dealt.where(F.col("n") > LISTED).join(sets, "cls")
            linked = linked.unionByName(durable(_blockwise(large, lambda block: _block_links(block, num, den))))
            dealt = dealt.where(F.col("n") <= LISTED)
        pairs = _blockwise(dealt, lambda block, last=last: _block_pairs(block, last))
        fresh = durable(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            more = _verified(fresh, sets, num, den)
            checked = checked.unionByName(more)
            linked = linked.unionByName(more.where("linked").select("a", "b"))
    roots = connected_components(linked)
    several = classes.select("cls", "rep", "copies").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    several = durable(several.where("root is not null or copies > 1").select("cls", "rep", F.coalesce("root", "cls").alias("root")))
    least = durable(several.groupBy("root").agg(F.min("rep").alias("component")))
    final = durable(several.join(least, "root").select("cls", "component"))
    out = sketched.select("id", "n_shingles", "cls").join(final, "cls", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
