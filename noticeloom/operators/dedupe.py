"""Possible duplicates across sources: shared reference numbers, blocked similarity, connected groups.  Nothing is merged."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from operator import add

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import normalise_title
from .durable import durable
from .graph import connected_components
from .once import once

SLOT = 6 * 3600
THRESHOLD = 0.88
#: What authority, state and closing time add; all three are needed to reach the threshold.
AUTHORITY, STATE, CLOSING, TITLE = 0.25, 0.15, 0.15, 0.45


def reference_links(df: DataFrame, ref: Column, key: str = "id", source: str = "source") -> DataFrame:
    """(a, b): neighbours, by key, that share a trimmed, upper-cased reference and come from different sources.

    Rows are sorted by ranges of reference and key, so one that many rows have, as a placeholder is, fills several tasks.  A task compares
    neighbours and hands on its first and last row; these, two a task, are compared across the ranges.
    """
    kind = df.schema[key].dataType.simpleString()
    keyed = df.select(F.upper(F.trim(ref)).alias("ref"), F.col(key).alias("k"), F.col(source).cast("string").alias("source")).where("ref <> '' and k is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_number, before = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if before is None else [before, batch]).combine_chunks()
            if before is None:
                yield from edge(rows.slice(0, 1), 2 * range_number)
            ahead, behind = rows.slice(1), rows.slice(0, len(rows) - 1)
            same = pc.equal(ahead["ref"], behind["ref"])
            other = pc.fill_null(pc.not_equal(ahead["source"], behind["source"]), False)
            hits = pc.and_(same, other)
            a, b = behind["k"].filter(hits), ahead["k"].filter(hits)
            if len(a):
                none = pa.nulls(len(a))
                yield from pa.table([none.cast(pa.int32()), none.cast(pa.string()), a, none.cast(pa.string()), b], ["spot", "ref", "k", "source", "b"]).to_batches()
            before = batch.slice(batch.num_rows - 1)
        if before is not None:
            yield from edge(pa.Table.from_batches([before]), 2 * range_number + 1)

    def edge(row: pa.Table, spot: int) -> Iterator[pa.RecordBatch]:
        columns = [pa.array([spot], pa.int32()), row["ref"].cast(pa.string()), row["k"], row["source"].cast(pa.string()), pa.nulls(1).cast(row["k"].type)]
        yield from pa.table(columns, ["spot", "ref", "k", "source", "b"]).to_batches()

    found = durable(keyed.repartitionByRange("ref", "k").sortWithinPartitions("ref", "k").mapInArrow(run, f"spot int, ref string, k {kind}, source string, b {kind}"))
    by = W.partitionBy(F.lit(1)).orderBy("spot")  # two rows a range
    edges = found.where("spot is not null").select("ref", "source", F.col("k").alias("b"), *[F.lag(c).over(by).alias(f"before_{c}") for c in ("ref", "source", "k", "spot")], "spot")
    across = edges.where("spot % 2 = 0 and ref = before_ref and source <> before_source").select(F.col("before_k").alias("a"), "b")
    return found.where("spot is null").select(F.col("k").alias("a"), "b").unionByName(across)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}  # titles repeat
    for x, y in zip(a, b, strict=True):
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x, y).ratio()
    return pd.Series([known[x, y] for x, y in zip(a, b, strict=True)])


def _placed(df: DataFrame, key: str) -> DataFrame:
    """(k, source, authority, state, raw, s) of the rows that can be in a block; ``raw`` is the title as it stands."""
    return df.select(
        F.col(key).alias("k"), "source", F.lower("authority").alias("authority"), "state", F.col("title").alias("raw"), F.unix_seconds(F.col("closing_at").cast("timestamp")).alias("s")
    ).where("authority <> '' and state <> '' and s is not null and raw <> ''")


def _titled(rows: DataFrame) -> DataFrame:
    """Adds the normalised title, made once a row, and the slot."""
    return once(rows, title=normalise_title(F.col("raw"))).where("title <> ''").withColumn("slot", F.floor(F.col("s") / SLOT))


def blocked_pairs(df: DataFrame, key: str = "id") -> DataFrame:
    """(a, b, gap_s, title_a, title_b): pairs of different sources with equal authority and state, closing less than 6 h apart.

    An equi-join on authority, state and slot; each left row looks into its own and the next slot, so no band join is needed.
    """
    rows = _titled(_placed(df, key))
    left = rows.withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1)))
    x, y = left.alias("x"), rows.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("authority", "state", "slot")]
    own = F.floor(F.col("x.s") / SLOT)
    one_way = (F.col("y.slot") > own) | (F.col("x.k") < F.col("y.k"))
    gap = F.abs(F.col("x.s") - F.col("y.s"))
    pairs = x.join(y, on).where((F.col("x.source") != F.col("y.source")) & one_way & (gap < SLOT))
    first = F.col("x.k") < F.col("y.k")
    side = lambda c, flip: F.when(first, F.col(f"{'y' if flip else 'x'}.{c}")).otherwise(F.col(f"{'x' if flip else 'y'}.{c}"))
    return pairs.select(side("k", False).alias("a"), side("k", True).alias("b"), gap.alias("gap_s"), side("title", False).alias("title_a"), side("title", True).alias("title_b"))


#: Characters counted apart by the bound of the ratio; all others are counted together, which only loosens it.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _bag(title: Column) -> list[Column]:
    """How often each of LETTERS is in a title, and how many other characters."""
    counts = [F.length(title) - F.length(F.replace(title, F.lit(c), F.lit(""))) for c in LETTERS]
    return [*counts, F.length(F.translate(title, LETTERS, ""))]


def within_bound(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs whose titles may reach the threshold: the matcher's ratio is at most that of their lengths, and at most that of the characters they
    have in common whatever the order.  Both bounds are native, so most pairs never meet the matcher; the second is made once a pair, after
    the join and the first, and not for every candidate of the join."""
    least = (threshold - AUTHORITY - STATE - CLOSING) / TITLE - 1e-9
    la, lb = F.length("title_a"), F.length("title_b")
    near = pairs.where(2 * F.least(la, lb) >= least * (la + lb))
    common = reduce(add, [F.least(x, y) for x, y in zip(_bag(F.col("title_a")), _bag(F.col("title_b")), strict=True)])
    return once(near, common=common).where(2 * F.col("common") >= least * (la + lb)).drop("common")


def similar_links(pairs: DataFrame, threshold: float = THRESHOLD, more: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, score) of blocked pairs at the threshold, and ``more`` of their columns."""
    score = F.lit(TITLE) * _ratio("title_a", "title_b") + AUTHORITY + STATE + CLOSING
    return within_bound(pairs, threshold).select("a", "b", *more, score.alias("score")).where(F.col("score") >= threshold)


#: What copies have in common: they are compared once, as one class.
COPY = ("authority", "state", "raw", "source", "s")


def similar_forest(df: DataFrame, key: str = "id", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): links out of ``similar_links(blocked_pairs(df))`` that join the same rows into groups, at most two for each row and one or two
    for each pair of classes of copies, where the pairs themselves grow with the square of the copies.

    The ratio depends on which title stands first, that of the smaller key.  Of two classes that are alike in one order the least key of the
    first and the greatest of the second are linked; every other row of a class only needs the least partner before it and the greatest after.
    """
    rows = _placed(df, key).where("k is not null and source is not null")
    classes = durable(_titled(rows.groupBy(*COPY).agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n"))))
    x, y = classes.withColumn("own", F.col("slot")).withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1))).alias("x"), classes.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("authority", "state", "slot")]
    one_way = (F.col("y.slot") > F.col("x.own")) | (F.col("x.least") <= F.col("y.least"))
    side = lambda c: F.struct(*[F.col(f"{c}.{name}") for name in (*COPY, "title", "least", "most", "n")])
    met = x.join(y, on).where((F.col("x.source") != F.col("y.source")) & one_way & (F.abs(F.col("x.s") - F.col("y.s")) < SLOT))
    ways = durable(met.select(F.inline(F.array(F.struct(side("x").alias("p"), side("y").alias("q")), F.struct(side("y").alias("p"), side("x").alias("q"))))).where("p.least < q.most"))
    directed = ways.select("p", "q", F.col("p.least").alias("a"), F.col("q.most").alias("b"), F.col("p.title").alias("title_a"), F.col("q.title").alias("title_b"))
    alike = durable(similar_links(directed, threshold, ("p", "q")))
    after = alike.where("q.n > 1").select("q.*", F.col("a").alias("low"), F.lit(None).cast(alike.schema["b"].dataType).alias("high"))
    before = alike.where("p.n > 1").select("p.*", F.lit(None).cast(alike.schema["a"].dataType).alias("low"), F.col("b").alias("high"))
    bounds = durable(after.unionByName(before).groupBy(*COPY).agg(F.min("low").alias("low"), F.max("high").alias("high")))
    members = rows.join(bounds, list(COPY))
    ends = members.select(F.inline(F.array(F.struct(F.col("low").alias("a"), F.col("k").alias("b")), F.struct(F.col("k").alias("a"), F.col("high").alias("b"))))).where("a < b")
    return alike.select("a", "b").unionByName(ends)


def duplicate_report(reference: DataFrame, similar: DataFrame, exact: int = 0) -> DataFrame:
    """One row of how many unions each phase made: exact ids (counted by the merge), shared references, then similarity over what these left apart.

    A phase makes as many unions as it lowers the number of groups: nodes less components, whatever the order of links.
    """

    def unions(links: DataFrame) -> int:
        found = connected_components(links)
        return found.count() - found.select("root").distinct().count()

    by_reference = unions(reference.select("a", "b"))
    both = unions(reference.select("a", "b").unionByName(similar.select("a", "b")))
    return reference.sparkSession.createDataFrame([(exact, by_reference, both - by_reference)], "exact_source_id int, reference_number int, possible_duplicate_groups int")


def duplicate_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, possible_duplicate_group, members): ``dup:`` and the least id, for every id in a group of two or more."""
    found = connected_components(links, a, b)
    roots = found.groupBy("root").agg(F.min("node").alias("least"), F.count("*").cast("int").alias("members"))
    return found.join(roots, "root").select(F.col("node").alias("id"), F.concat(F.lit("dup:"), F.col("least").cast("string")).alias("possible_duplicate_group"), "members")
