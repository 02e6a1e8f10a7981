"""Sharding by a permutation-filled lookup table (Maglev hashing, Eisenbud et al., 2016), in DataFrame functions only.

Every shard has its own preference order of the ``size`` slots (``size`` is prime): ``(offset + i * skip) mod size``.  The
shards take turns; at its turn a shard claims its first preferred slot that is still free.  The finished table is
broadcast - its size is the parameter ``size``, whatever the data - and places a key by one hash and one look-up.
Taking a shard away moves few keys of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 1613


def _number(text: Column, salt: str) -> Column:
    """60 bits of md5 as a long; the same in any SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text).cast("binary")), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """``(slot, shard)`` for all slots.  ``size`` must be prime and above the number of shards; names must differ."""
    if not shards or len(set(shards)) != len(shards) or size <= len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("distinct shards and a larger prime table size are needed")
    names = F.array(*[F.lit(s) for s in shards])
    n = len(shards)
    prefs = F.transform(
        names,
        lambda s: F.struct((_number(s, "offset:") % size).alias("offset"), (_number(s, "skip:") % (size - 1) + 1).alias("skip")),
    )
    row = spark.range(1).select(names.alias("names"))

    def claim(state: Column, turn: Column) -> Column:
        """state: the orders, the owner of each slot (-1: free) and, per shard, how far down its order it is."""
        who = F.pmod(turn, F.lit(n)).cast("int")
        order = F.get(state["p"], who)
        at = lambda i: F.pmod(order["offset"] + i * order["skip"], F.lit(size)).cast("int")
        ahead = F.sequence(F.get(state["next"], who), F.lit(size - 1))
        put = lambda a, i, v: F.concat(F.slice(a, 1, i), F.array(v), F.slice(a, i + 2, F.size(a)))
        step = F.filter(ahead, lambda i: F.get(state["owner"], at(i.cast("long"))) == -1)
        # an array of one element binds the step found, so that it is searched only once
        after = F.transform(
            F.slice(step, 1, 1),
            lambda i: F.struct(
                state["p"].alias("p"),
                put(state["owner"], at(i.cast("long")), who).alias("owner"), put(state["next"], who, i + 1).alias("next")
            ),
        )
        return F.get(after, F.lit(0))

    start = F.struct(prefs.alias("p"), F.array_repeat(F.lit(-1), size).alias("owner"), F.array_repeat(F.lit(0), n).alias("next"))
    filled = row.select("names", F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, claim)["owner"].alias("owner"))
    return filled.select(F.posexplode("owner").alias("slot", "who"), "names").select("slot", F.get("names", F.col("who")).alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row; equal keys go to one shard, a null key counts as the empty text.

    Nothing is shuffled: the table of ``size`` rows is broadcast.  Existing columns of these names, in any case, are replaced.
    """
    table = lookup_table(df.sparkSession, shards, size)
    slot = (_number(F.coalesce(F.col(key).cast("string"), F.lit("")), "key:") % size).cast("int")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return df.select(slot.alias("slot"), *kept).join(F.broadcast(table), "slot", "left")
