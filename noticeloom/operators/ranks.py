"""Places in an order over all rows, without a window that holds a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import durable


def with_places(df: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """``keep`` and ``place``, from 1, of every row among those that are equal in ``by``.

    Rows are sorted by ranges of ``by`` and ``order``.  A place is the row's number in its range, less that of the first row of its group
    there, after the group's rows in the ranges before.  Those are one row for each range and group that meet.
    """
    keys = [F.col(b).asc_nulls_first() for b in by]
    number = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ordered = ordered.select(F.shiftright(number, 33).alias("range_"), number.bitwiseAND((1 << 33) - 1).alias("within_"), *dict.fromkeys([*by, *keep]))
    ordered = durable(ordered)  # ranges are drawn from a sample: the counts and the rows have to be of one run
    met = ordered.groupBy("range_", *by).agg(F.min("within_").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.partitionBy(*by or [F.lit(1)]).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = met.select(F.col("range_").alias("met_range_"), *(F.col(b).alias(f"met_{b}_") for b in by), "first_", before.alias("before_"))
    same = F.col("range_") == F.col("met_range_")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"met_{b}_"))
    place = (F.col("before_") + F.col("within_") - F.col("first_") + 1).cast("int").alias("place")
    return ordered.join(met, same).select(*dict.fromkeys([*by, *keep]), place)
