"""A look-up join whose rows may be very uneven among the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as hot if it holds more than this share of all rows, so there are at most 1000 of them and they can be broadcast.
HOT_SHARE = 0.001


def looked_up(rows: DataFrame, table: DataFrame, key: str, rows_col: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the row of ``table`` whose ``key`` is equal (nulls are equal), or nulls.

    ``table`` has one row a key; ``rows_col`` says how many of ``rows`` have it.  Hot keys meet their rows where these are, by a
    broadcast of at most ``1 / HOT_SHARE`` table rows; all others are joined by shuffle.
    """
    total = rows.count()
    hot = table.where(F.col(rows_col) > F.lit(total * HOT_SHARE))

    def marked(of: DataFrame, mark: str) -> DataFrame:
        return of.select(F.col(key).alias(f"{mark}key_"), *(F.col(c).alias(f"{mark}{c}") for c in columns), F.lit(True).alias(mark))

    own = rows.columns
    met = rows.join(F.broadcast(marked(hot, "hot_")), F.col(key).eqNullSafe(F.col("hot_key_")), "left")
    done = met.where(F.col("hot_")).select(*own, *(F.col(f"hot_{c}").alias(c) for c in columns))
    rest = met.where(F.col("hot_").isNull()).select(*own)
    cold = marked(table.where(F.col(rows_col) <= F.lit(total * HOT_SHARE)), "cold_")
    joined = rest.join(cold, F.col(key).eqNullSafe(F.col("cold_key_")), "left").select(*own, *(F.col(f"cold_{c}").alias(c) for c in columns))
    return done.unionByName(joined)
