"""Folds by ``crc32`` of an id as text, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str | Column, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; a null id has none (null)."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def training_rows(labels: DataFrame, label: str, keep: Column, limits: dict[int, int], id_col: str = "doc_id") -> DataFrame:
    """At most ``limits[y]`` labelled ids per class ``y``, chosen by hash; ``(doc_id, y)``, one row per id.

    Rows with a null id or label are left out.  Conflicting labels of one id count as the greater.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(*limits) & keep)
    rows = rows.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    picked = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in limits.items()]
    out = picked[0]
    for more in picked[1:]:
        out = out.unionByName(more)
    return out


def labelled_texts(docs: DataFrame, rows: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, y, text)`` of the sampled rows, one for each id; the sample is bounded, so it is broadcast.

    Of documents that repeat an id the least text counts, so repeated ids do not widen the sample.  A null text is empty.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
