"""Joins of notices with details, bookmarks, artifacts and declared sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def detail_overlay(docs: DataFrame, details: DataFrame, present: dict[str, str], key: str = "id") -> DataFrame:
    """Fills only fields that a notice does not have: ``present`` maps a field to the flag that says it is there, null or not."""
    d = details.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in present])
    joined = docs.join(d, F.col(key) == F.col("_k"), "left")
    filled = {f: F.when(F.col(flag), F.col(f)).otherwise(F.col(f"_{f}")) for f, flag in present.items()}
    return joined.withColumns(filled).drop("_k", *[f"_{f}" for f in present])


def bookmarked(docs: DataFrame, bookmarks: DataFrame, key: str = "id") -> DataFrame:
    """Saved notices, latest saved first."""
    return docs.join(bookmarks, key).orderBy(F.desc("saved_at"), key)


def artifacts(docs: DataFrame, found: DataFrame, tasks: tuple[str, ...], key: str = "id") -> DataFrame:
    """A column for each task's artifact; eligibility falls back to the summary."""
    wide = found.groupBy(key).agg(*[F.max(F.when(F.col("task") == t, F.col("body"))).alias(t) for t in tasks])
    out = docs.join(wide, key, "left")
    return out.withColumn("eligibility", F.coalesce("eligibility", "summary")) if {"eligibility", "summary"} <= set(tasks) else out


def declared_health(declared: DataFrame, health: DataFrame) -> DataFrame:
    return declared.join(health, "source", "left").withColumn("status", F.coalesce("status", F.lit("PENDING")))


def merge_saved(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Saved searches of both sides: one for each id, then one for each name and query; the first side wins."""
    both = mine.withColumn("_side", F.lit(0)).unionByName(theirs.withColumn("_side", F.lit(1)))
    for keys in (["id"], ["name", "query"]):
        both = both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_side", "id"))).where("_n = 1").drop("_n")
    return both.drop("_side")


def merge_bookmarks(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """The newer bookmark of each notice."""
    return mine.unionByName(theirs).groupBy("id").agg(F.max_by("status", "saved_at").alias("status"), F.max("saved_at").alias("saved_at"))
