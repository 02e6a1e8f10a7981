"""Source health over run history: baseline anomaly, failure streaks, and the order-dependent status fold.

Histories are cut into stretches of time.  A stretch is summed up by itself - counts, the failures at its end, the function that it is of
the status before it - and only these summaries meet in one group for a source, however long its history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

RECOVERABLE = ("DEGRADED", "TEMPORARILY_BROKEN", "CAPTCHA_LIMITED", "EXPERIMENTAL")
#: The functions of a status besides the constant ones, which are written as the status that they give.
SAME, PROMOTED = "same", "promoted"
#: Runs in a stretch of a history that is numbered instead of dated.
STRETCH = 500


def stretch(runs: DataFrame, at: str) -> Column:
    """The stretch of a run: its month, or so many numbers.  Any cut that keeps the order of runs gives the same results."""
    if isinstance(runs.schema[at].dataType, DateType | TimestampType | TimestampNTZType):
        return F.date_trunc("month", at)
    return F.floor(F.col(at) / STRETCH)


def with_history(runs: DataFrame, source: str = "source", at: str = "run_at", cut: Column | None = None) -> DataFrame:
    """Adds prior_nonzero, consecutive_failures (this run included) and degraded to runs (ok, discovered)."""
    good = F.col("ok") & (F.col("discovered") > 0)
    rows = runs.withColumn("_cut", stretch(runs, at) if cut is None else cut)
    inside = W.partitionBy(source, "_cut").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_good", F.sum(good.cast("int")).over(inside))
    island = W.partitionBy(source, "_cut", "_good").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_failures", F.sum((~good).cast("int")).over(island))
    ends = rows.groupBy(source, "_cut").agg(F.max("_good").alias("_sum"), F.max_by("_failures", at).alias("_trail"))
    before = W.partitionBy(source).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_prior", F.coalesce(F.sum("_sum").over(before), F.lit(0))).withColumn("_run", F.sum(F.when(F.col("_sum") > 0, 1).otherwise(0)).over(W.partitionBy(source).orderBy("_cut").rowsBetween(W.unboundedPreceding, 0)))
    # failures that reach over a cut: those at the ends of the stretches since the last one with a good run
    carried = F.sum("_trail").over(W.partitionBy(source, "_run").orderBy("_cut").rowsBetween(W.unboundedPreceding, 0))
    ends = ends.withColumn("_carried", carried).withColumn("_carry", F.coalesce(F.lag("_carried").over(W.partitionBy(source).orderBy("_cut")), F.lit(0)))
    ends = ends.select(F.col(source).alias("_source"), F.col("_cut").alias("_end_cut"), "_prior", "_carry")
    rows = rows.join(ends, (F.col(source) == F.col("_source")) & (F.col("_cut") == F.col("_end_cut")))
    failures = F.when(F.col("_good") > 0, F.col("_failures")).otherwise(F.col("_carry") + F.col("_failures"))
    rows = rows.select(*runs.columns, (F.col("_prior") + F.col("_good") - good.cast("int")).cast("int").alias("prior_nonzero"), failures.cast("int").alias("consecutive_failures"))
    silent = F.col("ok") & (F.col("discovered") == 0) & (F.col("prior_nonzero") >= 3)
    return rows.withColumn("degraded", silent | (~F.col("ok") & (F.col("consecutive_failures") >= 2)))


def status_function(ok: Column, discovered: Column, degraded: Column, captcha: Column) -> Column:
    """What a run does to the status before it."""
    return F.when(captcha, "CAPTCHA_LIMITED").when(degraded, "DEGRADED").when(ok & (discovered > 0), PROMOTED).when(ok, SAME).otherwise("TEMPORARILY_BROKEN")


def applied(function: Column, status: Column) -> Column:
    promoted = F.when(status.isNull() | status.isin(*RECOVERABLE), "ACTIVE").otherwise(status)
    return F.when(function == SAME, status).when(function == PROMOTED, promoted).otherwise(function)


def after(first: Column, then: Column) -> Column:
    """The function that does ``first`` and ``then``; grouping does not matter, so parts of a history can be folded anywhere."""
    over = F.when(first.isin(SAME, PROMOTED), PROMOTED).otherwise(applied(F.lit(PROMOTED), first))
    return F.when(then == SAME, first).when(then == PROMOTED, over).otherwise(then)


def status_fold(history: DataFrame, source: str = "source", at: str = "run_at", initial: str = "EXPERIMENTAL", cut: Column | None = None) -> DataFrame:
    """(source, status, runs): the status after the last run, from one function for each stretch of a source's history."""
    runs = history.select(source, F.col(at).alias("at"), (stretch(history, at) if cut is None else cut).alias("_cut"), status_function(F.col("ok"), F.col("discovered"), F.col("degraded"), F.col("captcha")).alias("step"))
    folded = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("at", "step"))), lambda r: r["step"]), F.lit(SAME), after)
    parts = runs.groupBy(source, "_cut").agg(folded.alias("step"), F.count("*").alias("runs"))
    whole = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("_cut", "step"))), lambda r: r["step"]), F.lit(SAME), after)
    sources = parts.groupBy(source).agg(whole.alias("step"), F.sum("runs").cast("int").alias("runs"))
    return sources.select(source, applied(F.col("step"), F.lit(initial)).alias("status"), "runs")


def stale_sources(health: DataFrame, now: Column, days: int) -> Column:
    return F.col("last_success").isNull() | (F.col("last_success") < now - F.make_dt_interval(F.lit(days)))
