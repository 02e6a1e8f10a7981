"""Predicates and projections over notices.  ``now`` is always an argument."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ist_month_end, seconds_until
from ..functions.text import state_key
from .durable import durable

DAY = 86400


@dataclass(frozen=True)
class Query:
    """What a reader asks for; ``None`` means no such condition."""

    keywords: str = ""
    state: str | None = None
    source: str | None = None
    status: str | None = None
    category: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    include_unknown_value: bool = False
    closing_within_days: int | None = None
    closing_this_month: bool = False
    sort: str | None = None


def effective_status(now: Column, status: str = "status", closing: str = "closing_at") -> Column:
    return F.when((F.col(status) == "active") & (F.col(closing) < now), "closed").otherwise(F.col(status))


def within_retention(now: Column, days: int, closing: str = "closing_at") -> Column:
    """Notices without a closing time stay."""
    return F.col(closing).isNull() | (F.col(closing) >= now - F.make_dt_interval(F.lit(days)))


def closing_within(now: Column, days: int, closing: str = "closing_at") -> Column:
    """Inclusive at both ends; no closing time fails."""
    return F.coalesce(F.col(closing).between(now, now + F.make_dt_interval(F.lit(days))), F.lit(False))


def closing_this_month(now: Column, closing: str = "closing_at") -> Column:
    instant = F.col(closing).cast("timestamp")
    return F.coalesce(instant.between(now.cast("timestamp"), ist_month_end(now)), F.lit(False))


def recently_discovered(now: Column, seen: str = "first_seen_at") -> Column:
    """Seen first between 48 hours ago and one hour ahead."""
    return F.coalesce((-seconds_until(F.col(seen), now)).between(-3600, 48 * 3600), F.lit(False))


def mode_scope(mode: str, now: Column) -> Column:
    return {
        "new": recently_discovered(now),
        "changed": F.col("corrigenda_count") > 0,
        "closing": closing_within(now, 7),
    }.get(mode, F.lit(True))


def structure(query: Query, now: Column) -> Column:
    """All structured conditions but the value rule."""
    keep = F.lit(True)
    if query.state:
        keep = keep & (state_key(F.col("state")) == " ".join(query.state.lower().replace("&", " and ").split()))
    if query.source:
        keep = keep & (F.col("source") == query.source)
    if query.status:
        keep = keep & (F.col("status") == query.status)
    if query.category:
        keep = keep & F.lower(F.coalesce("category", F.lit(""))).contains(query.category.lower())
    if query.closing_within_days is not None:
        keep = keep & closing_within(now, query.closing_within_days)
    if query.closing_this_month:
        keep = keep & closing_this_month(now)
    return keep


def value_verdict(query: Query, value: str = "value") -> Column:
    """``ok``, ``fail`` or ``unknown``: an undisclosed value is neither in the band nor out of it."""
    if query.min_value is None and query.max_value is None:
        return F.lit("ok")
    fits = F.lit(True)
    if query.min_value is not None:
        fits = fits & (F.col(value) >= query.min_value)
    if query.max_value is not None:
        fits = fits & (F.col(value) <= query.max_value)
    hidden = "ok" if query.include_unknown_value else "unknown"
    return F.when(F.col(value).isNull(), hidden).when(fits, "ok").otherwise("fail")


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "title", "authority", "category", "ref", "tender_number", "id"))


def keyword_all(keywords: str, hay: Column | None = None) -> Column:
    hay = haystack() if hay is None else hay
    keep = F.lit(True)
    for term in keywords.lower().split():
        keep = keep & hay.contains(term)
    return keep


def keyword_hits(keywords: str, hay: Column | None = None) -> Column:
    """How many terms of more than one character occur."""
    hay = haystack() if hay is None else hay
    hits = F.lit(0)
    for term in [t for t in keywords.lower().split() if len(t) > 1]:
        hits = hits + hay.contains(term).cast("int")
    return hits


def relaxed(df: DataFrame, keywords: str, hay: Column | None = None) -> DataFrame:
    """Rows with all terms; only if there is none and several terms are asked, rows with any, most hits first by ``hits``.

    The table is read once: rows with any term are written with a flag, and whether one of them has all is asked of these.
    """
    if len([t for t in keywords.split() if len(t) > 1]) < 2:
        return df.where(keyword_all(keywords, hay)).withColumn("hits", keyword_hits(keywords, hay))
    scored = durable(df.withColumn("_all", keyword_all(keywords, hay)).withColumn("hits", keyword_hits(keywords, hay)).where("hits > 0 or _all"))
    strict = not scored.where("_all").isEmpty()
    return (scored.where("_all") if strict else scored).drop("_all")


#: Columns that identify a row to a reader.
EXACT_FIELDS = ("id", "ref", "tender_number")


def exact_match(query: str) -> Column:
    asked = query.strip().lower()
    if len(asked) < 3:
        return F.lit(False)
    found = F.lit(False)
    for column in EXACT_FIELDS:
        found = found | F.coalesce(F.lower(F.trim(F.col(column).cast("string"))) == asked, F.lit(False))
    return found


def ordering(sort: str | None) -> list[Column]:
    """Sort keys; ties always go by id, since a shuffle keeps no order."""
    first = {
        "closing": [F.col("closing_at").asc_nulls_last()],
        "value": [F.col("value").desc_nulls_last()],
        "newest": [F.col("first_seen_at").desc_nulls_last()],
    }.get(sort or "", [])
    return [*first, F.col("id").asc()]


def run_query(df: DataFrame, query: Query, now: Column) -> DataFrame:
    """Scope, keywords (relaxed if nothing has all), structure, value rule; with the count of hidden unknown values in each row."""
    found = relaxed(df.where(structure(query, now)), query.keywords) if query.keywords else df.where(structure(query, now)).withColumn("hits", F.lit(0))
    judged = durable(found.withColumn("verdict", value_verdict(query)).where("verdict in ('ok', 'unknown')"))
    hidden = judged.agg(F.count_if(F.col("verdict") == "unknown").alias("hidden_unknown"))
    return judged.where("verdict = 'ok'").drop("verdict").join(F.broadcast(hidden), how="cross")
