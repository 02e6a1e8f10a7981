"""Publishing: projections, quality gate, shards, feeds, digest, exports, archive."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import ZONE, days_until, ist_day
from ..functions.text import csv_guard, ics_escape, slug, xml_legal
from .durable import durable
from .ranks import with_places

FEED_ROWS, SHARD_ROWS, DIGEST_ROWS = 200, 500, 15
# What only the page of one notice needs.
DETAIL_FIELDS = ("documents", "ai", "award", "portal", "fee", "pre_bid_meeting_at", "city", "opening_at", "last_seen_at")


def published_number(number: str = "tender_number", source_id: str = "source_tender_id") -> Column:
    """The notice's number, or the source's id unless that is a made-up one."""
    made_up = F.col(source_id).startswith("hash:") | F.col(source_id).startswith("bid:")
    return F.coalesce(number, F.when(~made_up, F.col(source_id)))


def search_docs(canonical: DataFrame, now: Column, retention_days: int = 30, inferred: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """The flat projection of canonical rows that readers search; rows closed for longer than the retention are left out.

    The status is the effective one.  ``inferred`` (id, state, district) fills an empty state, and then an empty district, and marks it;
    ``artifacts`` (id, summary, eligibility, risk) become ``ai``, whose fields are null without any.
    """
    c, closing = F.col, F.col("dates.bid_submission_end")
    status = F.when((F.col("status") == "active") & (closing < now), "closed").otherwise(F.col("status"))
    rows = canonical.where(closing.isNull() | (closing >= now - F.make_dt_interval(F.lit(retention_days)))).select(
        c("canonical_id").alias("id"), c("procurement.title").alias("title"), c("organization.authority").alias("authority"), F.nullif("geography.state", F.lit("")).alias("state"),
        F.nullif("geography.district", F.lit("")).alias("district"), c("geography.city").alias("city"), c("procurement.category").alias("category"), c("procurement.procurement_type").alias("type"),
        c("financial.estimated_value").alias("value"), c("financial.emd_amount").alias("emd"), c("financial.tender_fee").alias("fee"), c("dates.published_at").alias("published_at"),
        closing.alias("closing_at"), c("dates.pre_bid_meeting_at").alias("pre_bid_meeting_at"), c("dates.bid_opening_at").alias("opening_at"), status.alias("status"),
        c("identity.source").alias("source"), c("identity.source_portal").alias("portal"), c("identity.reference_number").alias("ref"),
        published_number("identity.tender_number", "identity.source_tender_id").alias("tender_number"), c("provenance.official_source_url").alias("url"),
        c("provenance.first_seen_at").alias("first_seen_at"), c("provenance.last_seen_at").alias("last_seen_at"), "documents",
        F.coalesce(F.size("corrigenda"), F.lit(0)).alias("corrigenda_count"), "award",
    )
    if artifacts is None:
        rows = rows.withColumn("ai", F.struct(*[F.lit(None).cast("string").alias(n) for n in ("summary", "eligibility", "risk")]))
    else:
        found = artifacts.select(F.col("id").alias("artifact_id"), F.struct("summary", "eligibility", "risk").alias("ai"))
        rows = rows.join(found, F.col("id") == F.col("artifact_id"), "left").drop("artifact_id")
    if inferred is None:
        return rows.withColumn("state_inferred", F.lit(False))
    told = inferred.select(F.col("id").alias("told_id"), F.col("state").alias("told_state"), F.col("district").alias("told_district"))
    rows = rows.join(told, F.col("id") == F.col("told_id"), "left")
    fills = F.col("state").isNull() & F.col("told_state").isNotNull()
    filled = {"state_inferred": fills, "district": F.when(fills, F.coalesce("district", "told_district")).otherwise(F.col("district")), "state": F.coalesce("state", "told_state")}
    return rows.withColumns(filled).drop("told_id", "told_state", "told_district")


def slim(docs: DataFrame) -> DataFrame:
    return docs.drop(*DETAIL_FIELDS)


def detail_shards(docs: DataFrame, key: str = "id") -> DataFrame:
    """The heavy fields, with the shard of each row: the first two characters of its id."""
    return docs.select(key, *[c for c in DETAIL_FIELDS if c in docs.columns], F.lower(F.substring(F.col(key).cast("string"), 1, 2)).alias("shard"))


def gate(docs: DataFrame, previous: int | None, max_drop: float = 0.5, force: bool = False) -> int:
    """The row count; raises if there is nothing or far less than before, unless forced."""
    count = docs.count()
    if not force and (count == 0 or previous and count < previous * (1 - max_drop)):
        raise ValueError(f"refusing to publish {count} rows after {previous}")
    return count


def manifest(docs: DataFrame, key: str = "id") -> DataFrame:
    """(source, shard, n, digest): 500 ids a shard in id order per source, and the sha256 of its ids.  A source of any size is sorted by ranges."""
    rows = with_places(docs.select("source", key), ["source"], [F.col(key).asc()], [key])
    rows = rows.select("source", F.floor((F.col("place") - 1) / SHARD_ROWS).cast("int").alias("shard"), F.struct("place", F.col(key).cast("string").alias("k")).alias("at"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["k"]), ",")
    return rows.groupBy("source", "shard").agg(F.count("*").cast("int").alias("n"), F.sha2(listed, 256).alias("digest"))


def feeds(docs: DataFrame, top: int = FEED_ROWS) -> DataFrame:
    """(feed, place, id, updated): the newest of all, of each source and of each state; of colliding feed names one stays."""
    names = F.array_compact(
        F.array(
            F.lit("all"), F.concat(F.lit("source-"), slug(F.col("source"))),
            F.when(F.coalesce(slug(F.col("state")), F.lit("")) != "", F.concat(F.lit("state-"), slug(F.col("state")))),
        )
    )
    rows = docs.select(F.explode(names).alias("feed"), "id", F.col("first_seen_at").alias("updated"))
    place = F.row_number().over(W.partitionBy("feed").orderBy(F.desc_nulls_last("updated"), F.desc("id")))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("feed", "place", "id", "updated")


def atom(entries: DataFrame, base: str = "https://feeds.example.org") -> DataFrame:
    """(feed, xml) from feed entries with title and url; XML-illegal characters go, only http(s) links stay."""
    safe = lambda c: F.replace(F.replace(F.replace(xml_legal(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    link = F.when(F.col("url").rlike("^https?://"), F.concat(F.lit('<link href="'), safe(F.col("url")), F.lit('"/>'))).otherwise("")
    stamp = F.date_format(F.coalesce(F.col("updated").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.concat(F.lit("<entry><id>urn:notice:"), safe(F.col("id").cast("string")), F.lit("</id><title>"), safe(F.col("title")), F.lit("</title><updated>"), stamp, F.lit("</updated>"), link, F.lit("</entry>"))
    listed = entries.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("items"), F.max(stamp).alias("updated"))
    body = F.array_join(F.transform("items", lambda i: i["entry"]), "")
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><id>'), F.lit(base + "/"), F.col("feed"), F.lit("</id><title>"), F.col("feed"), F.lit("</title><updated>"), F.col("updated"), F.lit("</updated>"))
    return listed.select("feed", F.concat(head, body, F.lit("</feed>")).alias("xml"))


# The sections of the digest by their names, and its words.
SECTIONS = {"new": "New Today", "closing": "Closing Soon (7 days)"}
STAMP, NO_LINE = "_Generated ", "- none"


def digest(docs: DataFrame, now: Column, top: int = DIGEST_ROWS) -> DataFrame:
    """(section, place, id, value, total): the most valuable notices first seen on the Indian day of ``now`` and those closing in [0, 8) days, with
    section totals.  An undisclosed value counts as 0."""
    day = days_until(F.col("closing_at"), now)
    sections = F.array_compact(F.array(F.when(ist_day(F.col("first_seen_at")) == ist_day(now), "new"), F.when((F.col("status") == "active") & day.between(0, 7), "closing")))
    rows = docs.select(F.explode(sections).alias("section"), "id", "value")
    place = F.row_number().over(W.partitionBy("section").orderBy(F.desc(F.coalesce("value", F.lit(0))), "id"))  # ranked alone, cut before the shuffle
    top_rows = rows.withColumn("place", place).where(F.col("place") <= top)
    totals = rows.groupBy("section").agg(F.count("*").cast("int").alias("total"))
    return top_rows.join(totals, "section").select("section", "place", "id", "value", "total")


def digest_text(docs: DataFrame, now: Column, stamp: str, heading: str, top: int = DIGEST_ROWS) -> DataFrame:
    """One row, ``text``: the digest in Markdown, its heading and stamp, then each section with its total and one line a notice."""
    kept = docs.select("id", "title", "url", "authority", "closing_at")
    found = digest(docs, now, top).join(kept, "id")
    amount = F.when(F.coalesce("value", F.lit(0)) != 0, F.concat(F.lit("₹"), F.format_string("%.2f", F.bround(F.col("value") / 1e7, 2)), F.lit(" Cr"))).otherwise("value not disclosed")
    closes = F.coalesce(F.date_format(F.from_utc_timestamp(F.col("closing_at").cast("timestamp"), ZONE), "dd MMM HH:mm"), F.lit("—"))
    line = F.concat(F.lit("- ["), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(") — "), F.coalesce("authority", F.lit("")), F.lit(" — "), amount, F.lit(" — closes "), closes)
    lines = found.groupBy("section").agg(F.max("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    every = docs.sparkSession.createDataFrame([(i, k, name) for i, (k, name) in enumerate(SECTIONS.items())], "i int, section string, name string")
    part = F.concat(F.lit("## "), "name", F.lit(" ("), F.coalesce("total", F.lit(0)).cast("string"), F.lit(")\n\n"), F.coalesce("lines", F.lit(NO_LINE)), F.lit("\n"))
    parts = every.join(lines, "section", "left").agg(F.array_sort(F.collect_list(F.struct("i", part.alias("part")))).alias("parts"))
    return parts.select(F.concat(F.lit(f"# {heading}\n\n{STAMP}{stamp}_\n\n"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n")).alias("text"))


def without_stamp(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.startswith(STAMP)), "\n")


def write_digest(text: DataFrame, path: str) -> bool:
    """Writes the digest unless it differs from the one at ``path`` by its stamp only; whether it was written."""
    spark, bare = text.sparkSession, lambda frame: frame.select(without_stamp(F.col("text"))).first()[0]
    try:
        old = bare(spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n\z", "").alias("text")))
    except AnalysisException:  # none is there yet
        old = None
    if old is not None and old == bare(text):
        return False
    text.coalesce(1).write.mode("overwrite").text(path)
    return True


def csv_columns(docs: DataFrame, columns: list[str]) -> DataFrame:
    """All columns as guarded text; an undisclosed value stays empty, never 0."""
    return docs.select(*[csv_guard(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])


def write_csv(docs: DataFrame, path: str, columns: list[str]) -> None:
    """As spreadsheets want it: the mark of UTF-8 before the header of every part, lines ended by CR and LF."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), cell(c)).otherwise(c)
    text = csv_columns(docs, columns)
    lines = text.select(F.concat(F.concat_ws(",", *[quoted(F.col(c)) for c in columns]), F.lit("\r")).alias("value"))
    head = "\ufeff" + ",".join(columns) + "\r"

    def headed(batches):
        yield pa.record_batch([pa.array([head], pa.string())], ["value"])
        for batch in batches:
            yield pa.record_batch([batch.column(0).cast(pa.string())], ["value"])

    lines.mapInArrow(headed, "value string").write.mode("overwrite").option("lineSep", "\n").text(path)


def write_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_queue(queue: DataFrame, path: str) -> None:
    """A queue as JSON lines, one for each item, nulls included; the last line of an item counts (:func:`queue.pending`)."""
    queue.write.mode("append").json(path, ignoreNullFields=False)


def write_pages(pages: DataFrame, path: str, doc: str = "doc") -> None:
    """Extracted pages (doc, page, text) as gzip JSON lines, a folder for each document, so that one is read or replaced alone."""
    pages.sortWithinPartitions(doc, "page").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(doc).json(path, compression="gzip")


def ics_event(now: Column) -> Column:
    at = lambda c: F.date_format(c.cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    return F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id").cast("string"), F.lit("@notices")), F.concat(F.lit("DTSTAMP:"), at(now)),
        F.concat(F.lit("DTSTART:"), at(F.col("closing_at"))), F.concat(F.lit("SUMMARY:"), ics_escape(F.col("title"))), F.lit("END:VEVENT"),
    )


def calendar(docs: DataFrame, now: Column) -> DataFrame:
    """(source, ics): the closing times of each source's notices as one calendar."""
    event = F.struct("closing_at", "id", ics_event(now).alias("event"))
    events = docs.where("closing_at is not null").groupBy("source").agg(F.array_sort(F.collect_list(event)).alias("events"))
    body = F.array_join(F.transform("events", lambda e: e["event"]), "\r\n")
    head, tail = F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//notices//EN\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")
    return events.select("source", F.concat(head, body, tail).alias("ics"))


def field_rows(docs: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """One row for each field of each notice: (id, field, value)."""
    text = docs.select(F.col(key), *[csv_guard(F.col(f).cast("string")).alias(f) for f in fields])
    return text.unpivot(key, fields, "field", "value")


def timeline(docs: DataFrame, events: dict[str, str], key: str = "id") -> DataFrame:
    """(id, place, event, at) of the dated events of each notice, in order."""
    parts = F.array(*[F.struct(F.col(column).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("event")) for i, (name, column) in enumerate(events.items())])
    kept = F.array_sort(F.filter(parts, lambda p: p["at"].isNotNull()))
    return docs.select(F.col(key), F.posexplode(kept).alias("pos", "e")).select(key, (F.col("pos") + 1).alias("place"), "e.event", "e.at")


def archive_partition(docs: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows whose closing time is more than ``days`` past, with the partition they go to."""
    old = docs.where(F.col("closing_at") < now - F.make_dt_interval(F.lit(days)))
    return old.withColumn("yyyy", F.date_format("closing_at", "yyyy")).withColumn("mm", F.date_format("closing_at", "MM")).withColumn("partition", F.concat_ws("_", "source", "yyyy", "mm"))


def merge_archive(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Both, the new row of an id winning; earlier rows are never lost."""
    ranked = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    first = F.row_number().over(W.partitionBy(key).orderBy("_age"))
    return ranked.withColumn("_n", first).where("_n = 1").drop("_n", "_age")


def write_archive(rows: DataFrame, path: str) -> None:
    """Merges ``rows`` into the partitions they belong to; all other partitions, and earlier rows of these, stay."""
    spark, by = rows.sparkSession, ["source", "yyyy", "mm"]
    try:
        earlier = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException:  # nothing is archived yet
        earlier = None
    if earlier is not None:
        touched = rows.select(*by).distinct()
        rows = durable(merge_archive(earlier.join(touched, by, "left_semi").select(*rows.columns), rows))  # read before it is replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def shift_days(docs: DataFrame, columns: list[str], days: int) -> DataFrame:
    """Dates moved by whole days, so that a fixture keeps its distance from a later ``now``."""
    return docs.withColumns({c: F.col(c) + F.make_dt_interval(F.lit(days)) for c in columns})


def changed(old: DataFrame, new: DataFrame, volatile: tuple[str, ...] = ()) -> bool:
    """Whether anything but the volatile columns differs, regardless of order: a write is spared otherwise."""
    columns = [c for c in new.columns if c not in volatile]
    if sorted(columns) != sorted(c for c in old.columns if c not in volatile):
        return True
    mark = lambda d: d.select(F.xxhash64(*columns).alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return tuple(mark(old)) != tuple(mark(new))
