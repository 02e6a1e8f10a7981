"""A reader's workspace and model answers: untrusted backups, comparisons, requirement look-up, answer normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("new", "reviewing", "bidding", "submitted", "won", "lost", "ignored")
_BACKUP = (
    "version int, bookmarks array<struct<id: string, status: string, saved_at: string, note: string>>,"
    " searches array<struct<id: string, name: string, query: string>>, profile map<string, string>"
)
_ANSWER = (
    "summary string, requirements array<struct<text: string, mandatory: boolean, page: int>>,"
    " flags array<struct<label: string, basis: string, severity: string>>, confidence double"
)


def parse_backup(raw: Column, max_chars: int = 5_000_000) -> Column:
    """An untrusted backup: too large or shapeless ones are null, bad entries are dropped, unknown states become ``new``."""
    parsed = F.from_json(F.when(F.length(raw) <= max_chars, raw), _BACKUP, {"mode": "PERMISSIVE"})
    fine = F.filter(F.coalesce(parsed["bookmarks"], F.expr("array()").cast("array<struct<id:string,status:string,saved_at:string,note:string>>")), lambda b: F.length(F.trim(b["id"])).between(1, 200))
    marks = F.transform(
        fine,
        lambda b: F.struct(
            F.trim(b["id"]).alias("id"), F.when(b["status"].isin(*STATES), b["status"]).otherwise("new").alias("status"),
            b["saved_at"].try_cast("timestamp").alias("saved_at"), F.substring(b["note"], 1, 2000).alias("note"),
        ),
    )
    searches = F.filter(F.coalesce(parsed["searches"], F.expr("array()").cast("array<struct<id:string,name:string,query:string>>")), lambda s: (F.trim(s["id"]) != "") & (F.trim(s["name"]) != ""))
    shaped = F.json_object_keys(raw).isNotNull() & (F.length(raw) <= max_chars)
    return F.when(shaped, F.struct(marks.alias("bookmarks"), searches.alias("searches"), parsed["profile"].alias("profile")))


def compare(docs: DataFrame, chosen: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    """The first ``most`` chosen notices, by (place, id); none if fewer than ``least`` of them exist."""
    picked = docs.join(F.broadcast(chosen.orderBy("place").limit(most)), "id")
    count = picked.agg(F.count("*").alias("_n"))
    return picked.join(F.broadcast(count), how="cross").where(F.col("_n") >= least).drop("_n").orderBy("place")


def first_requirement(requirements: Column, pattern: str) -> Column:
    """The first requirement text that matches."""
    return F.get(F.filter(requirements, lambda r: r.rlike(pattern)), F.lit(0))


def normalised_answer(json: Column) -> Column:
    """A model answer by schema: blank requirements and flags without a basis are dropped, confidence is kept in 0..1."""
    parsed = F.from_json(json, _ANSWER)
    kept = lambda name, rule: F.filter(F.coalesce(parsed[name], F.filter(parsed[name], lambda x: F.lit(False))), rule)
    return F.struct(
        F.nullif(F.trim(parsed["summary"]), F.lit("")).alias("summary"),
        kept("requirements", lambda r: F.trim(r["text"]) != "").alias("requirements"),
        kept("flags", lambda f: F.trim(f["basis"]) != "").alias("flags"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), parsed["confidence"])).alias("confidence"),
    )


def waiting_by_priority(queue: DataFrame) -> DataFrame:
    """(priority, n) with the total in the row without a priority."""
    return queue.rollup("priority").agg(F.count("*").alias("n"))


def absolute_url(base: Column, href: Column) -> Column:
    """A link of a page as an absolute, percent-encoded URL: full, host-relative or relative to the page's folder."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<!/)/[^/]*$", "")
    joined = F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))
    return F.replace(joined, F.lit(" "), F.lit("%20"))


def basename(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)


def page_token(page: Column) -> Column:
    """A page number as the listing's base64 token, url-encoded."""
    return F.url_encode(F.base64(F.encode(page.cast("string"), "UTF-8")))


def zone_name(raw: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(raw, r"[_\s]+", " ")))


def evidence_field(json: Column) -> Column:
    """(value, confidence, citation) of one field of a model answer; null without a citation, confidence is kept in 0..1."""
    parsed = F.from_json(json, "value string, confidence double, citation string")
    citation = F.nullif(F.trim(parsed["citation"]), F.lit(""))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), parsed["confidence"]))
    return F.when(citation.isNotNull(), F.struct(parsed["value"].alias("value"), confidence.alias("confidence"), citation.alias("citation")))
