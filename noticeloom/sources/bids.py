"""Landed answers of a bid API: pages, the rules by which paging stops, records in the canonical shape; sources read by their family.

Pages lie as whole files in folders ``source=.../page=N``, which Spark lists and prunes, in any store that it reads.  What orders pages - a window over a
source's pages - holds a page's number, total and counts, never its contents, which are joined to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import portal_timestamp
from ..functions.ids import canonical_id
from ..functions.text import clean_text
from ..operators.durable import durable
from ..operators.once import once
from ..schema import canonical_columns
from . import listings
from .records import BUYER_STATUS, FAMILIES, Source, unwrapped

PAGE_SIZE = 10
#: A source with this status is read only if asked for expressly.
RESTRICTED = "POLICY_RESTRICTED"


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, body): every file below ``source=.../page=N`` as one text."""
    rows = spark.read.option("basePath", path).text(path, wholetext=True)
    return rows.select(F.col("source").cast("string").alias("source"), F.col("page").cast("int").alias("page"), F.col("value").alias("body"))


def answers(pages: DataFrame) -> DataFrame:
    """(source, page, error, total, docs): a page's records as JSON texts, or why it has none."""
    code = F.get_json_object("body", "$.code")
    wrong = F.when(F.try_parse_json(F.coalesce("body", F.lit(""))).isNull(), "no JSON").when(code.isNull() | (code != "200"), F.concat(F.lit("API code "), F.coalesce(code, F.lit("none"))))
    docs = F.from_json(F.get_json_object("body", "$.response.response.docs"), "array<string>")
    empty = F.array().cast("array<string>")
    return pages.select(
        "source", "page", wrong.alias("error"), F.get_json_object("body", "$.response.response.numFound").try_cast("double").cast("long").alias("total"),
        F.when(wrong.isNull(), F.coalesce(docs, empty)).otherwise(empty).alias("docs"),
    )


def native_id(doc: Column) -> Column:
    number, key = F.nullif(unwrapped(doc, "b_bid_number"), F.lit("")), F.nullif(unwrapped(doc, "b_id"), F.lit(""))
    return F.coalesce(number, F.concat(F.lit("bid:"), key))


def with_stops(found: DataFrame, size: int = PAGE_SIZE, caps: dict[str, int] | None = None, cap: int = 50) -> DataFrame:
    """Pages with ``used`` and ``stop``, the rule that ends its source's paging there.

    In page order: beyond the cap, an error, no records or no new ones end it before the page; fewer records than ``size`` or a total that is
    reached end it after.  A page without a total has the last one told before.
    """
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in (caps or {"": cap}).items() for x in pair]), F.col("source")), F.lit(cap))
    columns = found.columns
    found = durable(found.withColumn("row_", F.monotonically_increasing_id()))  # pages are read once, and each keeps its number
    ids = found.select("source", "page", F.explode("docs").alias("doc")).select("source", "page", native_id(F.col("doc")).alias("id")).where("id is not null")
    fresh = ids.groupBy("source", "id").agg(F.min("page").alias("page")).groupBy("source", "page").agg(F.count("*").alias("fresh"))
    slim = found.select("row_", "source", "page", "error", "total", F.size("docs").alias("docs_"))
    rows = slim.join(fresh.select(F.col("source").alias("s_"), F.col("page").alias("p_"), "fresh"), (F.col("source") == F.col("s_")) & (F.col("page") == F.col("p_")), "left").drop("s_", "p_")
    by = W.partitionBy("source").orderBy("page")
    told = F.last("total", ignorenulls=True).over(by)
    rows = rows.withColumn("told_", told).withColumn("gap_", F.col("page") - F.coalesce(F.lag("page").over(by), F.lit(0)))
    before = (
        F.when(F.col("page") > most, "cap").when(F.col("gap_") > 1, "missing page").when(F.col("error").isNotNull(), "error").when(F.col("docs_") == 0, "empty")
        .when(F.coalesce("fresh", F.lit(0)) == 0, "nothing new")
    )
    after = F.when(F.col("docs_") < size, "short page").when(F.col("page") * size >= F.col("told_"), "total")
    rows = rows.withColumn("before_", before).withColumn("stop", F.coalesce(before, after))
    ended = F.coalesce(F.max(F.col("stop").isNotNull()).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("ended_", ended)
    stops = rows.select(F.col("row_").alias("of_"), (~F.col("ended_") & F.col("before_").isNull()).alias("used"), F.when(~F.col("ended_"), F.col("stop")).alias("stop"))
    return found.join(stops, F.col("row_") == F.col("of_")).select(*columns, "used", "stop")


def bid_docs(pages: DataFrame, size: int = PAGE_SIZE, caps: dict[str, int] | None = None, cap: int = 50) -> DataFrame:
    """(source, page, place, id, doc): the first record of each id on the pages that are used."""
    used = with_stops(answers(pages), size, caps, cap).where("used")
    rows = used.select("source", "page", F.posexplode("docs").alias("place", "doc")).withColumn("id", native_id(F.col("doc"))).where("id is not null")
    first = F.row_number().over(W.partitionBy("source", "id").orderBy("page", "place"))
    return rows.withColumn("nth_", first).where("nth_ = 1").drop("nth_")


# The fields of a record that are read.
FIELDS = (
    "b_id", "b_bid_number", "b_bid_number_parent", "b_id_parent", "b_bid_type", "b_eval_type", "b_category_name", "bd_category_name", "bbt_title", "b_cat_id", "b_total_quantity", "is_high_value",
    "ba_is_global_tendering", "is_rc_bid", "b_buyer_status", "final_start_date_sort", "final_end_date_sort", "ba_official_details_minName", "ba_official_details_deptName",
)


def _first_value(text: Column) -> Column:
    """What a JSON value says: the first of a list, nothing of an empty one."""
    many = F.from_json(text, "array<string>")
    return F.when(text.startswith("["), F.when(many.isNull(), text).otherwise(F.get(many, F.lit(0)))).otherwise(text)


def bids(docs: DataFrame, base_url: str, listing_url: str, now: Column, doc: str = "doc") -> DataFrame:
    """Records (source, JSON) in the canonical shape.  Nothing is inferred that a record does not say."""
    # a record is parsed once, and each of its fields is unwrapped once
    rows = once(docs.withColumn("id_", native_id(F.col(doc))).where("id_ is not null"), record_=F.from_json(F.col(doc), "map<string,string>"))
    rows = once(rows, **{f"f_{name}": _first_value(F.col("record_")[name]) for name in FIELDS})
    f = lambda name: F.col(f"f_{name}")
    number = lambda name: f(name).try_cast("double").cast("int")
    text = lambda c, most: clean_text(c, most)
    said = lambda c: F.nullif(c, F.lit(""))
    parent, parent_key, kind = said(f("b_bid_number_parent")), said(f("b_id_parent")), number("b_bid_type")
    auction = F.coalesce(kind.isin(2, 5), F.lit(False))
    label = F.when(kind == 5, "showdirectradocumentPdf").when(kind == 2, F.when(F.coalesce(number("b_eval_type"), F.lit(0)) > 0, "list-ra-schedules").otherwise("showradocumentPdf")).otherwise("showbidDocument")
    url = F.when(said(f("b_id")).isNotNull(), F.concat(F.lit(f"{base_url}/"), label, F.lit("/"), f("b_id")))
    document = lambda title, link: F.struct(title.alias("title"), F.lit("nit").alias("type"), link.alias("source_url"), F.lit(None).cast("bigint").alias("file_size"), F.lit(None).cast("string").alias("hash"), F.lit(False).alias("text_extracted"))
    own = F.when(url.isNotNull(), document(F.when(auction, "Reverse auction document (official PDF)").otherwise("Bid document (official PDF)"), url))
    of_parent = F.when(auction & parent_key.isNotNull(), document(F.coalesce(F.concat(F.lit("Parent bid document ("), parent, F.lit(")")), F.lit("Parent bid document")), F.concat(F.lit(f"{base_url}/showbidDocument/"), parent_key)))
    category, item, quantity = f("b_category_name"), f("bd_category_name"), f("b_total_quantity").try_cast("double")
    shown = F.when(quantity == F.floor(quantity), quantity.cast("long").cast("string")).otherwise(quantity.cast("string"))
    facts = F.concat_ws(
        "; ", F.when(quantity > 0, F.concat(F.lit("Quantity: "), shown)), F.when(said(item).isNotNull() & ~item.eqNullSafe(category), F.concat(F.lit("Item details: "), item)),
        F.when(f("is_high_value") == "true", "High-value bid"), F.when(number("ba_is_global_tendering") == 1, "Global tender enquiry"), F.when(number("is_rc_bid") == 1, "Rate contract bid"),
        F.concat(F.lit("Reverse auction on bid "), parent),
    )
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BUYER_STATUS.items() for x in pair]), F.coalesce(number("b_buyer_status"), F.lit(0)).cast("string")), F.lit("unknown"))
    native, start = F.col("id_"), portal_timestamp(f("final_start_date_sort"))
    ministry, department = said(f("ba_official_details_minName")), said(f("ba_official_details_deptName"))
    values = {
        "schema_version": F.lit("1.0.0"), "canonical_id": canonical_id(F.col("source"), native), "identity.source": F.col("source"), "identity.source_portal": F.lit(base_url), "identity.source_tender_id": native,
        "identity.tender_number": text(f("b_bid_number"), 100), "identity.reference_number": F.when(auction, text(parent, 100)),
        "procurement.title": text(F.coalesce(said(f("bbt_title")), said(item), category), 500), "procurement.description": text(facts, 1000), "procurement.category": text(category, 300),
        "procurement.tender_type": F.when(auction, "ra").otherwise("open"), "procurement.procurement_type": F.when(auction, "auction").when(f("b_cat_id").startswith("services"), "services"),
        "organization.ministry": text(ministry, 200), "organization.department": text(department, 200), "organization.authority": text(F.concat_ws(" — ", ministry, department), 400),
        "dates.published_at": start, "dates.bid_submission_start": start, "dates.bid_submission_end": portal_timestamp(f("final_end_date_sort")), "documents": F.array_compact(F.array(own, of_parent)),
        "status": status, "provenance.official_source_url": F.coalesce(url, F.lit(f"{base_url}/bidlists")), "provenance.source_listing_url": F.lit(listing_url), "provenance.scraped_at": now,
        "provenance.first_seen_at": now, "provenance.last_seen_at": now,
    }
    return rows.select(*canonical_columns(values))


#: What reads the landed pages (url, html) of a family that lists in HTML.
GRAMMARS = {
    "gepnic": listings.parse_listings, "ireps": listings.parse_zone_results, "notice_pages": listings.parse_paged, "s3waas": listings.parse_district, "cppp_state": listings.parse_listings,
}


def read_source(pages: DataFrame, source: Source, now: Column, restricted: bool = False) -> DataFrame:
    """A source's landed pages (source, page, body) read by its family: canonical rows of a bid API, listed rows of the others.

    A restricted source raises PermissionError unless ``restricted`` is set, a family that nothing reads ValueError.  Options: ``page_size`` and
    ``max_pages`` of a bid API.
    """
    if source.status == RESTRICTED and not restricted:
        raise PermissionError(f"{source.name} is restricted by its policy")
    if source.family not in FAMILIES:
        raise ValueError(f"{source.name}: no family {source.family}")
    own = pages.where(F.col("source") == source.name)
    if source.family == "gem":
        found = bid_docs(own, int(source.options.get("page_size", PAGE_SIZE)), cap=int(source.options.get("max_pages", 50)))
        return bids(found, source.base_url, f"{source.base_url}/all-bids", now)
    return GRAMMARS[source.family](own.select(F.concat(F.lit(f"{source.base_url}/"), F.col("page").cast("string")).alias("url"), F.col("body").alias("html")))


def crawled(rows: DataFrame, key: str, order: str, state: str = "state", include: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key, of states that are included (all, if none is named) and not skipped; a null state is included only by naming none."""
    wanted = F.coalesce(F.col(state).isin(*include), F.lit(False)) if include else F.lit(True)
    left_out = F.coalesce(F.col(state).isin(*skip), F.lit(False)) if skip else F.lit(False)
    return listings.first_occurrence(rows.where(wanted & ~left_out), key, order)
