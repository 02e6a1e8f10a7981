"""The canonical notice."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

STATUSES = ("active", "closed", "cancelled", "awarded", "retendered", "unknown")
_CANONICAL = """
schema_version STRING, canonical_id STRING,
identity STRUCT<source: STRING, source_portal: STRING, source_tender_id: STRING, tender_number: STRING, reference_number: STRING>,
procurement STRUCT<title: STRING, description: STRING, procurement_type: STRING, tender_type: STRING, contract_type: STRING, category: STRING, subcategory: STRING>,
organization STRUCT<ministry: STRING, department: STRING, organization: STRING, division: STRING, authority: STRING>,
geography STRUCT<state: STRING, district: STRING, city: STRING, pincode: STRING, location_text: STRING>,
financial STRUCT<estimated_value: DOUBLE, currency: STRING, emd_amount: DOUBLE, tender_fee: DOUBLE, performance_security_pct: DOUBLE>,
dates STRUCT<published_at: TIMESTAMP, bid_submission_start: TIMESTAMP, bid_submission_end: TIMESTAMP, bid_opening_at: TIMESTAMP, pre_bid_meeting_at: TIMESTAMP, clarification_start: TIMESTAMP, clarification_end: TIMESTAMP>,
eligibility STRUCT<prequalification_text: STRING, experience_requirement_text: STRING, turnover_requirement_text: STRING>,
work STRUCT<scope: STRING, period_of_work_days: INT, bid_validity_days: INT>,
documents ARRAY<STRUCT<title: STRING, type: STRING, source_url: STRING, file_size: BIGINT, hash: STRING, text_extracted: BOOLEAN>>,
corrigenda ARRAY<STRUCT<source_ref: STRING, published_at: TIMESTAMP, title: STRING, source_url: STRING>>,
award STRUCT<winning_bidder: STRING, award_value: DOUBLE, awarded_at: TIMESTAMP, source_url: STRING>,
status STRING,
provenance STRUCT<official_source_url: STRING, source_listing_url: STRING, scraped_at: TIMESTAMP, first_seen_at: TIMESTAMP, last_seen_at: TIMESTAMP, parser_version: STRING, content_hash: STRING>,
possible_duplicate_group STRING
"""


@lru_cache(maxsize=1)
def canonical_schema() -> StructType:
    """Parsed on first use: that takes a session."""
    return StructType.fromDDL(_CANONICAL)


def canonical_columns(values: dict[str, Column]) -> list[Column]:
    """All canonical columns from values by dotted names, such as ``procurement.title``; what is not named is null."""

    def made(kind: DataType, path: str) -> Column:
        if path in values:
            return values[path].cast(kind)
        if isinstance(kind, StructType) and any(name.startswith(f"{path}.") for name in values):
            return F.struct(*[made(f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind])
        return F.lit(None).cast(kind)

    return [made(f.dataType, f.name).alias(f.name) for f in canonical_schema()]


#: Sections whose non-null fields overwrite on a merge.
SECTIONS = ("procurement", "organization", "geography", "financial", "dates", "eligibility", "work")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, rule in rules.items()]))


def canonical_rules() -> dict[str, Column]:
    """Rules of the canonical schema that types alone do not hold."""
    at_least_zero = lambda c: F.col(c).isNull() | (F.col(c) >= 0)
    return {
        "schema_version": F.col("schema_version") == "1.0.0",
        "canonical_id": F.col("canonical_id").rlike("^[0-9a-f]{24}$"),
        "source": F.col("identity.source").isNotNull() & F.col("identity.source_tender_id").isNotNull(),
        "status": F.col("status").isin(*STATUSES),
        "estimated_value": at_least_zero("financial.estimated_value"),
        "emd_amount": at_least_zero("financial.emd_amount"),
        "tender_fee": at_least_zero("financial.tender_fee"),
        "period_of_work_days": at_least_zero("work.period_of_work_days"),
        "bid_validity_days": at_least_zero("work.bid_validity_days"),
        "document_urls": F.forall(F.coalesce("documents", F.array()), lambda d: d["source_url"].isNotNull() & d["title"].isNotNull()),
        "official_source_url": F.col("provenance.official_source_url").isNotNull(),
    }
