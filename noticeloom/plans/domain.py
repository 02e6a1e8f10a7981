"""Identity, change data, duplicates, geography, matching, search, health, text functions, parsing and streaming over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import amounts, dates, ids, text
from ..operators import chunks, dedupe, filters, geo, health, jsonrules, match, merge, search
from ..operators import queue as Q
from ..operators.durable import scratch_root
from ..operators.once import once
from ..schema import canonical_columns, violations
from ..sources import listings, records
from ..streaming import incremental
from .notices import notices, now, sql, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLE_SQL[function.__name__] = oracle
        return function

    return register


# ---- identity, merge, change data ------------------------------------------------------------------------------------


@query(sql("SELECT id, substr(sha256(source || '::' || id::VARCHAR), 1, 24) AS canonical_id FROM n"))
def q_canonical_id(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).select("id", ids.canonical_id(F.col("source"), F.col("id")).alias("canonical_id"))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A store without every 11th order, and an incoming part with altered values, times and some nulls."""
    rows = notices(spark, d).select("id", "title", "category", "value", "closing_at", "status")
    store = rows.where("id % 11 <> 0").withColumn("revision", F.lit(1))
    fresh = rows.where("id % 3 <> 1").withColumns(
        {
            "value": F.when(F.col("id") % 6 == 0, F.col("value") + 1000).otherwise(F.col("value")),
            "closing_at": F.when(F.col("id") % 9 == 0, F.col("closing_at") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("closing_at")),
            "category": F.when(F.col("id") % 4 != 0, F.col("category")),
            "status": F.when(F.col("id") % 15 == 0, F.lit("cancelled")).otherwise(F.col("status")),
        }
    )
    return store, fresh


_TRACKED = {"procurement.title": "title", "procurement.category": "category", "financial.estimated_value": "value", "dates.bid_submission_end": "closing_at", "status": "status"}


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    store, fresh = _snapshots(spark, d)
    return merge.upsert(store, fresh, "id", ["title", "category", "value", "closing_at", "status"], _TRACKED, overwritten=("status",))


_MERGE = """o AS (SELECT id, title, category, value, closing_at, status FROM n WHERE id % 11 <> 0),
f AS (SELECT id, title, CASE WHEN id % 4 <> 0 THEN category END AS category, CASE WHEN id % 6 = 0 THEN value + 1000 ELSE value END AS value,
 CASE WHEN id % 9 = 0 THEN closing_at + INTERVAL 2 DAY ELSE closing_at END AS closing_at, CASE WHEN id % 15 = 0 THEN 'cancelled' ELSE status END AS status FROM n WHERE id % 3 <> 1),
m AS (SELECT coalesce(o.id, f.id) AS id, o.id IS NULL AS is_new, f.id IS NULL AS untouched, coalesce(f.title, o.title) AS title, coalesce(f.category, o.category) AS category, coalesce(f.value, o.value) AS value,
 coalesce(f.closing_at, o.closing_at) AS closing_at, CASE WHEN f.id IS NULL THEN o.status ELSE f.status END AS status,
 o.value AS old_value, o.closing_at AS old_closing, o.status AS old_status FROM o FULL JOIN f ON o.id = f.id),
c AS (SELECT id, 2 AS i, 'financial.estimated_value' AS field, old_value::VARCHAR AS old, value::VARCHAR AS new FROM m WHERE NOT is_new AND NOT untouched AND old_value IS DISTINCT FROM value
 UNION ALL SELECT id, 3, 'dates.bid_submission_end', strftime(old_closing, '%Y-%m-%d %H:%M:%S'), strftime(closing_at, '%Y-%m-%d %H:%M:%S') FROM m WHERE NOT is_new AND NOT untouched AND old_closing IS DISTINCT FROM closing_at
 UNION ALL SELECT id, 4, 'status', old_status, status FROM m WHERE NOT is_new AND NOT untouched AND old_status IS DISTINCT FROM status)"""


@query(sql("SELECT id, category, round(value::DECIMAL(18,2), 2)::DOUBLE AS value, strftime(closing_at, '%Y-%m-%d') AS closing, status, is_new FROM m", _MERGE))
def q_merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value").cast("decimal(18,2)").cast("double").alias("value")
    return _upserted(spark, d).select("id", "category", value, F.date_format("closing_at", "yyyy-MM-dd").alias("closing"), "status", "is_new")


def _tracked(spark: SparkSession, d: str) -> DataFrame:
    """The upsert with values of two decimals, which print alike everywhere."""
    store, fresh = (x.withColumn("value", F.col("value").cast("decimal(18,2)")) for x in _snapshots(spark, d))
    return merge.upsert(store, fresh, "id", ["title", "category", "value", "closing_at", "status"], _TRACKED, overwritten=("status",))


@query(sql("SELECT id, field, old, new FROM c", _MERGE.replace("old_value::VARCHAR AS old, value::VARCHAR AS new", "old_value::DECIMAL(18,2)::VARCHAR AS old, value::DECIMAL(18,2)::VARCHAR AS new")))
def q_diff_changes(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d).select("id", F.inline("changes"))


@query(sql("SELECT CASE WHEN field = 'dates.bid_submission_end' THEN 'CRITICAL' WHEN field IN ('financial.estimated_value', 'status') THEN 'IMPORTANT' ELSE 'REVIEW' END AS severity, count(*) AS n FROM c GROUP BY 1", _MERGE))
def q_severity(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d).select(F.inline("changes")).groupBy(merge.severity(F.col("field")).alias("severity")).agg(F.count("*").alias("n"))


@query(sql("SELECT m.id, (CASE WHEN is_new THEN 0 ELSE 1 END + CASE WHEN is_new OR EXISTS (SELECT 1 FROM c WHERE c.id = m.id) THEN 1 ELSE 0 END)::INT AS revision FROM m", _MERGE))
def q_revision(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d).select("id", "revision")


@query(sql("SELECT id, coalesce((SELECT string_agg(CASE field WHEN 'dates.bid_submission_end' THEN 'bid submission end' WHEN 'status' THEN 'status' ELSE 'estimated value' END || CASE WHEN old IS NULL THEN ' set to ' ELSE ': ' || old || ' → ' END || coalesce(new, 'None'), '; ' ORDER BY i) FROM c WHERE c.id = m.id), 'no tracked changes') AS summary FROM m", _MERGE.replace("old_value::VARCHAR AS old, value::VARCHAR AS new", "old_value::DECIMAL(18,2)::VARCHAR AS old, value::DECIMAL(18,2)::VARCHAR AS new")))
def q_change_summary(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d).select("id", merge.change_summary(F.col("changes")).alias("summary"))


@query("SELECT user_id, list(event_id ORDER BY event_id)[-50:] AS changes FROM events GROUP BY 1")
def q_last50(spark: SparkSession, d: str) -> DataFrame:
    """Ranked first, so that no more than 50 events of a user are gathered."""
    last = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    rows = table(spark, d, "events").select("user_id", "event_id").withColumn("last", last).where(F.col("last") <= merge.LAST_CHANGES)
    rows = rows.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("all"))
    return rows.select("user_id", merge.append_history(F.slice("all", 1, 3), F.expr("slice(all, 4, greatest(size(all), 1))")).alias("changes"))


@query(sql("""SELECT count(*) FILTER (o.h = f.h) AS noop, count(*) FILTER (o.h <> f.h) AS rewritten, bit_xor(('0x' || substr(f.h, 1, 8))::BIGINT)::BIGINT AS mark FROM
(SELECT id, sha256('{"title":"' || title || '","category":"' || category || '","status":"' || status || '"}') AS h FROM o) o
JOIN (SELECT id, sha256('{"title":"' || title || '","category":' || coalesce('"' || category || '"', 'null') || ',"status":"' || status || '"}') AS h FROM f) f USING (id)""", _MERGE))
def q_content_hash_noop(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes, over canonical JSON with its nulls, of both sides."""
    store, fresh = _snapshots(spark, d)
    mark = ids.content_hash(F.col("title"), F.col("category"), F.col("status"))
    both = store.select("id", mark.alias("h")).join(fresh.select("id", mark.alias("g")), "id")
    number = F.conv(F.substring("g", 1, 8), 16, 10).cast("long")
    return both.agg(F.count_if(F.col("h") == F.col("g")).alias("noop"), F.count_if(F.col("h") != F.col("g")).alias("rewritten"), F.bit_xor(number).alias("mark"))


# ---- duplicates ------------------------------------------------------------------------------------------------------


@query(sql("SELECT a, b FROM (SELECT lag(id) OVER w AS a, id AS b, lag(source) OVER w AS s, source FROM n WINDOW w AS (PARTITION BY upper(trim(ref)) ORDER BY id)) WHERE s <> source"))
def q_dedupe_reference(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.reference_links(notices(spark, d), F.col("ref"))


@query(sql("SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, abs(date_diff('second', x.closing_at, y.closing_at)) AS gap_s FROM n x JOIN n y ON lower(x.authority) = lower(y.authority) AND x.state = y.state AND x.id < y.id AND x.source <> y.source AND abs(date_diff('second', x.closing_at, y.closing_at)) < 21600"))
def q_dedupe_blocks(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.blocked_pairs(notices(spark, d)).select("a", "b", "gap_s")


@query()
def q_dedupe_similar(spark: SparkSession, d: str) -> DataFrame:
    """Blocked pairs that reach the similarity threshold; the ratio is an algorithm that SQL does not have."""
    return dedupe.similar_links(dedupe.blocked_pairs(notices(spark, d)))


@query("""WITH r AS (SELECT doc_id, source, md5(text) AS ref FROM documents WHERE text <> ''),
e AS (SELECT a, b FROM (SELECT lag(doc_id) OVER w AS a, doc_id AS b, lag(source) OVER w AS s, source FROM r WINDOW w AS (PARTITION BY ref ORDER BY doc_id)) WHERE s <> source),
g AS (SELECT doc_id, source, sum(CASE WHEN s IS NULL OR s = source THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY doc_id) AS run, ref FROM (SELECT *, lag(source) OVER (PARTITION BY ref ORDER BY doc_id) AS s FROM r))
SELECT doc_id AS id, 'dup:' || min(doc_id) OVER (PARTITION BY ref, run)::VARCHAR AS possible_duplicate_group, count(*) OVER (PARTITION BY ref, run)::INT AS members FROM g QUALIFY members > 1""")
def q_dedupe_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text <> ''")
    return dedupe.duplicate_groups(dedupe.reference_links(rows, F.md5(F.col("text").cast("binary")), "doc_id"))


# ---- text, amounts, dates --------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9ऀ-ॿ ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM documents")
def q_title_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalise_title(F.col("text")).alias("title"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def q_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round(p_retailprice * 1e7, 2) WHEN 1 THEN round(p_retailprice * 1e5, 2) WHEN 2 THEN p_retailprice END AS amount FROM part")
def q_parse_amount(spark: SparkSession, d: str) -> DataFrame:
    price = F.format_string("%.2f", "p_retailprice")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Value Rs. "), price, F.lit(" Crore only"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("about "), price, F.lit(" lakhs")))
    raw = raw.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("₹ "), price)).otherwise(F.concat(F.lit("no. "), price))
    return table(spark, d, "part").select("p_partkey", amounts.parse_amount(raw).alias("amount"))


@query("""SELECT p_partkey, CASE WHEN v >= 1e7 THEN '₹' || printf('%.2f', v / 1e7) || ' Cr' WHEN v >= 1e5 THEN '₹' || printf('%.2f', v / 1e5) || ' L' ELSE '₹' || format('{:,}', round(v)::BIGINT) END AS shown
FROM (SELECT p_partkey, p_partkey * p_partkey * 17.0::DOUBLE + 0.37 AS v FROM part)""")
def q_format_compact(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("p_partkey") * F.col("p_partkey") * F.lit(17.0) + F.lit(0.37)
    return table(spark, d, "part").select("p_partkey", amounts.format_compact(value).alias("shown"))


@query(sql("SELECT id, strftime(closing_at - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS parsed FROM n"))
def q_parse_date(spark: SparkSession, d: str) -> DataFrame:
    rows = notices(spark, d)
    patterns = ("dd-MMM-yyyy hh:mm a", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy", "d-M-yyyy")
    raw = F.lit(None).cast("string")
    for i, pattern in enumerate(patterns):
        raw = F.when(F.col("id") % len(patterns) == i, F.date_format("closing_at", pattern)).otherwise(raw)
    return rows.select("id", F.date_format(dates.parse_datetime(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(sql("SELECT id, floor(s / 86400)::INT AS floor_days, ceil(s / 86400)::INT AS ceil_days, CASE WHEN ceil(s / 86400) < 0 THEN 'closed' WHEN ceil(s / 86400) <= 3 THEN 'urgent' WHEN ceil(s / 86400) <= 7 THEN 'soon' ELSE 'later' END AS bucket FROM (SELECT id, date_diff('second', now, closing_at)::DOUBLE + (id % 86400) AS s FROM n)"))
def q_deadlines(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("closing_at") + F.make_dt_interval(secs=F.col("id") % 86400)
    return notices(spark, d).select("id", dates.days_until(at, now()).alias("floor_days"), dates.days_remaining(at, now()).alias("ceil_days"), dates.deadline_bucket(at, now()).alias("bucket"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[ \t\r]+', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') AS t FROM a)
SELECT doc_id, nullif(CASE WHEN length(t) > 8000 THEN regexp_replace(t[:8000], '[\s\p{Z}\x{85}]+$', '') || '…' ELSE t END, '') AS clean FROM b""")
def q_clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts without entities, so that SQL can follow; the surveyed rule cuts at 8,000 characters."""
    return table(spark, d, "documents").select("doc_id", text.squeeze_text(F.col("text")).alias("clean"))


def _canonical(spark: SparkSession, d: str, fresh: bool) -> DataFrame:
    """Customers as canonical rows, as stored and as scraped anew, with nulls, empty arrays and awards in turn."""
    k = F.col("c_custkey")
    every = lambda n, c: F.when(k % n != 0, c)
    document = F.struct(F.concat(F.lit("new " if fresh else "old "), "c_name").alias("title"), F.lit(None).cast("string").alias("type"), F.col("c_name").alias("source_url"), k.cast("long").alias("file_size"), F.lit(None).cast("string").alias("hash"), F.lit(False).alias("text_extracted"))
    award = F.struct(F.col("c_mktsegment").alias("winning_bidder"), every(4, F.col("c_acctbal")).alias("award_value"), F.lit(None).cast("timestamp").alias("awarded_at"), F.lit(None).cast("string").alias("source_url"))
    when = F.lit("2026-02-02 00:00:00" if fresh else "2026-01-01 00:00:00").cast("timestamp")
    values = {
        "schema_version": F.lit("1.0.0"), "canonical_id": k.cast("string"), "identity.source": F.lit("new" if fresh else "old"),
        "procurement.title": every(3, F.concat(F.lit("Title "), "c_name")) if fresh else F.concat(F.lit("Title "), "c_name"),
        "procurement.category": F.col("c_mktsegment") if fresh else every(2, F.col("c_mktsegment")), "financial.estimated_value": every(5, k + 1) if fresh else k,
        "documents": F.when(k % 4 == 0, F.slice(F.array(document), 1, 0)).when(k % 4 == 1, F.array(document)) if fresh else F.array(document), "status": F.lit("closed") if fresh else F.when(k % 6 == 0, "closed").otherwise("active"),
        "possible_duplicate_group": F.when(k % 2 == 0, "").otherwise("dup:new") if fresh else F.lit("dup:old"), "provenance.official_source_url": F.lit("new" if fresh else "old"), "provenance.scraped_at": when,
        "provenance.first_seen_at": when, "provenance.last_seen_at": when, "provenance.parser_version": F.lit("2" if fresh else "1"), "award": F.when(k % 7 == 0, award) if fresh else F.lit(None),
    }
    rows = table(spark, d, "customer").where(k % 10 != 9 if fresh else k % 10 != 8)
    return rows.select(*canonical_columns(values))


@query("""SELECT k AS id, NOT has_old AS is_new, title, category, value, documents, award, CASE WHEN has_new THEN 'closed' WHEN k % 6 = 0 THEN 'closed' ELSE 'active' END AS status, CASE WHEN has_old AND (NOT has_new OR k % 2 = 0) THEN 'dup:old' WHEN k % 2 = 0 THEN '' ELSE 'dup:new' END AS dup,
 CASE WHEN has_old THEN 'old' ELSE 'new' END AS source, CASE WHEN NOT has_old THEN '2026-02-02' ELSE '2026-01-01' END AS first_seen, CASE WHEN has_old AND has_new THEN '2026-03-03' WHEN has_new THEN '2026-02-02' ELSE '2026-01-01' END AS last_seen, CASE WHEN has_new THEN '2' ELSE '1' END AS parser, has_old AND has_new AS changed
FROM (SELECT c_custkey AS k, k % 10 <> 8 AS has_old, k % 10 <> 9 AS has_new,
 CASE WHEN has_old OR k % 3 <> 0 THEN 'Title ' || c_name END AS title, CASE WHEN has_new OR k % 2 <> 0 THEN c_mktsegment END AS category, CASE WHEN has_new AND k % 5 <> 0 THEN k + 1 WHEN has_old THEN k END::DOUBLE AS value,
 CASE WHEN has_new AND k % 4 = 1 THEN 'new ' || c_name WHEN has_old THEN 'old ' || c_name WHEN k % 4 = 0 THEN '' END AS documents, CASE WHEN has_new AND k % 7 = 0 THEN c_mktsegment || CASE WHEN k % 4 <> 0 THEN ' with value' ELSE '' END END AS award FROM customer)""")
def q_merge_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Nested rows merged whole: nulls and empty arrays blank nothing, awards are replaced, the first sighting stays."""
    rows = merge.merge_canonical(_canonical(spark, d, False), _canonical(spark, d, True), F.lit("2026-03-03 00:00:00"))
    day = lambda c: F.date_format(f"provenance.{c}", "yyyy-MM-dd")
    award = F.concat("award.winning_bidder", F.when(F.col("award.award_value").isNotNull(), " with value").otherwise(""))
    return rows.select(
        F.col("canonical_id").cast("long").alias("id"), "is_new", F.col("procurement.title").alias("title"), F.col("procurement.category").alias("category"), F.col("financial.estimated_value").alias("value"),
        F.array_join(F.transform("documents", lambda x: x["title"]), ",").alias("documents"), award.alias("award"), "status", F.col("possible_duplicate_group").alias("dup"), F.col("identity.source").alias("source"),
        day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), F.col("provenance.parser_version").alias("parser"), "changed",
    )


# ---- geography -------------------------------------------------------------------------------------------------------


#: What titles name, and the state, district and evidence that have to be told from it.
_PLANTED = (
    ("Kerala", "Kerala", None, "state:kerala"), ("TAMIL NADU", "Tamil Nadu", None, "state:tamil nadu"), ("New Delhi", None, None, None), ("Orissa", "Odisha", None, "state:orissa"),
    ("Pune", "Maharashtra", "Pune", "place:pune"), ("the Old Lighthouse and Pilot Station at Vizhinjam Point", "Kerala", None, "place:old lighthouse and pilot station at vizhinjam point"),
    ("Nasik", "Maharashtra", "Nashik", "place:nasik"), ("Aurangabad", None, None, None), ("Pune - 411001", "Maharashtra", "Pune", "pincode,place:pune"), ("Sultanpur", None, None, None),
    ("Pune and Nagpur", "Maharashtra", None, "place:nagpur,place:pune"), ("Pune for Kochi", None, None, None), ("Tender-110025", None, None, None), ("PIN code no.: 403 001", "Goa", None, "pincode"),
    ("Kochi & Kalyan", "Kerala", "Ernakulam", "place:kochi"), ("Punjab National Bank", None, None, None),
)
_PLACES = (("Kochi", "Kerala", "Ernakulam"), ("Sultanpur", "Uttar Pradesh", None), ("Old Lighthouse and Pilot Station at Vizhinjam Point", "Kerala", None))


@query(sql("SELECT id, state, district, evidence FROM (SELECT id, (id % 16)::INT AS k FROM n) JOIN p USING (k) WHERE p.state IS NOT NULL",
           "p(k, state, district, evidence) AS (VALUES " + ", ".join("(" + ", ".join([str(k), *("NULL" if x is None else f"'{x}'" for x in row[1:])]) + ")" for k, row in enumerate(_PLANTED)) + ")"))
def q_geo_infer(spark: SparkSession, d: str) -> DataFrame:
    """Places planted in titles: states, districts, a name of eight words, PINs, weak, ambiguous and several names."""
    named = F.get(F.array(*[F.lit(p[0]) for p in _PLANTED]), F.pmod("id", F.lit(len(_PLANTED))).cast("int"))
    rows = notices(spark, d).select("id", F.concat(F.lit("Road works at "), named).alias("title"), "authority")
    places = spark.createDataFrame(_PLACES, "name string, state string, district string")
    return geo.infer(rows, geo.gazetteer(spark, places), {"title": "work", "authority": "org"}).withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH p AS (SELECT DISTINCT (o_orderkey % 900 + 100)::VARCHAR || ['000', '036', '037', '210', '241', '550', '560', '999'][(o_orderkey // 900 % 8 + 1)::INT] AS pin FROM orders),
d AS (SELECT pin, pin[:3]::INT AS t, pin[:2]::INT AS z, pin::INT AS n FROM p)
SELECT pin, CASE WHEN t = 160 THEN CASE WHEN n <= 160036 THEN 'Chandigarh' ELSE 'Punjab' END WHEN t = 396 THEN CASE WHEN n BETWEEN 396210 AND 396240 THEN 'Dadra and Nagar Haveli and Daman and Diu' ELSE 'Gujarat' END
WHEN n // 10 = 68255 THEN 'Lakshadweep' WHEN t IN (605, 244) THEN NULL WHEN t = 403 THEN 'Goa' WHEN t = 194 THEN 'Ladakh' WHEN t IN (246, 248, 249, 262, 263) THEN 'Uttarakhand' WHEN t = 737 THEN 'Sikkim'
WHEN t = 744 THEN 'Andaman and Nicobar Islands' WHEN t BETWEEN 790 AND 792 THEN 'Arunachal Pradesh' WHEN t IN (793, 794) THEN 'Meghalaya' WHEN t = 795 THEN 'Manipur' WHEN t = 796 THEN 'Mizoram'
WHEN t IN (797, 798) THEN 'Nagaland' WHEN t = 799 THEN 'Tripura' WHEN t IN (814, 815, 816, 822) OR t BETWEEN 825 AND 829 THEN 'Jharkhand'
WHEN z = 11 THEN 'Delhi' WHEN z IN (12, 13) THEN 'Haryana' WHEN z BETWEEN 14 AND 16 THEN 'Punjab' WHEN z = 17 THEN 'Himachal Pradesh' WHEN z IN (18, 19) THEN 'Jammu and Kashmir' WHEN z BETWEEN 20 AND 28 THEN 'Uttar Pradesh'
WHEN z BETWEEN 30 AND 34 THEN 'Rajasthan' WHEN z BETWEEN 36 AND 39 THEN 'Gujarat' WHEN z BETWEEN 40 AND 44 THEN 'Maharashtra' WHEN z BETWEEN 45 AND 48 THEN 'Madhya Pradesh' WHEN z = 49 THEN 'Chhattisgarh'
WHEN z = 50 THEN 'Telangana' WHEN z BETWEEN 51 AND 53 THEN 'Andhra Pradesh' WHEN z BETWEEN 56 AND 59 THEN 'Karnataka' WHEN z BETWEEN 60 AND 64 THEN 'Tamil Nadu' WHEN z BETWEEN 67 AND 69 THEN 'Kerala'
WHEN z BETWEEN 70 AND 74 THEN 'West Bengal' WHEN z BETWEEN 75 AND 77 THEN 'Odisha' WHEN z = 78 THEN 'Assam' WHEN z IN (80, 81, 82, 84, 85) THEN 'Bihar' WHEN z = 83 THEN 'Jharkhand' END AS state FROM d""")
def q_geo_pin(spark: SparkSession, d: str) -> DataFrame:
    """PINs made of the keys of orders: every three-digit prefix, with eight endings."""
    k = F.col("o_orderkey")
    ends = F.array(*[F.lit(e) for e in ("000", "036", "037", "210", "241", "550", "560", "999")])
    pin = F.concat((k % 900 + 100).cast("string"), F.get(ends, (F.floor(k / 900) % 8).cast("int")))
    return table(spark, d, "orders").select(pin.alias("pin")).distinct().select("pin", geo.pin_state(F.col("pin")).alias("state"))


# ---- matching and search ---------------------------------------------------------------------------------------------

_PROFILE = match.Profile(industries=("machinery",), products=("urgent",), states=("NATION_3", "NATION_5"), min_size=100_000, max_size=300_000, msme=True)
_SCORE = """s AS (SELECT id, (CASE WHEN contains(lower(category), 'machinery') OR contains(lower(title), 'machinery') OR contains(lower(category), 'urgent') OR contains(lower(title), 'urgent') THEN 30 ELSE 0 END
 + CASE WHEN state IN ('NATION_3', 'NATION_5') THEN 20 ELSE 0 END + CASE WHEN value BETWEEN 100000 AND 300000 THEN 25 ELSE 0 END + 7
 + CASE WHEN date_diff('second', now, closing_at) >= 604800 THEN 10 WHEN date_diff('second', now, closing_at) >= 259200 THEN 5 ELSE 0 END)::INT AS score FROM n)"""


@query(sql("SELECT id, score FROM s", _SCORE))
def q_match_score(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).select("id", match.match(_PROFILE, now())["score"].alias("score"))


@query(sql("SELECT CASE WHEN score >= 60 THEN 'strong' ELSE 'maybe' END AS bucket, count(*) AS n, max(score)::INT AS best FROM s WHERE score >= 35 GROUP BY 1", _SCORE))
def q_for_you(spark: SparkSession, d: str) -> DataFrame:
    rows = notices(spark, d).select(match.match(_PROFILE, now())["score"].alias("score"))
    return rows.withColumn("bucket", match.bucket(F.col("score"))).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query(sql("""SELECT y.id, (CASE WHEN y.state IS NOT DISTINCT FROM x.state THEN 2 ELSE 0 END + CASE WHEN y.category IS NOT DISTINCT FROM x.category THEN 3 ELSE 0 END + CASE WHEN y.authority IS NOT DISTINCT FROM x.authority THEN 2 ELSE 0 END
 + CASE WHEN len(list_filter(string_split(lower(y.title), ' '), lambda w: contains(lower(x.title), w))) > 2 THEN 2 ELSE 0 END)::INT AS points
FROM n x, n y WHERE x.id = 7 AND y.id <> 7 AND y.status = 'active' AND points >= 4 ORDER BY points DESC, y.id LIMIT 5"""))
def q_similar(spark: SparkSession, d: str) -> DataFrame:
    return match.similar(notices(spark, d), 7)


def _bm25(field: str, term: str) -> str:
    return f"CASE WHEN n_{term} > 0 THEN ln(1 + (docs - df_{term} + 0.5) / (df_{term} + 0.5)) * (0.5 + n_{term} * 2.2 / (n_{term} + 1.2 * (0.3 + 0.7 * len / mean))) ELSE 0 END"


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w)::DOUBLE AS len, len(list_filter(w, lambda x: starts_with(x, 'licens'))) AS n_licens, len(list_filter(w, lambda x: starts_with(x, 'version'))) AS n_version FROM t),
s AS (SELECT count(*)::DOUBLE AS docs, avg(len) AS mean, count(*) FILTER (n_licens > 0) AS df_licens, count(*) FILTER (n_version > 0) AS df_version FROM c)
SELECT doc_id, ((n_licens > 0)::INT + (n_version > 0)::INT)::INT AS terms, round({_bm25('text', 'licens')} + {_bm25('text', 'version')}, 6) AS score FROM c, s WHERE n_licens > 0 OR n_version > 0""")
def q_search_bm25(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(table(spark, d, "documents"), "licens version", {"text": 1.0}, key="doc_id")
    return found.withColumn("score", F.round("score", 6))


@query(sql("SELECT id, value FROM n WHERE lower(state) = 'nation_4' AND contains(lower(concat_ws(' ', title, authority, category, ref, tender_number, id::VARCHAR)), 'furniture') AND value >= 200000 AND closing_at BETWEEN now AND now + INTERVAL 300 DAY"))
def q_nlq_query(spark: SparkSession, d: str) -> DataFrame:
    """A typed query, parsed into conditions and run."""
    asked = search.parse_query("furniture in NATION_4 above 2 lakh closing within 300 days", states={"NATION_4": "NATION_4"})
    return filters.run_query(notices(spark, d), asked, now()).select("id", "value")


# ---- health ----------------------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A run for each event type and day; zeros and failures are planted by day of month."""
    per = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("run_at")).agg(F.count("*").cast("int").alias("n"))
    day = F.dayofmonth("run_at") + F.length("source")
    return per.select("source", "run_at", (day % 5 != 0).alias("ok"), F.when((day % 7 == 0) | (day % 5 == 0), 0).otherwise(F.col("n")).alias("discovered"), (day % 13 == 0).alias("captcha"))


_RUNS = """WITH r AS (SELECT source, run_at, d % 5 <> 0 AS ok, CASE WHEN d % 7 = 0 OR d % 5 = 0 THEN 0 ELSE c END AS discovered, d % 13 = 0 AS captcha FROM (
 SELECT event_type AS source, ts::DATE AS run_at, count(*)::INT AS c, day(ts::DATE) + length(event_type) AS d FROM events GROUP BY ALL)),
g AS (SELECT *, sum((ok AND discovered > 0)::INT) OVER (PARTITION BY source ORDER BY run_at) AS island, coalesce(sum((ok AND discovered > 0)::INT) OVER (PARTITION BY source ORDER BY run_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM r),
f AS (SELECT *, sum((NOT (ok AND discovered > 0))::INT) OVER (PARTITION BY source, island ORDER BY run_at)::INT AS failures FROM g),
h AS (SELECT *, (ok AND discovered = 0 AND prior >= 3) OR (NOT ok AND failures >= 2) AS degraded FROM f)
"""


@query(_RUNS + "SELECT source, strftime(run_at, '%Y-%m-%d') AS run_at, prior::INT AS prior_nonzero, degraded FROM h")
def q_health_baseline(spark: SparkSession, d: str) -> DataFrame:
    return health.with_history(_runs(spark, d)).select("source", F.date_format("run_at", "yyyy-MM-dd").alias("run_at"), "prior_nonzero", "degraded")


@query(_RUNS + "SELECT source, strftime(run_at, '%Y-%m-%d') AS run_at, failures AS consecutive_failures FROM h")
def q_consecutive_failures(spark: SparkSession, d: str) -> DataFrame:
    return health.with_history(_runs(spark, d)).select("source", F.date_format("run_at", "yyyy-MM-dd").alias("run_at"), "consecutive_failures")


@query(_RUNS.replace("WITH r", "WITH RECURSIVE r", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_at) AS i FROM h),
s(source, i, status) AS (SELECT DISTINCT source, 0::BIGINT, 'EXPERIMENTAL' FROM o UNION ALL SELECT o.source, o.i, CASE WHEN captcha THEN 'CAPTCHA_LIMITED' WHEN degraded THEN 'DEGRADED'
 WHEN ok AND discovered > 0 THEN CASE WHEN s.status IN ('DEGRADED', 'TEMPORARILY_BROKEN', 'CAPTCHA_LIMITED', 'EXPERIMENTAL') THEN 'ACTIVE' ELSE s.status END WHEN ok THEN s.status ELSE 'TEMPORARILY_BROKEN' END FROM s JOIN o ON o.source = s.source AND o.i = s.i + 1)
SELECT source, arg_max(status, i) AS status, max(i)::INT AS runs FROM s GROUP BY 1""")
def q_status_fold(spark: SparkSession, d: str) -> DataFrame:
    return health.status_fold(health.with_history(_runs(spark, d)))


@query(_RUNS + "SELECT source, count(*) FILTER (NOT degraded AND ok AND discovered > 0) AS healthy, count(*) FILTER (degraded) AS degraded, strftime(max(run_at) FILTER (ok AND discovered > 0), '%Y-%m-%d') AS last_success FROM h GROUP BY 1")
def q_portal_health(spark: SparkSession, d: str) -> DataFrame:
    runs = health.with_history(_runs(spark, d))
    good = F.col("ok") & (F.col("discovered") > 0)
    last = F.date_format(F.max(F.when(good, F.col("run_at"))), "yyyy-MM-dd").alias("last_success")
    return runs.groupBy("source").agg(F.count_if(good & ~F.col("degraded")).alias("healthy"), F.count_if("degraded").alias("degraded"), last)


# ---- parsing, documents, JSON ----------------------------------------------------------------------------------------


@query()
def q_chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of whole documents without the surveyed caps (60 chunks of at most 2,800 characters; longer ones are split here); the fold depends on order, so tests hold golden values instead of SQL."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text")
    return chunks.chunks(pages, most=None)


@query("SELECT page_id, list_distinct(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS found FROM pages")
def q_page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_sort(listings.links(F.col("html"))).alias("found"))


ORACLE_SQL["q_page_links"] = ORACLE_SQL["q_page_links"].replace("list_distinct(", "list_sort(list_distinct(").replace(", 1)) AS", ", 1))) AS")


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def q_page_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", listings.page_title(F.col("html")).alias("title"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE props END AS repaired FROM events")
def q_json_repair(spark: SparkSession, d: str) -> DataFrame:
    fence = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone"))
    raw = F.when(F.col("event_id") % 4 == 0, fence).when(F.col("event_id") % 4 == 1, F.col("props")).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Sure! "), "props", F.lit(" ok"))).otherwise("no json")
    return table(spark, d, "events").select("event_id", Q.repair_json(raw).alias("repaired"))


@query(sql("SELECT id, list_filter([CASE WHEN NOT coalesce(value > 0, FALSE) THEN 'value' END, CASE WHEN NOT coalesce(status IN ('active', 'closed'), FALSE) THEN 'status' END, CASE WHEN NOT coalesce(length(title) <= 40, FALSE) THEN 'title' END], lambda x: x IS NOT NULL) AS broken FROM n"))
def q_validate(spark: SparkSession, d: str) -> DataFrame:
    rules = {"value": F.col("value") > 0, "status": F.col("status").isin("active", "closed"), "title": F.length("title") <= 40}
    return notices(spark, d).select("id", violations(rules).alias("broken"))


_EVENT_SCHEMA = {
    "type": "object", "required": ["k", "user"], "additionalProperties": False,
    "properties": {"k": {"type": "integer", "minimum": 10}, "user": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "kind": {"enum": ["click", "view", "purchase"]}}}, "tags": {"type": "array", "items": {"type": "string"}}},
}


@query("""WITH e AS (SELECT event_id, (props->>'$.k')::INT AS k, event_type FROM events)
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '$.user required' WHEN event_id % 11 = 0 THEN '$.more additionalProperties' WHEN k < 10 THEN '$.k minimum' WHEN event_id % 5 = 0 THEN '$.user.id required'
 WHEN event_type NOT IN ('click', 'view', 'purchase') THEN '$.user.kind enum' WHEN event_id % 3 = 0 THEN '$.tags[1] type' END AS shown,
 (event_id % 7 = 0)::INT + (event_id % 11 = 0)::INT + (k < 10)::INT + (event_id % 7 <> 0 AND event_id % 5 = 0)::INT + (event_id % 7 <> 0 AND event_type NOT IN ('click', 'view', 'purchase'))::INT + (event_id % 3 = 0)::INT AS broken FROM e""")
def q_json_schema(spark: SparkSession, d: str) -> DataFrame:
    """A JSON Schema over records with planted errors: how many, and the one to show."""
    key, k = F.col("event_id"), F.get_json_object("props", "$.k")
    user = F.concat(F.lit(',"user":{'), F.when(key % 5 != 0, F.concat(F.lit('"id":'), key.cast("string"), F.lit(","))).otherwise(""), F.lit('"kind":"'), F.col("event_type"), F.lit('"}'))
    body = F.concat(F.lit('{"k":'), k, F.when(key % 7 != 0, user).otherwise(""), F.when(key % 3 == 0, ',"tags":["a",1]').otherwise(',"tags":[]'), F.when(key % 11 == 0, ',"more":null').otherwise(""), F.lit("}"))
    rows = once(table(spark, d, "events").select("event_id", body.alias("body")), found=jsonrules.errors(F.col("body"), _EVENT_SCHEMA))
    shown = jsonrules.best(F.col("found"))
    return rows.select("event_id", F.concat(shown["path"], F.lit(" "), shown["rule"]).alias("shown"), F.size("found").alias("broken"))


@query(sql("SELECT id, ref, title FROM n WHERE id = (SELECT max(id) FROM n)"))
def q_point_read(spark: SparkSession, d: str) -> DataFrame:
    """One row of a store in buckets by its key."""
    rows = notices(spark, d).select("id", "ref", "title")
    name = f"keyed_{uuid.uuid4().hex}"
    store = records.write_keyed(rows, f"{scratch_root(spark)}/{name}", name, "id", 16)
    return records.point_read(spark, store, rows.agg(F.max("id")).first()[0], "id")


@query("""WITH t AS (SELECT event_type AS source, (count(*) // 10)::INT AS pages FROM events GROUP BY 1), q AS (SELECT *, least(pages, greatest(1, floor(120 * pages / sum(pages) OVER ())))::INT AS quota FROM t)
SELECT DISTINCT source, ((floor(i * (pages / quota))::BIGINT + 3) % pages + 1)::INT AS page FROM (SELECT *, unnest(range(0, quota)) AS i FROM q)""")
def q_page_plan(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.floor(F.count("*") / 10).cast("int").alias("pages"))
    return listings.planned_pages(totals, 120, 3)


@query("""WITH r AS (SELECT l_orderkey AS id, lower(l_returnflag) AS flag, l_linenumber AS o, l_quantity FROM lineitem)
SELECT id, CASE flag WHEN 'a' THEN 'procurement.title' ELSE 'work.period_of_work_days' END AS path, arg_min(l_quantity::INT, o)::VARCHAR AS value FROM (SELECT id, flag, l_quantity, min(o) OVER (PARTITION BY id, flag) AS m, o FROM r WHERE flag IN ('a', 'n')) WHERE o = m GROUP BY 1, 2""")
def q_label_fields(spark: SparkSession, d: str) -> DataFrame:
    """Label and value rows mapped to fields; the first value of a field stays."""
    label = F.when(F.col("l_returnflag") == "A", "Tender Title :").when(F.col("l_returnflag") == "N", "Period of  Work :").otherwise("Other")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    value = F.col("q").cast("int").cast("string")
    rows = rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ordinal"), label.alias("label"), value.alias("value"))
    return listings.label_fields(rows).select("id", "path", "value")


ORACLE_SQL["q_label_fields"] = """WITH r AS (SELECT l_orderkey AS id, l_returnflag AS flag, l_linenumber AS o, min(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT id, CASE flag WHEN 'A' THEN 'procurement.title' ELSE 'work.period_of_work_days' END AS path, arg_min(q::INT, o)::VARCHAR AS value FROM r WHERE flag IN ('A', 'N') GROUP BY ALL"""


@query(sql("SELECT source, min(id) AS id, ref FROM n GROUP BY source, ref"))
def q_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = notices(spark, d).withColumn("key", F.concat_ws("|", "source", "ref"))
    return listings.first_occurrence(rows, "key", "id").select("source", "id", "ref")


# ---- streaming -------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(d + "/events.parquet*")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def q_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First-key dedup of the stream; the delay spans the data, so it equals the batch result."""
    out = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    found = incremental.first_by_key(_stream(spark, d), ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type")
    found.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/data")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def q_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Keyed upsert by micro-batch; equals the latest row of each key."""
    out = f"{scratch_root(spark)}/upsert-{uuid.uuid4().hex}"
    rows = _stream(spark, d).select("user_id", "event_id", "event_type")

    def merged(store: DataFrame | None, batch: DataFrame) -> DataFrame:
        return incremental.latest_by_key(batch if store is None else store.unionByName(batch), ["user_id"], "event_id")

    incremental.upsert_stream(rows, f"{out}/store", ["user_id"], merged, f"{out}/state").awaitTermination()
    return incremental.stored(spark, f"{out}/store").select("user_id", "event_id", "event_type")
