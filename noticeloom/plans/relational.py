"""Filters, ranking, aggregates, windows, joins and set operations over notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import days_until
from ..operators import filters as P
from ..operators import overlay, publish
from ..operators import queue as Q
from ..operators.ranks import with_places
from .notices import CORRIGENDA, notices, now, sql, table, with_corrigenda

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

BAND = P.Query(keywords="supply household", state="NATION_3", min_value=100_000, max_value=400_000)


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLE_SQL[function.__name__] = oracle
        return function

    return register


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query(sql("""SELECT id, state, category, value, (SELECT count(*) FROM n WHERE lower(state) = 'nation_3' AND value IS NULL AND contains(lower(concat_ws(' ', title, authority, category, ref, tender_number, id::VARCHAR)), 'supply') AND contains(lower(concat_ws(' ', title, authority, category, ref, tender_number, id::VARCHAR)), 'household')) AS hidden_unknown
FROM n WHERE lower(state) = 'nation_3' AND value BETWEEN 100000 AND 400000 AND contains(lower(concat_ws(' ', title, authority, category, ref, tender_number, id::VARCHAR)), 'supply') AND contains(lower(concat_ws(' ', title, authority, category, ref, tender_number, id::VARCHAR)), 'household') ORDER BY value DESC, id"""))
def q_structured_filter(spark: SparkSession, d: str) -> DataFrame:
    found = P.run_query(notices(spark, d), BAND, now())
    return found.orderBy(*P.ordering("value")).select("id", "state", "category", "value", "hidden_unknown")


@query(sql("SELECT id, value, CASE WHEN value IS NULL THEN 'unknown' WHEN value >= 50000 AND value <= 250000 THEN 'ok' ELSE 'fail' END AS verdict FROM n"))
def q_value_verdict(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).select("id", "value", P.value_verdict(P.Query(min_value=50_000, max_value=250_000)).alias("verdict"))


@query(sql("SELECT count(*) FILTER (value >= 50000) AS shown, count(*) FILTER (value IS NULL) AS hidden_unknown, count(*) FILTER (value < 50000) AS failed FROM n WHERE region = 'ASIA'"))
def q_hidden_unknown_count(spark: SparkSession, d: str) -> DataFrame:
    rows = notices(spark, d).where("region = 'ASIA'").withColumn("v", P.value_verdict(P.Query(min_value=50_000)))
    count = lambda v: F.count_if(F.col("v") == v)
    return rows.agg(count("ok").alias("shown"), count("unknown").alias("hidden_unknown"), count("fail").alias("failed"))


@query(sql("SELECT id, strftime(closing_at, '%Y-%m-%d %H:%M:%S') AS closing_at FROM n WHERE closing_at BETWEEN now AND now + INTERVAL 7 DAY"))
def q_closing_within(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).where(P.closing_within(now(), 7)).select("id", day("closing_at"))


@query(sql("SELECT id, strftime(closing_at, '%Y-%m-%d %H:%M:%S') AS closing_at FROM n WHERE closing_at >= now AND closing_at <= TIMESTAMP '1998-01-31 18:29:59.999'"))
def q_closing_month_ist(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).where(P.closing_this_month(now())).select("id", day("closing_at"))


@query(sql("SELECT id, CASE WHEN status = 'active' AND closing_at < now THEN 'closed' ELSE status END AS effective FROM n"))
def q_effective_status(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).select("id", P.effective_status(now()).alias("effective"))


@query(sql("SELECT id, source FROM n WHERE closing_at IS NULL OR closing_at >= now - INTERVAL 30 DAY"))
def q_retention(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).where(P.within_retention(now(), 30)).select("id", "source")


@query(sql("SELECT id FROM n WHERE date_diff('second', first_seen_at, now) BETWEEN -3600 AND 172800"))
def q_recently_discovered(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).where(P.recently_discovered(now())).select("id")


@query(sql("""SELECT 'new' AS mode, id FROM k WHERE date_diff('second', first_seen_at, now) BETWEEN -3600 AND 172800 UNION ALL SELECT 'changed', id FROM k WHERE corrigenda_count > 2
UNION ALL SELECT 'closing', id FROM k WHERE closing_at BETWEEN now AND now + INTERVAL 7 DAY""", CORRIGENDA))
def q_mode_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = with_corrigenda(spark, d, notices(spark, d)).withColumn("corrigenda_count", F.col("corrigenda_count") - 2)
    modes = F.array_compact(F.array(*[F.when(P.mode_scope(m, now()), m) for m in ("new", "changed", "closing")]))
    return rows.select(F.explode(modes).alias("mode"), "id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version')")
def q_keyword_and(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(P.keyword_all("license version", F.lower("text"))).select("doc_id")


@query("""WITH s AS (SELECT doc_id, contains(lower(text), 'license')::INT + contains(lower(text), 'zzzabsent')::INT AS hits, contains(lower(text), 'license') AND contains(lower(text), 'zzzabsent') AS every FROM documents)
SELECT doc_id, hits FROM s WHERE every OR (hits > 0 AND NOT EXISTS (SELECT 1 FROM s WHERE every))""")
def q_keyword_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return P.relaxed(table(spark, d, "documents"), "license zzzabsent", F.lower("text")).select("doc_id", "hits")


@query(sql("SELECT id, ref FROM n WHERE lower(trim(id::VARCHAR)) = 'ref/117' OR lower(trim(ref)) = 'ref/117' OR lower(trim(tender_number)) = 'ref/117'"))
def q_exact_match(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).where(P.exact_match(" REF/117 ")).select("id", "ref")


def _placed(rows: DataFrame, sort: str) -> DataFrame:
    return with_places(rows, [], P.ordering(sort), ["id"]).select("place", "id")


@query(sql("SELECT row_number() OVER (ORDER BY closing_at ASC NULLS LAST, id)::INT AS place, id FROM n"))
def q_sort_closing(spark: SparkSession, d: str) -> DataFrame:
    return _placed(notices(spark, d), "closing")


@query(sql("SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, id)::INT AS place, id FROM n"))
def q_sort_value(spark: SparkSession, d: str) -> DataFrame:
    return _placed(notices(spark, d), "value")


@query(sql("SELECT row_number() OVER (ORDER BY first_seen_at DESC NULLS LAST, id)::INT AS place, id FROM n"))
def q_sort_newest(spark: SparkSession, d: str) -> DataFrame:
    return _placed(notices(spark, d), "newest")


@query(sql("SELECT id, title FROM n WHERE status = 'active' ORDER BY id LIMIT 100"))
def q_page_limit(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).where("status = 'active'").orderBy("id").limit(100).select("id", "title")


@query(sql("SELECT source, status, count(*) AS n, (CASE WHEN source IS NULL THEN 'status' ELSE 'source' END) AS dimension FROM n GROUP BY GROUPING SETS ((source), (status))"))
def q_stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Counts by source and by status in one pass over one shuffle."""
    rows = notices(spark, d)
    out = rows.groupingSets([[F.col("source")], [F.col("status")]], "source", "status").agg(F.count("*").alias("n"))
    return out.select("source", "status", "n", F.when(F.col("source").isNull(), "status").otherwise("source").alias("dimension"))


@query(sql("""SELECT count(*) AS total, count(*) FILTER (value <> 0) AS value_known, sum(value::DECIMAL(18,2))::DOUBLE AS value_total,
count(*) FILTER (status = 'active' AND floor(date_diff('second', now, closing_at) / 86400.0) BETWEEN 0 AND 7) AS closing_soon FROM n"""))
def q_stats_summary(spark: SparkSession, d: str) -> DataFrame:
    soon = (F.col("status") == "active") & days_until(F.col("closing_at"), now()).between(0, 7)
    return notices(spark, d).agg(
        F.count("*").alias("total"), F.count_if(F.col("value") != 0).alias("value_known"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value_total"), F.count_if(soon).alias("closing_soon"),
    )


@query(sql("SELECT coalesce(source, 'all') AS source, count(*) AS fetched, count(*) FILTER (id % 5 = 0) AS new, sum(corrigenda_count)::BIGINT AS changed FROM k GROUP BY ROLLUP (source)", CORRIGENDA))
def q_rollup_source(spark: SparkSession, d: str) -> DataFrame:
    rows = with_corrigenda(spark, d, notices(spark, d)).rollup("source")
    out = rows.agg(F.count("*").alias("fetched"), F.count_if(F.col("id") % 5 == 0).alias("new"), F.sum("corrigenda_count").alias("changed"))
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


@query(sql("""SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active' AND closing_at >= TIMESTAMP '1997-12-31 18:30:00' AND closing_at < TIMESTAMP '1998-01-01 18:30:00') AS closing_today,
count(*) FILTER (first_seen_at >= TIMESTAMP '1997-12-31 18:30:00' AND first_seen_at < TIMESTAMP '1998-01-01 18:30:00') AS added_today,
count(*) FILTER (status = 'active' AND closing_at > now AND closing_at < now + INTERVAL 7 DAY) AS closing_week, count(value) AS disclosed, sum(corrigenda_count)::BIGINT AS changes FROM k""", CORRIGENDA))
def q_home_tiles(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.dates import ist_day

    rows = with_corrigenda(spark, d, notices(spark, d))
    active, today = F.col("status") == "active", ist_day(now())
    week = (F.col("closing_at") > now()) & (F.col("closing_at") < now() + F.expr("INTERVAL 7 DAYS"))
    return rows.agg(
        F.count_if(active).alias("active"), F.count_if(active & (ist_day(F.col("closing_at")) == today)).alias("closing_today"), F.count_if(ist_day(F.col("first_seen_at")) == today).alias("added_today"),
        F.count_if(active & week).alias("closing_week"), F.count("value").alias("disclosed"), F.sum("corrigenda_count").alias("changes"),
    )


@query(sql("SELECT 'state' AS facet, state AS item FROM n WHERE state <> '' GROUP BY state UNION ALL SELECT 'category', category FROM n WHERE category <> '' GROUP BY category UNION ALL SELECT 'source', source FROM n GROUP BY source"))
def q_facets(spark: SparkSession, d: str) -> DataFrame:
    rows = notices(spark, d).select("state", "category", "source").distinct()  # few combinations, one small shuffle
    long = rows.unpivot([], ["state", "category", "source"], "facet", "item")
    return long.where("item <> ''").distinct()


@query(sql("""SELECT section, row_number() OVER (PARTITION BY section ORDER BY coalesce(value, 0) DESC, id)::INT AS place, id, value, count(*) OVER (PARTITION BY section)::INT AS total FROM (
SELECT 'new' AS section, id, value FROM n WHERE (first_seen_at + INTERVAL 330 MINUTE)::DATE = (now + INTERVAL 330 MINUTE)::DATE UNION ALL
SELECT 'closing', id, value FROM n WHERE status = 'active' AND floor(date_diff('second', now, closing_at) / 86400.0) BETWEEN 0 AND 7) QUALIFY place <= 15"""))
def q_digest_top15(spark: SparkSession, d: str) -> DataFrame:
    return publish.digest(notices(spark, d), now())


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(sql(f"""SELECT feed, row_number() OVER (PARTITION BY feed ORDER BY first_seen_at DESC NULLS LAST, id DESC)::INT AS place, id FROM (
SELECT 'all' AS feed, id, first_seen_at FROM n UNION ALL SELECT 'source-' || {_SLUG.format('source')}, id, first_seen_at FROM n UNION ALL SELECT 'state-' || {_SLUG.format('state')}, id, first_seen_at FROM n) QUALIFY place <= 200"""))
def q_feed_topk(spark: SparkSession, d: str) -> DataFrame:
    return publish.feeds(notices(spark, d)).select("feed", "place", "id")


@query(sql("""SELECT source, shard, count(*)::INT AS n, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS digest FROM (
SELECT source, id, ((row_number() OVER (PARTITION BY source ORDER BY id) - 1) // 500)::INT AS shard FROM n) GROUP BY ALL"""))
def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    return publish.manifest(notices(spark, d))


@query(sql("SELECT id, saved_at FROM n JOIN (SELECT c_custkey * 3 AS b, c_nationkey AS saved_at FROM customer) ON id = b"))
def q_bookmarks_join(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("id"), F.col("c_nationkey").alias("saved_at"))
    return overlay.bookmarked(notices(spark, d), marks).select("id", "saved_at")


@query(sql("""SELECT n.id, CASE WHEN n.id % 2 = 0 THEN n.value ELSE x.v END AS value FROM n LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem GROUP BY 1) x ON n.id = x.l_orderkey"""))
def q_detail_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A present null wins over the detail shard: the flag says whether the field was there."""
    details = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_extendedprice").alias("value"))
    rows = notices(spark, d).withColumn("has_value", F.col("id") % 2 == 0)
    return overlay.detail_overlay(rows, details, {"value": "has_value"}).select("id", "value")


@query("""WITH b AS (SELECT c_custkey AS id, 'S' || (c_custkey % 50)::VARCHAR AS name, c_mktsegment AS query, 0 AS side FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'S' || (c_custkey % 50)::VARCHAR, c_mktsegment, 1 FROM customer WHERE c_custkey % 3 = 0),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY side, id) = 1)
SELECT id, name, query FROM o QUALIFY row_number() OVER (PARTITION BY name, query ORDER BY side, id) = 1""")
def q_merge_backup(spark: SparkSession, d: str) -> DataFrame:
    saved = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("S"), (F.col("c_custkey") % 50).cast("string")).alias("name"), F.col("c_mktsegment").alias("query"))
    return overlay.merge_saved(saved.where("id % 2 = 0"), saved.where("id % 3 = 0"))


@query(sql("SELECT id, CASE WHEN regexp_matches(t, '^[=+@\\t\\r-]') THEN '''' || t ELSE t END AS title, coalesce(value::DECIMAL(18,2)::VARCHAR, '') AS value FROM (SELECT id, value, CASE id % 3 WHEN 0 THEN '=' || title WHEN 1 THEN '-' || title ELSE title END AS t FROM n)"))
def q_csv_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = notices(spark, d).withColumn("title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("="), "title")).when(F.col("id") % 3 == 1, F.concat(F.lit("-"), "title")).otherwise(F.col("title")))
    rows = rows.withColumn("value", F.col("value").cast("decimal(18,2)"))
    return rows.select("id", publish.csv_guard(F.col("title")).alias("title"), publish.csv_guard(F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("value"))


@query(sql("SELECT id, source || '_' || strftime(closing_at, '%Y') || '_' || strftime(closing_at, '%m') AS partition FROM n WHERE closing_at < now - INTERVAL 180 DAY"))
def q_archive_partition(spark: SparkSession, d: str) -> DataFrame:
    return publish.archive_partition(notices(spark, d), now(), 180).select("id", "partition")


@query(sql("""SELECT id, row_number() OVER (PARTITION BY id ORDER BY t, i)::INT AS place, event, strftime(t, '%Y-%m-%d %H:%M:%S') AS event_at FROM (
SELECT id, published_at AS t, 0 AS i, 'published' AS event FROM n UNION ALL SELECT id, first_seen_at, 1, 'seen' FROM n UNION ALL SELECT id, CASE WHEN id % 5 <> 0 THEN closing_at END, 2, 'closing' FROM n) WHERE t IS NOT NULL"""))
def q_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = notices(spark, d).withColumn("closing_at", F.when(F.col("id") % 5 != 0, F.col("closing_at")))
    return publish.timeline(rows, {"published": "published_at", "seen": "first_seen_at", "closing": "closing_at"}).select("id", "place", "event", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("event_at"))


@query(sql("""SELECT id, 'state' AS field, state AS value FROM n UNION ALL SELECT id, 'status', status FROM n UNION ALL SELECT id, 'category', category FROM n"""))
def q_field_rows(spark: SparkSession, d: str) -> DataFrame:
    return publish.field_rows(notices(spark, d), ["state", "status", "category"])


_REASONS = ("user_requested", "corrigendum", "changed", "new", "closing_soon", "historical", "extraction", "unheard of", None)


@query("""WITH d AS (SELECT doc_id, n_chars * 100000.0 AS value, (doc_id % 9)::INT AS k FROM documents),
named AS (SELECT doc_id, CASE k WHEN 0 THEN 'user_requested' WHEN 1 THEN 'corrigendum_analysis' WHEN 2 THEN 'corrigendum_analysis' WHEN 3 THEN CASE WHEN value >= 1e8 THEN 'new_high_value' ELSE 'new_tender' END
 WHEN 4 THEN 'closing_soon' WHEN 6 THEN 'document_extraction' ELSE 'historical_enrichment' END AS name FROM d)
SELECT doc_id AS id, name, list_position(['user_requested', 'corrigendum_analysis', 'new_high_value', 'new_tender', 'closing_soon', 'document_extraction', 'historical_enrichment'], name)::INT AS priority FROM named""")
def q_queue_priority(spark: SparkSession, d: str) -> DataFrame:
    """Every reason, an unknown one and none, with values on both sides of the bound."""
    reason = F.get(F.array(*[F.lit(r) for r in _REASONS]), (F.col("doc_id") % 9).cast("int"))
    name = Q.priority_name(reason, F.col("n_chars") * F.lit(100000.0))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), name.alias("name"), Q.priority(name).alias("priority"))


@query("""SELECT event_type AS task, user_id AS id, max(event_id) AS enqueued_at FROM events WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = events.event_type AND e.user_id = events.user_id AND e.event_id % 97 = 0) GROUP BY ALL""")
def q_queue_pending(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("id"), F.col("event_id").alias("line"), F.lit(1).alias("priority"), F.col("event_id").alias("enqueued_at"))
    return Q.pending(log, log.where("line % 97 = 0")).select("task", "id", "enqueued_at")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (user_id % 3 = 0) AS hits,
(sum(value::DECIMAL(18,2)) / count(*)::DECIMAL(18,2))::DOUBLE AS mean_latency_ms, count(*) FILTER (user_id % 3 = 0) / count(*) AS hit_rate FROM events GROUP BY 1""")
def q_budget_daily(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("task"), (F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 3 == 0).alias("cached"), F.col("value").alias("latency_ms"))
    out = Q.daily_budget(rows).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return out


ORACLE_SQL["q_budget_daily"] = ORACLE_SQL["q_budget_daily"].replace("(sum(value::DECIMAL(18,2)) / count(*)::DECIMAL(18,2))::DOUBLE", "sum(value::DECIMAL(18,2))::DOUBLE / count(*)")
