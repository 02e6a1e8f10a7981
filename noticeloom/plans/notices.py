"""The test tables seen as notices; the same view in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "1998-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices.  Customer, nation and region come by ordinary joins; Spark broadcasts what it has measured as small."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    return rows.select(
        key.alias("id"), F.concat(F.lit("REF/"), F.floor(key / 3).cast("string")).alias("ref"), key.cast("string").alias("tender_number"), F.col("c_name").alias("authority"),
        F.col("c_mktsegment").alias("buyer_group"), F.col("n_name").alias("state"), F.col("r_name").alias("region"), F.col("o_orderpriority").alias("category"),
        F.concat(F.lit("portal_"), (key % 4).cast("string")).alias("source"), F.when(key % 7 != 0, F.col("o_totalprice")).alias("value"), F.col("o_orderdate").alias("closing_at"),
        (F.col("o_orderdate") - F.expr("INTERVAL 21 DAYS")).alias("published_at"), (F.col("o_orderdate") - F.expr("INTERVAL 20 DAYS")).alias("first_seen_at"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "closed").otherwise("unknown").alias("status"),
        F.concat_ws(" ", "c_mktsegment", F.lit("supply"), "o_orderpriority", F.lit("for"), "n_name").alias("title"),
    )


def with_corrigenda(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    joined = rows.join(returned, F.col("id") == F.col("l_orderkey"), "left")
    return joined.withColumn("corrigenda_count", F.coalesce("n", F.lit(0))).drop("n", "l_orderkey")


SQL = f"""
n AS (SELECT o_orderkey AS id, 'REF/' || (o_orderkey // 3)::VARCHAR AS ref, o_orderkey::VARCHAR AS tender_number, c_name AS authority, c_mktsegment AS buyer_group,
  n_name AS state, r_name AS region, o_orderpriority AS category, 'portal_' || (o_orderkey % 4)::VARCHAR AS source,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value, o_orderdate AS closing_at, o_orderdate - INTERVAL 21 DAY AS published_at,
  o_orderdate - INTERVAL 20 DAY AS first_seen_at, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS status,
  c_mktsegment || ' supply ' || o_orderpriority || ' for ' || n_name AS title, TIMESTAMP '{NOW}' AS now
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
CORRIGENDA = "k AS (SELECT n.*, coalesce(r.c, 0)::INT AS corrigenda_count FROM n LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON n.id = r.l_orderkey)"


def sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join([SQL, *more]) + " " + body
