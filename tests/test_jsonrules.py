"""A compiled JSON Schema against planted rows: every keyword, nesting, and which error is shown."""

from __future__ import annotations

import json

import pytest
from noticeloom.operators import jsonrules
from noticeloom.sources import records
from pyspark.sql import functions as F

SCHEMA = {
    "type": "object", "required": ["id", "who", "status"], "additionalProperties": False,
    "properties": {
        "version": {"const": "1.0"}, "id": {"type": "string", "pattern": "^[a-f0-9]{4}$"}, "status": {"enum": ["active", "closed", None]},
        "who": {"type": "object", "required": ["source"], "additionalProperties": False, "properties": {"source": {"type": "string", "minLength": 1, "maxLength": 5}, "ref": {"type": ["string", "null"]}}},
        "money": {"type": "object", "properties": {"value": {"type": ["number", "null"], "minimum": 0, "maximum": 1e9}, "days": {"type": ["integer", "null"], "minimum": 0}, "flag": {"type": "boolean"}}},
        "at": {"type": ["string", "null"], "format": "date-time"},
        "docs": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string"}, "tags": {"type": "array", "items": {"enum": [1, True, "x"]}}}}},
    },
}
GOOD = {"id": "ab12", "who": {"source": "s"}, "status": "active"}
#: A change of a good row, and the errors (path, rule) of it.
CASES = (
    ({}, []), ({"status": None, "version": "1.0", "money": {"value": None, "days": 4.0, "flag": False}, "at": "2026-01-02T03:04:05+05:30", "docs": [{"url": "u", "tags": [1, True, "x", 1.0]}]}, []),
    ({"id": 5}, [("$.id", "type")]), ({"id": "xyz"}, [("$.id", "pattern")]), ({"version": "2"}, [("$.version", "const")]), ({"version": 1.0}, [("$.version", "const")]),
    ({"status": "open"}, [("$.status", "enum")]), ({"more": 1, "other": {}}, [("$.more", "additionalProperties"), ("$.other", "additionalProperties")]),
    ({"who": "x"}, [("$.who", "type")]), ({"who": {}}, [("$.who.source", "required")]), ({"who": {"source": "", "ref": 3, "z": 1}}, [("$.who.source", "minLength"), ("$.who.ref", "type"), ("$.who.z", "additionalProperties")]),
    ({"who": {"source": "longer"}}, [("$.who.source", "maxLength")]), ({"money": {"value": -1, "days": 1.5, "flag": 1}}, [("$.money.value", "minimum"), ("$.money.days", "type"), ("$.money.flag", "type")]),
    ({"money": {"value": 2e9, "days": -3}}, [("$.money.value", "maximum"), ("$.money.days", "minimum")]), ({"money": {"value": "7"}}, [("$.money.value", "type")]),
    ({"at": "2026-01-02"}, [("$.at", "format")]), ({"at": "2026-13-02T03:04:05Z"}, [("$.at", "format")]), ({"docs": []}, [("$.docs", "minItems")]), ({"docs": [{"url": "u"}] * 4}, [("$.docs", "maxItems")]),
    ({"docs": [{"url": "u"}, {}, {"url": 1, "tags": [2, "y"]}]}, [("$.docs[1].url", "required"), ("$.docs[2].url", "type"), ("$.docs[2].tags[0]", "enum"), ("$.docs[2].tags[1]", "enum")]),
)


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, json.dumps(GOOD | change)) for i, (change, _) in enumerate(CASES)]
    rows += [(100, "no json"), (101, None), (102, "[]"), (103, "{}"), (104, '{"id": 1, "who": {"source": 2}, "status": "active"}'), (105, '{"who": {"source": 2}, "id": 1, "status": "x", "more": 0}')]
    df = spark.createDataFrame(rows, "i int, body string").withColumn("found", jsonrules.errors(F.col("body"), SCHEMA))
    return {r.i: r for r in df.select("i", "found", jsonrules.best(F.col("found")).alias("best")).collect()}


def test_errors_of_planted_rows(found):
    for i, (change, want) in enumerate(CASES):
        assert sorted((e.path, e.rule) for e in found[i].found) == sorted(want), change
        assert (found[i].best is None) == (not want)


def test_the_error_that_is_shown_is_the_shallowest(found):
    shown = lambda i: (found[i].best.path, found[i].best.rule)
    assert shown(100) == shown(101) == ("$", "json") and shown(102) == ("$", "type") and shown(103) == ("$.id", "required")
    assert shown(104) == ("$.id", "type") and shown(105) == ("$.more", "additionalProperties")


def test_a_point_read_takes_one_bucket(spark, tmp_path):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("canonical_id"), "id")
    store = records.write_keyed(df, f"{tmp_path}/store", "keyed_test", buckets=8)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(auto, "false")  # buckets are skipped either way, but only shown so
    one = records.point_read(spark, store, df.where("id = 7").first().canonical_id)
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert [r.id for r in one.collect()] == [7] and "SelectedBucketsCount: 1 out of 8" in plan and "PushedFilters: [IsNotNull(canonical_id), EqualTo(canonical_id," in plan
    spark.conf.unset(auto)
    assert [r.id for r in records.point_read(spark, store, df.where("id = 7").first().canonical_id).collect()] == [7]
    records.write_keyed(df.where("id < 3"), f"{tmp_path}/store2", "keyed_test", buckets=4)
    assert spark.table(store).count() == 3 and records.point_read(spark, store, "nothing").count() == 0
    spark.sql(f"DROP TABLE {store}")
