"""Every query against its SQL in DuckDB, on the driver's tables."""

from __future__ import annotations

import os

import __spark_entry__
import duckdb
import pandas as pd
import pytest
from noticeloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "NULL"
        return repr(round(v, 9)) if isinstance(v, float) else str(v.tolist()) if hasattr(v, "tolist") else str(v)

    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "state", "category", "value", "hidden_unknown"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert __spark_entry__.queries()[name](spark, SF).columns


def test_similar_links_and_groups_equal_plain_python(spark):
    """What SQL cannot say: the sequence matcher's ratio over all pairs of notices, and the groups of both kinds of links."""
    from difflib import SequenceMatcher

    from noticeloom.functions.text import normalise_title
    from noticeloom.plans.notices import notices
    from pyspark.sql import functions as F

    rows = notices(spark, SF).select("id", "source", "ref", "authority", "state", normalise_title(F.col("title")).alias("title"), F.unix_seconds(F.col("closing_at").cast("timestamp")).alias("s")).collect()
    near, by = set(), {}
    for r in rows:
        by.setdefault((r.authority.lower(), r.state), []).append(r)
    for group in by.values():
        for x in group:
            for y in group:
                if x.id < y.id and x.source != y.source and abs(x.s - y.s) < 6 * 3600 and 0.45 * SequenceMatcher(None, x.title, y.title).ratio() + 0.55 >= 0.88:
                    near.add((x.id, y.id))
    assert {(r.a, r.b) for r in __spark_entry__.queries()["q_dedupe_similar"](spark, SF).collect()} == near
    root = {r.id: r.id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    refs = {}
    for r in sorted(rows):
        refs.setdefault(r.ref.strip().upper(), []).append(r)
    links = near | {(a.id, b.id) for group in refs.values() for a, b in zip(group, group[1:], strict=False) if a.source != b.source}
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    members = {}
    for i in root:
        members.setdefault(find(i), []).append(i)
    want = {(i, f"dup:{least}", len(group)) for least, group in members.items() if len(group) > 1 for i in group}
    assert {(r.id, r.possible_duplicate_group, r.members) for r in __spark_entry__.queries()["q_dedupe_links"](spark, SF).collect()} == want
