"""Landed JSON records and documents; the source registry."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.dates import portal_timestamp
from ..functions.ids import canonical_id
from ..schema import canonical_schema

BUYER_STATUS = {"0": "active", "1": "closed", "2": "closed", "3": "awarded"}
FAMILIES = ("gepnic", "gem", "ireps", "notice_pages", "s3waas", "cppp_state")


@dataclass(frozen=True)
class Source:
    name: str
    family: str
    base_url: str
    status: str = "EXPERIMENTAL"
    enabled: bool = True
    options: dict = field(default_factory=dict)


def load_sources(folder: str) -> list[Source]:
    """All ``*.yaml`` files by name; unreadable ones and entries without a name, family or url are skipped."""
    import yaml

    out = []
    for path in sorted(Path(folder).glob("*.yaml")):
        try:
            body = yaml.safe_load(path.read_text(encoding="utf-8"))
        except (OSError, yaml.YAMLError):
            continue
        for entry in body if isinstance(body, list) else (body or {}).get("sources", [body]) if isinstance(body, dict) else []:
            if isinstance(entry, dict) and {"name", "family", "base_url"} <= entry.keys() and entry["family"] in FAMILIES:
                known = {k: entry[k] for k in ("name", "family", "base_url", "status", "enabled", "options") if k in entry}
                out.append(Source(**known))
    return out


def sources_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    rows = [(s.name, s.family, s.base_url, s.status, s.enabled, {k: str(v) for k, v in s.options.items()}) for s in sources]
    return spark.createDataFrame(rows, "source string, family string, base_url string, status string, enabled boolean, options map<string,string>")


def unwrapped(json: Column, name: str) -> Column:
    """A field of a search answer: a list counts as its first value, an empty one or one of null as nothing."""
    raw = F.get_json_object(json, f"$.{name}")
    return F.when(raw.rlike(r"^\[\s*(?:null\b|\])"), F.lit(None)).otherwise(F.coalesce(F.get_json_object(json, f"$.{name}[0]"), raw))


def json_records(landed: DataFrame, source: str, body: str = "body") -> DataFrame:
    """Records of a bid API as notices: title precedence, status codes, times, facts."""
    j, f = F.col(body), lambda n: unwrapped(F.col(body), n)
    status = F.lit("unknown")
    for code, name in BUYER_STATUS.items():
        status = F.when(f("status") == code, name).otherwise(status)
    native = F.coalesce(F.nullif(f("bid_number"), F.lit("")), F.concat(F.lit("bid:"), f("b_id")))
    facts = F.concat_ws("; ", F.concat(F.lit("Quantity: "), f("quantity")), F.concat(F.lit("Bid type: "), f("bid_type")), F.concat(F.lit("Department: "), f("department")))
    out = landed.where(F.try_parse_json(j).isNotNull()).select(
        F.lit(source).alias("source"), native.alias("source_tender_id"), F.coalesce(F.nullif(f("title"), F.lit("")), f("category"), native).alias("title"), status.alias("status"),
        portal_timestamp(f("start")).alias("published_at"), portal_timestamp(f("end")).alias("closing_at"), f("value").try_cast("double").alias("value"), F.nullif(facts, F.lit("")).alias("description"),
    )
    return out.withColumn("id", canonical_id(F.col("source"), F.col("source_tender_id")))


def paged(records: DataFrame, size: int, cap: int) -> DataFrame:
    """Rows of (page, total, id) up to where paging stops: an empty or repeated page, a short one, the total, or the cap."""
    from pyspark.sql import Window as W

    first = records.groupBy("id").agg(F.min("page").alias("page"))
    per = records.groupBy("page").agg(F.count("*").alias("n"), F.max("total").alias("total"))
    fresh = first.groupBy("page").agg(F.count("*").alias("new"))
    pages = per.join(fresh, "page", "left").withColumn("stop", F.coalesce("new", F.lit(0)) == 0)
    ended = F.col("stop") | (F.col("n") < size) | (F.col("page") * size >= F.coalesce("total", F.lit(1 << 30)))
    before = W.partitionBy(F.lit(1)).orderBy("page").rowsBetween(W.unboundedPreceding, -1)  # one row a page of one source
    kept = pages.withColumn("ended_before", F.coalesce(F.max(ended.cast("int")).over(before), F.lit(0))).where((F.col("ended_before") == 0) & (F.col("page") <= cap) & ~F.col("stop"))
    return records.join(kept.select("page"), "page", "left_semi")


def canonical_json(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows from (gzip) JSON lines; what does not fit the schema is kept in ``_corrupt_record``."""
    schema = StructType([*canonical_schema().fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_keyed(df: DataFrame, path: str, name: str, key: str = "canonical_id", buckets: int = 64) -> str:
    """Writes rows as a table in buckets by ``key``, sorted by it, at ``path``, and returns its name: a point read opens one bucket of it."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(f"`{name}`")
    return name


def point_read(spark: SparkSession, name: str, value: str, key: str = "canonical_id") -> DataFrame:
    """The row of one key of a table in buckets: one bucket is listed, and in it only row groups whose range holds the key."""
    return spark.table(f"`{name}`").where(F.col(key) == value)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed files with their kind by magic bytes; too large and legacy office files are rejected with a reason."""
    rows = spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, 8)
    kind = (
        F.when(F.startswith(head, F.lit(b"%PDF-")), "pdf").when(F.startswith(head, F.lit(b"PK\x03\x04")), "xlsx").when(F.startswith(head, F.lit(b"\xd0\xcf\x11\xe0")), "ole")
        .otherwise("unknown")
    )
    reason = F.when(F.col("length") > 25 * 1024 * 1024, "too large").when(F.col("length") == 0, "empty").when(F.col("kind").isin("ole", "unknown"), "unsupported type")
    return rows.withColumn("kind", kind).withColumn("rejected", reason)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_text(content: bytes, max_rows: int = 5000, max_cells: int = 30, max_bytes: int = 100 * 1024 * 1024) -> str:
    """Cells of a workbook, joined by `` | ``; unreadable or overlarge ones give ''."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            if sum(i.file_size for i in book.infolist()) > max_bytes:
                return ""
            strings = []
            if "xl/sharedStrings.xml" in book.namelist():
                strings = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
            lines = []
            for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                lines.append(f"## Sheet: {Path(name).stem}")
                for row in list(ElementTree.fromstring(book.read(name)).iter(f"{_MAIN}row"))[:max_rows]:
                    cells = []
                    for cell in list(row)[:max_cells]:
                        value = cell.findtext(f"{_MAIN}v") or "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                        cells.append(strings[int(value)] if cell.get("t") == "s" and value.isdigit() and int(value) < len(strings) else value)
                    if any(c.strip() for c in cells):
                        lines.append(" | ".join(cells))
            return "\n".join(lines)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
        return ""


@F.pandas_udf(StringType())
def workbook_text_column(content: pd.Series) -> pd.Series:
    return content.map(lambda c: workbook_text(c) if c is not None else None)


def upgraded_health(records: DataFrame, old: str = "sources", new: str = "records") -> DataFrame:
    """(source, health) of a status file in its present or former shape."""
    shape = F.coalesce(F.col(new) if new in records.columns else F.lit(None), F.col(old) if old in records.columns else F.lit(None))
    return records.select(F.explode(shape).alias("source", "health"))


def probe(pages: DataFrame, marker: str) -> DataFrame:
    """One health row for each landed page: whether the marker is there."""
    found = F.lower(F.coalesce("html", F.lit(""))).contains(marker.lower())
    return pages.select("url", found.alias("ok"), F.when(~found, "marker missing").alias("error"))
