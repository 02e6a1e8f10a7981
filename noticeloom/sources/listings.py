"""Landed listing pages to rows.  Nothing is fetched: pages arrive as ``(url, html, fetched_at)``."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount, parse_plain_number
from ..functions.dates import parse_datetime
from ..functions.ids import canonical_id, fallback_id
from ..functions.text import NATIVE_ID, org_chain, split_title_block, squeeze_text


class _Tables(HTMLParser):
    """Rows of cells (text and first link) of every table of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, str | None]]]] = []
        self._open: list[list] = []
        self._cell: list[str] | None = None
        self._link: str | None = None

    def _end_cell(self) -> None:
        if self._cell is not None and self._open and self._open[-1]:
            self._open[-1][-1].append((" ".join("".join(self._cell).split()), self._link))
        self._cell, self._link = None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._end_cell()
            self._open.append([])
        elif tag == "tr" and self._open:
            self._end_cell()
            self._open[-1].append([])
        elif tag in ("td", "th") and self._open:
            self._end_cell()
            if not self._open[-1]:
                self._open[-1].append([])
            self._cell = []
        elif tag == "a" and self._cell is not None and self._link is None:
            self._link = dict(attrs).get("href")
        elif tag == "br" and self._cell is not None:
            self._cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table" and self._open:
            self._end_cell()
            self.tables.append(self._open.pop())

    def handle_data(self, data: str) -> None:
        if self._cell is not None:
            self._cell.append(data)

    def close(self) -> None:
        super().close()
        while self._open:  # malformed pages still give what they have
            self._end_cell()
            self.tables.append(self._open.pop())


# Plain markup: these tags in lower case, attributes quoted or of simple characters, no character references, comments or raw text.
_ATTRIBUTES = r"""(?:\s+[a-z-]+=(?:"[^"<>&]*"|'[^'<>&]*'|[^\s"'<>&=`/]+))*+"""
_TAG = rf"<(/?)(html|body|table|thead|tbody|tr|td|th|a|b|br|p|div|span|ul|li|img)({_ATTRIBUTES})\s*+>"
_PLAIN = re.compile(rf"(?:[^<&]++|{_TAG.replace('(/?)(', '/?+(?:').replace(f'({_ATTRIBUTES})', _ATTRIBUTES)})*+")
_PIECE = re.compile(rf"{_TAG}([^<]*)")
_ATTRIBUTE = re.compile(r"""([a-z-]+)=(?:"([^"]*)"|'([^']*)'|([^\s"']+))""")


def tables(page: str | None) -> list[list[list[tuple[str, str | None]]]]:
    """Plain markup is cut by one expression, which gives the same tables in less time; all else goes through the parser."""
    parser, page = _Tables(), page or ""
    if not _PLAIN.fullmatch(page):
        parser.feed(page)
    else:
        for end, tag, attributes, text in _PIECE.findall(page):
            if end:
                parser.handle_endtag(tag)
            else:
                parser.handle_starttag(tag, [(k, x or y or z) for k, x, y, z in _ATTRIBUTE.findall(attributes)] if tag == "a" else [])
            if text:
                parser.handle_data(text)
    parser.close()
    return parser.tables


def listing_rows(page: str | None, min_cells: int = 5) -> list[dict]:
    """Rows of the tables whose header names a serial number; a row has enough cells and begins with digits."""
    out = []
    for table in tables(page):
        header = next((" ".join(c for c, _ in row).lower() for row in table if row), "")
        if not re.search(r"s(?:l)?\.?\s*no", header):
            continue
        for row in table:
            if len(row) >= min_cells and re.match(r"\d+", row[0][0]):
                cells = [c for c, _ in row]
                out.append({"serial": int(re.match(r"\d+", cells[0])[0]), "published": cells[1], "closing": cells[2], "opening": cells[3], "title_block": cells[4],
                            "chain": cells[5] if len(cells) > 5 else None, "link": next((href for _, href in row if href), None)})
    return out


_LISTING = "url string, serial int, published string, closing string, opening string, title_block string, chain string, link string"


def parse_listings(pages: DataFrame) -> DataFrame:
    """One row for each listed notice, as printed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["url", "serial", "published", "closing", "opening", "title_block", "chain", "link"]
        schema = pa.schema([(n, pa.int32() if n == "serial" else pa.string()) for n in names])
        for batch in batches:
            rows = [{"url": u, **row} for u, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True) for row in listing_rows(page)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select("url", "html").mapInArrow(run, _LISTING)


def organisations(pages: DataFrame) -> DataFrame:
    """(href, name, n): the organisation list ``[serial, name, count]``, one row for each link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (row[2][1] or row[1][1], row[1][0], int(row[2][0]))
                for page in batch.column("html").to_pylist() for table in tables(page) for row in table
                if len(row) == 3 and row[0][0].strip(".").isdigit() and row[2][0].isdigit()
            ]
            href, name, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([pa.array(href, pa.string()), pa.array(name, pa.string()), pa.array(n, pa.int32())], ["href", "name", "n"])

    return pages.select("html").mapInArrow(run, "href string, name string, n int").where("href is not null").dropDuplicates(["href"])


def largest(found: DataFrame, cap: int) -> DataFrame:
    return found.orderBy(F.desc("n"), "name").limit(cap)


def _row_parser(of_page, fields: str):
    """A parser of landed (url, html) into ``url`` and text ``fields``, one row for each dict that ``of_page`` finds."""
    names = ["url", *fields.split()]
    schema = pa.schema([(n, pa.string()) for n in names])

    def parse(pages: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)
                yield pa.RecordBatch.from_pylist([{"url": u, **row} for u, page in both for row in of_page(page)], schema)

        return pages.select("url", "html").mapInArrow(run, ", ".join(f"{n} string" for n in names))

    return parse


def _widget_rows(page: str | None) -> list[dict]:
    """Four cells: title with a printed serial, reference, closing, opening."""
    rows = [row for table in tables(page) for row in table if len(row) == 4 and row[0][1]]
    return [{"title": re.sub(r"^\d+\.\s*", "", r[0][0]), "ref": r[1][0], "closing": r[2][0], "opening": r[3][0], "link": r[0][1]} for r in rows]


def _district_rows(page: str | None) -> list[dict]:
    """Title, description, start, end and file of district-site tables, by their header."""
    out = []
    for table in tables(page):
        header = [c.lower() for c, _ in table[0]] if table else []
        at = {name: next((i for i, h in enumerate(header) if name in h), None) for name in ("title", "start", "end")}
        if None in at.values():
            continue
        for row in table[1:]:
            if len(row) > max(at.values()):
                out.append({"title": row[at["title"]][0], "start": row[at["start"]][0], "end": row[at["end"]][0], "link": next((h for _, h in row if h), None)})
    return out


_STAMPED = re.compile(r"""<a\s[^>]*?href=["']([^"']*?(\d{14})[^"']*)["'][^>]*>(.*?)</a>""", re.I | re.S)


def _stamped_rows(page: str | None) -> list[dict]:
    """Links whose file name carries a 14-digit time."""
    return [{"title": " ".join(re.sub(r"<[^>]*>", " ", t).split()), "published": f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:10]}:{d[10:12]}:{d[12:]}", "link": h} for h, d, t in _STAMPED.findall(page or "")]


def _option_rows(page: str | None) -> list[dict]:
    found = re.findall(r"""<option[^>]*?value=["']?([^"'>]+)["']?[^>]*>([^<]*)""", page or "", re.I)
    return [{"value": v.strip(), "name": " ".join(n.split())} for v, n in found if v.strip() not in ("", "0", "-1") and n.strip()]


_NUMBER = re.compile(r"\d{6,12}")
_DAY = re.compile(r"\d{2}/\d{2}/\d{4}")


def _zone_rows(page: str | None) -> list[dict]:
    """Rows of a table whose columns are not named: four cells or more, the first a serial; the number is a cell of 6 to 12 digits among
    the next two, the title what the next three say, the closing time the last cell with a date."""
    out = []
    for row in (row for table in tables(page) for row in table):
        cells = [c for c, _ in row]
        if len(cells) < 4 or not cells[0].isdigit():
            continue
        dates = [c for c in cells if _DAY.search(c)]
        number = next((c for c in cells[1:3] if _NUMBER.fullmatch(c)), None)
        closing = re.sub(r"[^0-9/: ]", "", dates[-1]).strip().replace("/", "-") if dates else None
        out.append({"serial": cells[0], "number": number, "title": " | ".join(c for c in cells[1:4] if c) or None, "closing": closing})
    return out


def _document_rows(page: str | None) -> list[dict]:
    """Document links, one for each address."""
    found = re.findall(r"""<a\s[^>]*?href=["']([^"']+\.(?:pdf|xlsx?|docx?|zip))["'][^>]*>(.*?)</a>""", page or "", re.I | re.S)
    first: dict[str, str] = {}
    for href, text in found:
        first.setdefault(href, " ".join(re.sub(r"<[^>]*>", " ", text).split()))
    return [{"link": h, "title": t or h.rsplit("/", 1)[-1]} for h, t in first.items()]


def _paged_rows(page: str | None) -> list[dict]:
    """Number, zone, title, start, end and file of offset-paged tables; a row has dates in both date cells."""
    out = []
    for row in (row for table in tables(page) for row in table if len(row) >= 6):
        (number, _), (zone, _), (title, link), (start, _), (end, _), (_, file) = row[:6]
        if title and any(c.isdigit() for c in start) and any(c.isdigit() for c in end):
            out.append({"number": number, "zone": zone, "title": title, "start": start, "end": end, "link": link or file})
    return out


_POST = re.compile(r"""<div\s[^>]*class=["'][^"']*\bpp-post-wrap\b""", re.I)
_POST_LINK = re.compile(r"""<h2[^>]*pp-post-title[^>]*>.*?<a\s[^>]*?href=["']([^"']+)["'][^>]*>(.*?)</a>""", re.I | re.S)
_POST_DATE = re.compile(r"""<span[^>]*pp-post-date[^>]*>(.*?)</span>""", re.I | re.S)


def _post_rows(page: str | None) -> list[dict]:
    """Number, title, date and link of a post grid; each post reaches to the next one."""
    page, out = page or "", []
    begins = [m.start() for m in _POST.finditer(page)]
    plain = lambda t: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", t)).split())
    for at, end in zip(begins, [*begins[1:], len(page)], strict=True):
        link, date = _POST_LINK.search(page, at, end), _POST_DATE.search(page, at, end)
        number = re.search(r"\bpost-(\d+)\b", page[at : page.find(">", at)])
        if link:
            out.append({"number": number and number[1], "title": plain(link[2]), "published": date and plain(date[1]), "link": link[1]})
    return out


parse_paged = _row_parser(_paged_rows, "number zone title start end link")
parse_posts = _row_parser(_post_rows, "number title published link")
parse_widget = _row_parser(_widget_rows, "title ref closing opening link")
parse_district = _row_parser(_district_rows, "title start end link")
parse_stamped = _row_parser(_stamped_rows, "title published link")
parse_zone_results = _row_parser(_zone_rows, "serial number title closing")
parse_options = _row_parser(_option_rows, "value name")
parse_documents = _row_parser(_document_rows, "link title")


def next_page(page: Column) -> Column:
    """The address that a page names as its next one."""
    found = F.regexp_extract(F.coalesce(page, F.lit("")), r"""(?i)<a\s(?=[^>]*\brel=["']?next)[^>]*?href=["']([^"']+)""", 1)
    return F.nullif(found, F.lit(""))


def still_crawled(attempts: DataFrame, source: str = "source", at: str = "at", most: int = 3) -> DataFrame:
    """Attempts (ok) up to where a crawl stops: the failure that is the ``most``-th one after another."""
    by = W.partitionBy(source).orderBy(at)
    rows = attempts.withColumn("run_", F.sum(F.col("ok").cast("int")).over(by))
    rows = rows.withColumn("failed_", F.sum((~F.col("ok")).cast("int")).over(W.partitionBy(source, "run_").orderBy(at)))
    stopped = F.coalesce(F.max(F.col("failed_") >= most).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("stopped_", stopped).where("not stopped_").drop("run_", "failed_", "stopped_")


def has_later_page(page: Column, current: int) -> Column:
    """Whether a listing links to a page after ``current``."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"[?&/](?:page|paged)[=/](\d+)"), 1), lambda n: n.try_cast("int"))
    return F.coalesce(F.array_max(numbers) > current, F.lit(False))


def to_notices(rows: DataFrame, source: str, now: Column) -> DataFrame:
    """Listed rows as notices: title, ids, chain, times, status by deadline."""
    block = split_title_block(F.col("title_block"))
    out = rows.withColumn("b", block).select(
        "url", "serial", F.lit(source).alias("source"), F.col("b.title").alias("title"), F.col("b.native").alias("native"), F.col("b.ref").alias("ref"),
        org_chain(F.col("chain")).alias("authority"), parse_datetime(F.col("published")).alias("published_at"), parse_datetime(F.col("closing")).alias("closing_at"), "link",
    )
    out = out.withColumn("source_tender_id", fallback_id(F.col("native"), F.col("title"), F.col("ref")))
    status = F.when(F.col("closing_at").isNull(), "unknown").when(F.col("closing_at") > now, "active").otherwise("closed")
    return out.withColumn("status", status).withColumn("id", canonical_id(F.col("source"), F.col("source_tender_id")))


def zone_notices(rows: DataFrame, zone: Column) -> DataFrame:
    """Results of a zone's search as notices; one without a number is told by its zone and serial."""
    named = F.coalesce("number", F.concat_ws(":", F.lit("ireps"), zone, "serial"))
    return rows.where("title is not null").select(named.alias("source_tender_id"), "title", parse_datetime(F.col("closing")).alias("closing_at"))


def first_occurrence(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without one are all kept."""
    named = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return named.unionByName(rows.where(F.col(key).isNull()))


def links(page: Column) -> Column:
    """All distinct link targets of a page, in order, by regular expression."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1))


def page_title(page: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def total_of(page: Column) -> Column:
    return F.regexp_extract(page, r"(?i)Total\s+Tenders\s*:\s*(\d+)", 1).try_cast("int")


def title_tail(cell: Column) -> Column:
    """``Title/Ref/ID``: the last two parts are cut off, so slashes of the title survive."""
    pattern = r"(?s)^(.*)/([^/]*)/([^/]*)$"
    whole = F.struct(cell.alias("title"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("native"))
    parts = F.struct(*[F.trim(F.regexp_extract(cell, pattern, i)).alias(n) for i, n in ((1, "title"), (2, "ref"), (3, "native"))])
    return F.when(cell.rlike(pattern), parts).otherwise(whole)


# Labels of detail pages and where their values belong.
LABELS = {
    "tender title": "procurement.title", "tender ref no": "identity.reference_number", "tender id": "identity.source_tender_id", "organisation name": "organization.authority",
    "organisation chain": "organization.authority", "tender category": "procurement.category", "product category": "procurement.subcategory", "tender type": "procurement.tender_type",
    "form of contract": "procurement.contract_type", "tender value": "financial.estimated_value", "tender value in rupees": "financial.estimated_value", "emd amount": "financial.emd_amount",
    "emd fee": "financial.emd_amount", "earnest money deposit": "financial.emd_amount", "tender fee": "financial.tender_fee", "document fee": "financial.tender_fee",
    "work item description": "work.scope", "work item title": "procurement.title", "bid submission start date": "dates.bid_submission_start", "bid submission end date": "dates.bid_submission_end",
    "bid opening date": "dates.bid_opening_at", "pre-bid meeting date": "dates.pre_bid_meeting_at", "publish date": "dates.published_at", "document download end date": "dates.clarification_end",
    "clarification start date": "dates.clarification_start", "clarification end date": "dates.clarification_end", "period of work": "work.period_of_work_days",
    "contract period": "work.period_of_work_days", "bid validity days": "work.bid_validity_days", "location": "geography.location_text", "pincode": "geography.pincode",
}


def typed_value(path: Column, label: Column, value: Column) -> Column:
    """(text, number, instant) of a detail value by where it belongs; all null where it says nothing."""
    amount = F.coalesce(parse_plain_number(value), parse_amount(value))
    days = F.regexp_extract(F.regexp_replace(value, ",", ""), r"\d+", 0).try_cast("double")
    native = F.coalesce(F.nullif(F.regexp_extract(value, rf"\[({NATIVE_ID})\]", 1), F.lit("")), F.trim(value))
    number = F.when(path.startswith("financial."), amount).when(path == "work.period_of_work_days", days)
    instant = F.when(path.startswith("dates."), parse_datetime(value))
    plain = ~path.startswith("financial.") & ~path.startswith("dates.") & (path != "work.period_of_work_days")
    text = F.when(path == "identity.source_tender_id", native).when(path.startswith("geography."), squeeze_text(value, 300)).when(label == "organisation chain", org_chain(value))
    text = F.when(plain, text.otherwise(squeeze_text(value)))
    return F.struct(F.when(text != "NA", text).alias("text"), number.alias("number"), instant.alias("instant"))


def label_fields(details: DataFrame, key: str = "id") -> DataFrame:
    """(id, path, value, text, number, instant): the first value of each mapped label of (id, ordinal, label, value) that says something."""
    names = details.sparkSession.createDataFrame(list(LABELS.items()), "name string, path string")
    clean = F.trim(F.regexp_replace(F.lower("label"), r"[\s:]+", " "))
    rows = details.withColumn("name", clean).where(F.trim("value") != "").join(F.broadcast(names), "name")
    rows = rows.withColumn("typed", typed_value(F.col("path"), F.col("name"), F.col("value")))
    rows = rows.where("typed.text is not null or typed.number is not null or typed.instant is not null")
    first = rows.groupBy(key, "path").agg(F.min_by(F.struct("value", "typed"), "ordinal").alias("first"))
    return first.select(key, "path", "first.value", "first.typed.*")


def rekeyed(rows: DataFrame, fields: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a made-up number take the one that their detail page shows, and a new ``id``; ``fields`` is that of :func:`label_fields`."""
    shown = fields.where("path = 'identity.source_tender_id'").select(F.col(key).alias("shown_key"), F.col("text").alias("shown"))
    joined = rows.join(shown, F.col(key) == F.col("shown_key"), "left")
    fresh = F.col("source_tender_id").startswith("hash:") & F.col("shown").isNotNull()
    named = {"source_tender_id": F.when(fresh, F.col("shown")).otherwise(F.col("source_tender_id")), key: F.when(fresh, canonical_id(F.col("source"), F.col("shown"))).otherwise(F.col(key))}
    return joined.withColumns(named).drop("shown", "shown_key")


def planned_pages(totals: DataFrame, budget: int, day: int, key: str = "source", total: str = "pages") -> DataFrame:
    """(source, page): a day's even sample of each source's pages, in proportion to its size, rotating with the day."""
    share = F.greatest(F.lit(1), F.floor(F.lit(budget) * F.col(total) / F.sum(total).over(W.partitionBy(F.lit(1)))))
    quota = totals.withColumn("quota", F.least(F.col(total), share).cast("int"))
    stride = F.col(total) / F.col("quota")
    at = quota.select(key, total, "quota", stride.alias("stride"), F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("i"))
    page = F.pmod(F.floor(F.col("i") * F.col("stride")) + F.lit(day), F.col(total)) + 1
    return at.select(key, page.cast("int").alias("page")).distinct()


def in_window(now: Column, days: int, published: str = "published_at", keep_undated: bool = False) -> Column:
    return F.coalesce(F.col(published) >= now - F.make_dt_interval(F.lit(days)), F.lit(keep_undated))


def district_window(now: Column, days: int, start: str = "start", end: str = "end") -> Column:
    return F.col(start).isNull() | (F.col(start) >= now - F.make_dt_interval(F.lit(days))) | F.coalesce(F.col(end) >= now, F.lit(False))


def state_name(raw: Column, names: dict[str, str]) -> Column:
    """The canonical state of a listing's spelling; null if it is none."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(raw), F.lit("&"), F.lit(" and ")), r"[.,]", " "), r"\s+", " "))
    key = F.regexp_replace(key, r"\s*\(?\bu\.?t\.?\)?$", "")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, key)
