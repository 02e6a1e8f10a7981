"""Main text of web pages: a suffix array of each host's token streams, with markup to break ties.

Pages of one host lie in slices of a few hundred.  The token streams of a slice, each page with an end of its own, are one
sequence whose suffixes are ranked by prefix doubling; lengths of common prefixes of neighbours in that order show the substrings that
repeat.  Neighbours that share ``REPEAT`` tokens or more form a run; a run on enough distinct pages is boilerplate, and so is every
token it covers.  The rest are the page's unique runs.

Repetition cannot tell a passage that many articles print from a notice, nor a reader's comment, which is unique, from the article.
There the markup decides: blocks inside ``<article>`` (or a main element) stay although they repeat, and blocks in menus, footers, adverts,
comments and the like go although they are unique.  Marks that are only a part of a class name are weak: they do not hold for an element with an article inside or with half of the
page's text, and no class name holds where nothing else would be left of a page.  A form goes if it has little text, the less so without controls; a menu or
sidebar that is never closed ends where an article begins, and hidden elements are text like others.

On hosts with a page where repetition has to decide alone, runs are counted over all slices of the host: counted by slice, summed by host,
and each slice gets back those of its runs that are frequent on the host.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from .urlrules import url_host
from .wordhash import Words, mix, raw_strings

SLICE_PAGES = 256
#: A run of so many tokens on at least so many distinct pages of a host is boilerplate.
REPEAT, MIN_PAGES = 8, 3
#: A form with so many characters of text besides its controls stands around an article.
FORM_CHARS = 300

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page; only scripts and styles may run to the end of a page that does not close them.
_RAW = frozenset("script style noscript textarea title template iframe xmp svg object select".split())
_ENDLESS = frozenset(("script", "style"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUTSIDE = frozenset("nav footer aside head menu dialog button".split())
_CONTROLS = frozenset("input select textarea button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar cookie cookies"
    " consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus"
    " reply replies respond nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar share sharing social related"
    " recommended recommendations widget toolbar pagination pager copyright disclaimer responses discussion".split()
)
#: Of these, what readers write: there may be more of it than of the article.
_READERS = frozenset("comment comments disqus reply replies respond responses discussion".split())
_QUOTED = re.compile(r"=\s*([\"'])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Before a part of a class name, these say that something is not there or lies elsewhere: no-sidebar, has-menu.
_ABOUT = frozenset("no non not without with has have hide hidden is".split())


@dataclass
class Mark:
    """A class or id that says an element is no content, or a form; ``weak`` if only a part of a name says so."""

    weak: bool
    above: Mark | None
    readers: bool = False
    form: bool = False
    live: bool = True
    controls: int = 0
    chars: int = 0

    def chain(self) -> Iterator[Mark]:
        mark: Mark | None = self
        while mark is not None:
            yield mark
            mark = mark.above


@dataclass
class Block:
    text: str
    inside: bool  # of an article
    main: bool  # of a main element
    outside: bool  # in a menu, footer, advert or the like
    mark: Mark | None = None

    def excluded(self, level: int = 0) -> bool:
        """Whether the markup says that it is no content; level 1 is without weak marks, level 2 without any names."""
        return self.outside or any(m.live and (m.form and (level < 2 or m.controls > 0) or level == 0 or level == 1 and not m.weak) for m in (self.mark.chain() if self.mark else ()))


def _settled(found: list[Block]) -> list[Block]:
    """Lifts the marks of forms around an article, and weak marks of elements with half of the text."""
    marks = {id(m): m for b in found if b.mark for m in b.mark.chain()}
    if not marks:
        return found
    for b in found:
        for m in b.mark.chain() if b.mark and not b.outside else ():
            m.chars += len(b.text)
    for m in marks.values():
        m.live &= not m.form or m.chars < FORM_CHARS
    firm = lambda b: b.outside or any(m.live and (m.form and m.controls > 0 or m.readers or not m.weak) for m in (b.mark.chain() if b.mark else ()))
    total = sum(len(b.text) for b in found if not firm(b))
    for m in marks.values():
        if m.weak and not m.readers and not m.controls and 2 * m.chars >= total:
            m.live = False
    return found


def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether class names or an id mark an element at all, by a whole name, and as written by readers."""
    found = readers = False
    for name in value.split():
        if name in _MARKS:
            return True, True, name in _READERS
        parts = _SPLIT.split(name)
        said = [part for i, part in enumerate(parts) if part in _MARKS and (not i or parts[i - 1] not in _ABOUT)]
        found |= bool(said)
        readers |= any(part in _READERS for part in said)
    return found, False, readers


def _marked(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether the attributes say that an element is no content, is marked so by a name, weakly so, by readers, or is the main content."""
    if not attributes or "=" not in attributes:
        return False, False, False, False, False
    out = named = whole = readers = main = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if tag not in ("html", "body", "main"):
                some, entire, written = _named(value)
                named |= some
                whole |= entire
                readers |= written
            main |= "articlebody" in _SPLIT.split(value)
        elif name == "role":
            out |= value in _ROLES
            main |= value == "main"
        elif name == "itemprop":
            main |= value == "articlebody"
    return out, named, named and not whole, readers, main


class _Balance:
    """Where elements of a name begin and end on a page; each name is looked for once."""

    def __init__(self, page: str):
        self.page, self.places = page, {}

    def open_after(self, tag: str, at: int, depth: int) -> bool:
        """Whether what is left of the page from ``at`` on closes fewer elements than ``depth`` and those it opens itself."""
        if tag not in self.places:
            self.places[tag] = tuple([m.start() for m in re.finditer(rf"<{slash}{tag}\b", self.page, re.I)] for slash in ("", "/"))
        begins, ends = (len(x) - bisect_left(x, at) for x in self.places[tag])
        return ends < begins + depth


class _Scanner:
    """Tags of a page in one pass: what a quote that is never closed would hide is looked for once."""

    def __init__(self, page: str):
        self.page = page
        self.open = {'"': True, "'": True}  # whether such a quote may still come

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that closes the tag whose attributes begin at ``at``; -1 if there is none."""
        page = self.page
        close = page.find(">", at)
        while close >= 0:
            m = _QUOTED.search(page, at, close)
            if m is None:
                return close
            at = m.end()
            if self.open[m[1]]:
                end = page.find(m[1], at)
                if end < 0:
                    self.open[m[1]] = False
                else:
                    at = end + 1
                    if at > close:
                        close = page.find(">", at)
        return close


_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and markup are gone, white space is squeezed."""
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool, Mark | None]] = []  # tag, inside, main, outside, in a header, mark
    parts: list[str] = []
    heading = False
    ground = ("", False, False, False, False, None)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, inside, main, outside, header, mark = stack[-1] if stack else ground
                found.append(Block(text, inside, main, outside or header and not (heading and (inside or main)), mark))

    scanner, balance, unclosed, at, size = _Scanner(page), _Balance(page), set(), 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            parts.append(page[at:])
            break
        if begin > at:
            parts.append(page[at:begin])
        after = page[begin + 1 : begin + 2]
        if after in ("!", "?"):
            end = page.find("-->", begin + 4) + 2 if page.startswith("<!--", begin) else -1
            end = end if end > 1 else page.find(">", begin)
            at = end + 1 if end >= 0 else size
            continue
        closing = after == "/"
        name = _NAME.match(page, begin + 1 + closing)
        if name is None:
            if closing:  # </ and no name: nothing of it is text
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else size
            else:
                parts.append("<")
                at = begin + 1
            continue
        end = scanner.tag_end(name.end())
        if end < 0:  # a tag that never ends
            break
        at = end + 1
        attributes = page[name.end() : end]
        tag = name[0].lower()
        if tag == "br":
            parts.append("\n")
            continue
        if closing:
            if tag in _BLOCK:
                flush()
                heading = heading and tag not in _HEADINGS
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        single = attributes.endswith("/")
        if tag in _CONTROLS and stack and stack[-1][5] and not (tag == "input" and re.search(r"type\s*=\s*[\"']?hidden", attributes, re.I)):
            for m in stack[-1][5].chain():
                m.controls += m.form
        if tag in _RAW and not single and tag not in unclosed:
            close = _RAW_END[tag].search(page, at)
            if close or tag in _ENDLESS:
                at = close.end() if close else size
                continue
            unclosed.add(tag)  # no element: what follows is text
        if tag in _BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCK:
                    break
            heading = tag in _HEADINGS
        if tag in _VOID or tag in _RAW or single and tag not in _BLOCK:
            continue
        if tag in ("article", "main"):  # a menu or sidebar that is never closed ends here
            for i, (open_tag, *_) in enumerate(stack):
                if open_tag in _OUTSIDE and balance.open_after(open_tag, begin, sum(x[0] == open_tag for x in stack[i:])):
                    del stack[i:]
                    break
        _, inside, main, outside, header, mark = stack[-1] if stack else ground
        out, named, weak, readers, is_main = _marked(tag, attributes)
        outside |= out or tag in _OUTSIDE
        if (tag == "article" or tag == "main" or is_main) and not named and not outside:
            above = mark
            while above is not None:  # an element around an article is no sidebar
                above.live &= not above.weak
                above = above.above
        if named:
            mark = Mark(weak, mark, readers)
        if tag == "form":
            mark = Mark(True, mark, form=True)
        stack.append((tag, inside or tag == "article" and not outside and not named, main or tag == "main" or is_main, outside, header or tag == "header", mark))
    flush()
    return _settled(found)


def suffix_array(token: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of a sequence in order, and the ranks of all places by their first 1, 2, 4, ... tokens.

    Prefix doubling: the rank by twice as many tokens follows from the pair of a place's rank and that of the place as far ahead.  With a
    ``limit``, suffixes are told apart by so many tokens only.
    """
    n = len(token)
    _, rank = np.unique(token, return_inverse=True)
    rank = rank.astype(np.int64)
    levels, width = [rank], 1
    while width < (limit or n) and n and rank.max() < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        _, rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)
        rank = rank.astype(np.int64)
        levels.append(rank)
        width *= 2
    return np.argsort(rank, kind="stable"), levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The tokens that each suffix shares with the one before it in order, 0 for the first, from the ranks of all widths."""
    n = len(order)
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[level], [-1, -2])  # past the end nothing is shared
        same = rank[np.minimum(a, n)] == rank[np.minimum(b, n + 1)]
        step = np.where(same, 1 << level, 0)
        shared += step
        a += step
        b += step
    return np.concatenate([np.zeros(min(1, n), np.int64), shared])


@dataclass
class Runs:
    """Repeats among the streams of some pages: each place whose next REPEAT tokens stand elsewhere too, by run."""

    words: Words
    place: np.ndarray  # the word at which a copy begins, sorted by run
    run: np.ndarray  # its run
    name: np.ndarray  # of each run: a hash of its first REPEAT tokens
    pages: np.ndarray  # of each run: on how many distinct pages it is


def runs_of(texts: list[str], page: np.ndarray, alone: bool = False) -> Runs:
    """Runs of the streams of ``texts`` (``page``: the page of each); with ``alone`` also those that occur once."""
    data, offsets = raw_strings(pa.array(texts, pa.string()))
    words = Words(data, offsets)
    n = len(words.start)
    empty = np.empty(0, np.int64)
    if not n:
        return Runs(words, empty, empty, empty, empty)
    hashes, owner = words.hashes(), page[words.doc]
    _, token = np.unique(hashes, return_inverse=True)
    # an end of its own after each page, so that no repeat goes beyond a page
    last = np.append(np.flatnonzero(owner[1:] != owner[:-1]), n - 1)
    stream = np.insert(token, last + 1, token.max() + 1 + np.arange(len(last)))
    place_of = np.insert(np.arange(n), last + 1, -1)
    order, levels = suffix_array(stream)
    shared = common_prefixes(order, levels)
    place = place_of[order]
    reach = np.zeros(n, np.int64)  # whole runs end on their page
    reach[:] = np.repeat(last + 1, np.diff(np.concatenate([[-1], last]))) - np.arange(n)
    begins = (shared < REPEAT) | (place < 0)
    number = np.cumsum(begins) - 1
    fine = (place >= 0) & (reach[place] >= REPEAT)
    if not alone:
        fine &= np.bincount(number)[number] > 1
    place, number = place[fine], number[fine]
    kept, run = np.unique(number, return_inverse=True)
    several = int(owner[-1]) + 1
    pages = np.bincount(np.unique(run * several + owner[place]) // several, minlength=len(kept))
    acc = np.zeros(len(kept), np.uint64)
    first = place[np.searchsorted(run, np.arange(len(kept)))]
    for i in range(REPEAT):
        acc = mix(acc * np.uint64(3) + hashes[first + i])
    return Runs(words, place, run, acc.astype(np.int64), pages)


def _markup_decides(own: list[Block]) -> tuple[bool, bool]:
    return any(b.inside and not b.excluded() for b in own), any(b.main and not b.excluded() for b in own)


def _stream(found: list[list[Block]]) -> tuple[list[str], np.ndarray]:
    return [x.text for b in found for x in b], np.array([i for i, b in enumerate(found) for _ in b], np.int64)


def _unique_runs(block: Block, gone: np.ndarray, words: Words, first: int, at: int) -> list[str]:
    """What a block's repeated tokens leave, as one text for each unbroken run."""
    if not gone.any():
        return [block.text]
    base, raw = words.offsets[at], block.text.encode()
    runs = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return [raw[words.start[first + a] - base : words.end[first + z - 1] - base].decode(errors="ignore") for a, z in zip(runs[::2], runs[1::2], strict=True)]


def extract(pages: list[str | None], frequent: np.ndarray | None = None) -> list[tuple[str, int]]:
    """For pages of a host: main text, and how many of the removed tokens repetition marks.

    ``frequent``: names of runs that are frequent on the host besides those that are so on these pages.
    """
    found = [blocks(p) for p in pages]
    texts, owner = _stream(found)
    r = runs_of(texts, owner, alone=frequent is not None and len(frequent) > 0)
    boilerplate = r.pages >= MIN_PAGES
    if frequent is not None:
        boilerplate |= np.isin(r.name, frequent)
    hits = r.place[boilerplate[r.run]]
    edge = np.zeros(len(r.words.start) + REPEAT + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + REPEAT, -1)
    covered = np.cumsum(edge[: len(r.words.start)]) > 0
    out, at = [], 0
    for own in found:
        in_article, in_main = _markup_decides(own)
        spans = [covered[r.words.ptr[i] : r.words.ptr[i + 1]] for i in range(at, at + len(own))]
        for level in (0, 1, 2):  # names do not leave a page without text
            kept, removed = [], 0
            for b, gone, i in zip(own, spans, range(at, at + len(own)), strict=True):
                if b.excluded(level) or in_article and not b.inside or not in_article and in_main and not b.main:
                    removed += int(gone.sum())
                elif in_article or in_main:
                    kept.append(b.text)
                else:
                    kept += _unique_runs(b, gone, r.words, r.words.ptr[i], i)
                    removed += int(gone.sum())
            if kept:
                break
        at += len(own)
        out.append(("\n\n".join(kept), removed))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars, n_repeated)`` of every page; a null html is empty, an empty page has an empty text.

    Pages of a host are sliced by hash of their id and url, so a host of any size is spread; a null url has the empty host.
    Repeated rows are one page to the counts, and each has its own row in the result.
    Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", url_host(F.col("url")))
    big = durable(rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > SLICE_PAGES))
    if big.count() <= 100_000:
        big = F.broadcast(big)
    slices = F.ceil(F.col("n") / SLICE_PAGES)
    sliced = rows.join(big, "host", "left").withColumn("slice", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url"), slices)).cast("int"))
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    sliced = sliced.drop("n")
    hosts = durable(rows.join(big.select("host"), "host", "left_semi").select("host", "html").mapInArrow(_undecided, "host string").distinct())
    few = hosts.count() <= 100_000
    counted = sliced.join(F.broadcast(hosts) if few else hosts, "host", "left_semi").repartition("host", "slice").sortWithinPartitions("host", "slice")
    counted = durable(counted.mapInArrow(_by_slice(_count_slice), "host string, slice int, run long, n long"))
    frequent = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAGES).drop("n")
    of_slices = counted.drop("n").join(frequent, ["host", "run"], "left_semi")
    dealt = sliced.unionByName(of_slices, allowMissingColumns=True).repartition("host", "slice").sortWithinPartitions("host", "slice")
    return dealt.mapInArrow(_by_slice(_extract_slice), f"page_id {id_type}, url {url_type}, text string, n_chars long, n_repeated long")


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts of the pages where repetition decides."""
    for batch in batches:
        found = set()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if host not in found and (own := blocks(page)) and not any(_markup_decides(own)):
                found.add(host)
        yield pa.record_batch([pa.array(sorted(found), pa.string())], ["host"])


def _count_slice(table: pa.Table) -> pa.RecordBatch:
    """On how many distinct pages of a slice each run is; repeated rows are one page and lie in one slice."""
    pages = dict.fromkeys(zip(*(table.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
    texts, owner = _stream([blocks(html) for _, _, html in pages])
    r = runs_of(texts, owner, alone=True)
    host, at = table.column("host")[0].as_py(), table.column("slice")[0].as_py()
    return pa.record_batch(
        [pa.array([host] * len(r.name), pa.string()), pa.array(np.full(len(r.name), at, np.int32)), pa.array(r.name), pa.array(r.pages.astype(np.int64))], ["host", "slice", "run", "n"]
    )


def _extract_slice(table: pa.Table) -> pa.RecordBatch:
    """The pages of a slice, by those of its runs that are frequent on the host (rows with a run)."""
    frequent = table.column("run").drop_null().to_numpy()
    one = table.filter(pc.is_null(table.column("run"))).combine_chunks().to_batches()[0]
    pages = one.column("html").to_pylist()
    distinct = dict.fromkeys(zip(one.column("page_id").to_pylist(), one.column("url").to_pylist(), pages, strict=True))
    found = dict(zip(distinct, extract([html for _, _, html in distinct], frequent), strict=True))  # repeated rows are one page
    texts, removed = zip(*(found[row] for row in zip(one.column("page_id").to_pylist(), one.column("url").to_pylist(), pages, strict=True)), strict=True)
    return pa.record_batch(
        [one.column("page_id"), one.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64())],
        ["page_id", "url", "text", "n_chars", "n_repeated"],
    )


def _by_slice(of_slice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            hosts, slices = batch.column("host").to_pylist(), batch.column("slice").to_pylist()
            first = 0
            for i in range(batch.num_rows + 1):
                here = (hosts[i], slices[i]) if i < batch.num_rows else None
                if i == batch.num_rows or here != key:
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    first = i
                    if here is not None:
                        if held:
                            yield of_slice(pa.Table.from_batches(held))
                            held = []
                        key = here
        if held:
            yield of_slice(pa.Table.from_batches(held))

    return run
