"""Query text: parsing into a :class:`Query`, URL form, and ranked retrieval over fields."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce
from operator import or_
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .durable import durable
from .filters import EXACT_FIELDS, Query, exact_match, keyword_all

# Unit words, phrases and state names as readers type them.
STATE_NAMES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh",
    "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha",
    "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal", "Delhi",
    "Jammu and Kashmir", "Ladakh", "Puducherry", "Chandigarh", "Lakshadweep", "Andaman and Nicobar Islands",
)
STATE_ALIASES = {
    "jammu & kashmir": "Jammu and Kashmir", "j&k": "Jammu and Kashmir", "j & k": "Jammu and Kashmir", "jammu": "Jammu and Kashmir",
    "kashmir": "Jammu and Kashmir", "andaman and nicobar": "Andaman and Nicobar Islands", "andaman & nicobar islands": "Andaman and Nicobar Islands",
    "andaman & nicobar": "Andaman and Nicobar Islands", "new delhi": "Delhi", "orissa": "Odisha", "pondicherry": "Puducherry", "uttaranchal": "Uttarakhand",
}
SOURCE_WORDS = {"gem": "gem_bids", "ge marketplace": "gem_bids", "cppp": "cppp_epublish", "epublish": "cppp_epublish", "central public procurement": "cppp_epublish", "ireps": "ireps"}
# The words of bounds and units, and filler words.  A space separates words, a bar alternatives; ``?`` may be missing.
AT_LEAST = ("above", "over", "more than", "at least", "min", "minimum", ">", ">=")
AT_MOST = ("below", "under", "less than", "up to", "upto", "max", "maximum", "<", "<=")
UNITS = {"crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5}
CURRENCY = "₹|rs|inr? .?"
WITHIN = ("closing within DAYS day|days", "within|next DAYS day|days")
FILLER = frozenset("closing open with for from the and of in".split())
_TOKEN = re.compile(r"[<>]=?|\d[\d,]*(?:\.\d+)?|[^\W\d_]+|\S")


class _Scan:
    """The tokens of a text; phrases that are found are used up, and what is left are the keywords."""

    def __init__(self, text: str):
        self.text = text
        found = list(_TOKEN.finditer(text))
        self.words = [m[0].lower() for m in found]
        self.spans = [m.span() for m in found]
        self.free = [True] * len(found)

    def _fits(self, at: int, phrase: list[str]) -> tuple[int, list[str]] | None:
        """Where the phrase ends if it begins at a token, and its numbers and units."""
        caught = []
        for step in phrase:
            word = self.words[at] if at < len(self.words) and self.free[at] else None
            optional, step = step.endswith("?") and len(step) > 1, step.removesuffix("?")
            if step == "DAYS":
                fits = word is not None and word.isdigit() and len(word) <= 3
            elif step == "NUMBER":
                fits = word is not None and word[0].isdigit()
            elif step == "UNIT":
                fits = word in UNITS
            else:
                fits = word in step.split("|")
            if fits:
                if step.isupper():
                    caught.append(word)
                at += 1
            elif not optional:
                return None
        return at, caught

    def take(self, phrases, apart: str = "") -> tuple[str, list[str]] | None:
        """Uses up the first of the phrases, in their order, that is there; ``apart``: characters it may not touch."""
        for phrase in phrases:
            steps = phrase if isinstance(phrase, list) else phrase.split()
            for at in range(len(self.words)):
                got = self._fits(at, steps)
                if got and self._stands_apart(at, got[0], apart):
                    self.free[at : got[0]] = [False] * (got[0] - at)
                    return phrase, got[1]
        return None

    def _stands_apart(self, first: int, end: int, apart: str) -> bool:
        before, after = self.text[: self.spans[first][0]][-1:], self.text[self.spans[end - 1][1] :][:1]
        joined = lambda c: c and (apart == "any" and not c.isspace() or apart == "word" and (c.isalnum() or c in "_/-"))
        return not joined(before) and not joined(after)

    def earliest(self, phrases) -> list[str] | None:
        """As :meth:`take`, but of the phrases the one that begins first."""
        starts = [(at, -got[0], p) for p in phrases for at in range(len(self.words)) if (got := self._fits(at, p.split()))]
        if not starts:
            return None
        at, end, phrase = min(starts)
        caught = self._fits(at, phrase.split())[1]
        self.free[at:-end] = [False] * (-end - at)
        return caught

    def left(self) -> str:
        """What is not used up, word for word as typed, without filler words."""
        kept, at = "", 0
        for (first, last), free in zip(self.spans, self.free, strict=True):
            kept += self.text[at:first] + (self.text[first:last] if free else " ")
            at = last
        return " ".join(w for w in kept.split() if w.lower() not in FILLER)


def _tokens(phrase: str) -> list[str]:
    return [m[0].lower() for m in _TOKEN.finditer(phrase)]


def parse_query(text: str, states: dict[str, str] | None = None, sources: dict[str, str] | None = None) -> Query:
    """Days, month or week, lower and upper value, state, source word, then what is left without filler words."""
    scan, found = _Scan(text), {}
    if days := scan.take(WITHIN):
        found["closing_within_days"] = int(days[1][0])
    if scan.take(["closing? this month"]):
        found["closing_this_month"] = True
    elif scan.take(["closing? this week"]):
        found.setdefault("closing_within_days", 7)
    for name, bounds in (("min_value", AT_LEAST), ("max_value", AT_MOST)):
        if amount := scan.earliest([f"{bound} {CURRENCY} NUMBER UNIT" for bound in bounds]):
            found[name] = float(amount[0].replace(",", "")) * UNITS[amount[1]]
    for field, names, apart in (("state", states or {**STATE_ALIASES, **{n: n for n in STATE_NAMES}}, "word"), ("source", sources or SOURCE_WORDS, "any")):
        for name, meaning in names.items():
            if scan.take([_tokens(name)], apart):
                found[field] = meaning
                break
    return Query(keywords=scan.left(), **found)


_URL = {"state": "state", "source": "source", "status": "status", "category": "category", "sort": "sort"}


def to_url(query: Query) -> str:
    out = {"q": query.keywords or None, "min": query.min_value, "max": query.max_value, "within": query.closing_within_days,
           "month": "1" if query.closing_this_month else None, "unknown": "1" if query.include_unknown_value else None}
    out |= {name: getattr(query, attribute) for name, attribute in _URL.items()}
    return urlencode({k: v for k, v in out.items() if v is not None})


def from_url(text: str) -> Query:
    got = {k: v[-1] for k, v in parse_qs(text.lstrip("?")).items()}
    number = lambda k: float(got[k]) if re.fullmatch(r"\d+(\.\d+)?", got.get(k, "")) else None
    within = number("within")
    return Query(keywords=got.get("q", ""), min_value=number("min"), max_value=number("max"), closing_within_days=None if within is None else int(within),
                 closing_this_month=got.get("month") == "1", include_unknown_value=got.get("unknown") == "1", **{a: got.get(n) for n, a in _URL.items()})


def merge_hints(explicit: Query, parsed: Query, known_sources: set[str]) -> Query:
    """What the reader set wins; a source word counts only if that source exists."""
    out = explicit
    for name in ("state", "min_value", "max_value", "closing_within_days"):
        if getattr(out, name) is None:
            out = replace(out, **{name: getattr(parsed, name)})
    if out.source is None and parsed.source in known_sources:
        out = replace(out, source=parsed.source)
    return replace(out, keywords=parsed.keywords, closing_this_month=out.closing_this_month or parsed.closing_this_month)


#: Weight of a word that is only near a term.
FUZZY_WEIGHT = 0.45
#: Field weights of ranked retrieval.
BOOSTS = {"tender_number": 8.0, "ref": 6.0, "title": 3.5, "category": 2.0, "authority": 1.5, "state": 1.0, "city": 1.0}


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[|›]", " ")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def asked_terms(keywords: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", keywords.lower())))


def edits_of(term: str, fuzzy: float) -> int:
    """Edits within which a word is near ``term``; short terms and those with a digit have to be met exactly."""
    return 0 if len(term) <= 3 or any(c.isdigit() for c in term) else round(fuzzy * len(term))


def ranked(rows: DataFrame, fields: dict[str, float], n_terms: int, key: str, docs: int, means: dict[str, float], k1: float = 1.2, b: float = 0.7, delta: float = 0.5) -> DataFrame:
    """(key, terms, score) of ``rows`` with at least one term, by BM25+ (Lv and Zhai, 2011) per field and field weight.

    ``rows`` have for each field its length ``n_f``, and for each field and term how many words begin with the term, ``w_f_i``, and how many are only
    near it, ``c_f_i``.  ``terms`` is how many distinct query terms a row has.  Document frequencies are one aggregate row.
    """
    pairs = [(f, i) for i in range(n_terms) for f in fields]
    tf = {(f, i): F.col(f"w_{f}_{i}") + F.lit(FUZZY_WEIGHT) * F.col(f"c_{f}_{i}") for f, i in pairs}
    many = rows.agg(*[F.count_if(tf[p] > 0).alias(f"df_{p[0]}_{p[1]}") for p in pairs])
    scored = rows.join(F.broadcast(many), how="cross")
    hit = [reduce(or_, [tf[f, i] > 0 for f in fields]) for i in range(n_terms)]
    score = F.lit(0.0)
    for f, i in pairs:
        n, held = tf[f, i], F.col(f"df_{f}_{i}")
        idf = F.log(1 + (F.lit(float(docs)) - held + 0.5) / (held + 0.5))
        part = delta + n * (k1 + 1) / (n + k1 * (1 - b + b * F.col(f"n_{f}") / F.lit(float(means[f"mean_{f}"]))))
        score = score + F.when(n > 0, fields[f] * idf * part).otherwise(0.0)
    return scored.select(key, sum((h.cast("int") for h in hit), F.lit(0)).alias("terms"), score.alias("score"))


def search(df: DataFrame, keywords: str, boosts: dict[str, float] | None = None, key: str = "id", fuzzy: float = 0.0) -> DataFrame:
    """(id, terms, score) without an index (see ``textindex`` for a stored one): terms by prefix, see ``ranked``.

    With ``fuzzy`` words within ``round(fuzzy * length)`` edits of a term count too, at ``FUZZY_WEIGHT``; short terms and those with a
    digit never match so.  The table is read and cut into words once: rows with a term are written, and all else reads these.
    """
    asked = asked_terms(keywords)
    fields = {f: w for f, w in (boosts or BOOSTS).items() if f in df.columns}
    if not asked or not fields:
        return df.select(key, F.lit(0).alias("terms"), F.lit(0.0).alias("score")).limit(0)
    words = df.select(key, *[tokens(F.col(f)).alias(f"t_{f}") for f in fields])

    def counts(f: str, i: int) -> list[Column]:
        t, edits = asked[i], edits_of(asked[i], fuzzy)
        near = F.size(F.filter(f"t_{f}", lambda x: ~F.startswith(x, F.lit(t)) & (F.levenshtein(x, F.lit(t), edits) >= 0))) if edits else F.lit(0)
        return [F.size(F.filter(f"t_{f}", lambda x: F.startswith(x, F.lit(t)))).alias(f"w_{f}_{i}"), near.alias(f"c_{f}_{i}")]

    columns = [c for f in fields for c in (F.size(f"t_{f}").alias(f"n_{f}"), *(x for i in range(len(asked)) for x in counts(f, i)))]
    some = reduce(or_, [F.col(f"{mark}_{f}_{i}") > 0 for mark in "wc" for f in fields for i in range(len(asked))])
    all_rows = Observation()
    observed = words.select(key, *columns).observe(all_rows, F.count(F.lit(1)).alias("docs"), *[F.sum(F.col(f"n_{f}").cast("long")).alias(f"sum_{f}") for f in fields])
    rows = durable(observed.where(some))
    docs = all_rows.get["docs"]
    means = {f"mean_{f}": max((all_rows.get[f"sum_{f}"] or 0) / max(docs, 1), 1e-9) for f in fields}
    return ranked(rows, fields, len(asked), key, docs=docs, means=means)


def first_exact(found: DataFrame, exact: DataFrame, n_terms: int, key: str) -> DataFrame:
    """(key, score): ``exact`` rows at ten times the best score, at least ten, then the found rows with all terms, or with any if there are none."""
    found = durable(found)
    best = found.agg(F.max("terms").alias("most"), F.max("score").alias("top"), F.max(F.when(F.col("terms") == n_terms, F.col("score"))).alias("top_whole")).first()
    whole = best.most == n_terms
    hits = (found.where(F.col("terms") == n_terms) if whole else found).select(key, "score")
    first = exact.select(key, F.lit(10 * max(1.0, (best.top_whole if whole else best.top) or 1.0)).alias("score"))
    return first.unionByName(hits.join(exact.select(key), key, "left_anti"))


def search_hits(df: DataFrame, keywords: str, boosts: dict[str, float] | None = None, key: str = "id", fuzzy: float = 0.2) -> DataFrame:
    """(id, score): rows with all terms or, if there are none, with any; before them rows whose number or reference is the whole query."""
    found = search(df, keywords, boosts, key, fuzzy=fuzzy)
    return first_exact(found, df.where(exact_match(keywords)).select(key), len(asked_terms(keywords)), key)


def quick_search(df: DataFrame, keywords: str, limit: int = 50) -> DataFrame:
    """The first rows of a scan that hold every term; the scan ends with the last of them."""
    return df.where(keyword_all(keywords)).limit(limit) if keywords.strip() else df.limit(0)


def palette(df: DataFrame, keywords: str, top: int = 6) -> DataFrame:
    """The best few hits, for a list that opens while one types."""
    return search_hits(df, keywords).orderBy(F.desc("score"), "id").limit(top)
