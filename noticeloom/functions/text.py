"""Text functions, Column to Column."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ELLIPSIS = "…"


@F.pandas_udf(StringType())
def _unescape_twice(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(html.unescape(t)))


def clean_text(text: Column, limit: int | None = 8000) -> Column:
    """Entities decoded twice, then :func:`squeeze_text`."""
    out = F.when(text.contains("&"), _unescape_twice(text)).otherwise(text)
    return squeeze_text(out, limit)


def squeeze_text(text: Column, limit: int | None = 8000) -> Column:
    """Control characters become blanks, runs of blanks one, none round a line break, two line breaks at most, '' becomes null.

    A longer text is cut after ``limit`` characters and ends in an ellipsis.  JVM-side only.
    """
    out = F.regexp_replace(text, "\u00a0", " ")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    out = F.regexp_replace(out, r"[ \t\r]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")
    if limit is not None:
        cut = F.concat(F.regexp_replace(F.substring(out, 1, limit), r"[\s\p{Z}\x{85}]+$", ""), F.lit(ELLIPSIS))
        out = F.when(F.length(out) > limit, cut).otherwise(out)
    return F.nullif(out, F.lit(""))


def safe_filename(name: Column, default: str = "download.bin") -> Column:
    """The last part of a path in letters, digits, dots, lines and dashes; at most 180 characters."""
    base = F.element_at(F.split(F.coalesce(name, F.lit("")), r"[/\\]"), -1)
    base = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9.-]+", "_"), r"^[._]+|[._]+$", "")
    base = F.regexp_replace(base, r"_(?=\.)|(?<=\.)_", "")
    return F.substring(F.when(base.isin("", ".", ".."), F.lit(default)).otherwise(base), 1, 180)


def looks_like_url(text: Column) -> Column:
    return F.coalesce(text.startswith("http://") | text.startswith("https://"), F.lit(False))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def xml_legal(text: Column) -> Column:
    """Characters that XML 1.0 does not allow are removed."""
    return F.regexp_replace(text, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def csv_guard(text: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get a leading apostrophe."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def ics_escape(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\;,])", r"\\$1")
    return F.regexp_replace(out, r"\r?\n", r"\\n")


def normalise_title(title: Column) -> Column:
    """Lower case; all but a-z, 0-9, blanks and Devanagari become blanks; squeezed.  Null becomes ''."""
    out = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9ऀ-ॿ ]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def state_key(state: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(state, F.lit(""))), "&", " and ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def term_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\s/\\_-]+"), lambda t: t != ""))


def org_chain(text: Column) -> Column:
    """``A||B`` becomes ``A › B``, at most 500 characters."""
    parts = F.filter(F.transform(F.split(text, r"\|\|"), lambda p: F.trim(p)), lambda p: p != "")
    return F.substring(F.array_join(parts, " › "), 1, 500)


def authority_parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"›|\|+"), lambda p: F.trim(p)), lambda p: p != "")


#: Fixed value: the form of a portal's own notice number.
NATIVE_ID = r"\d{4}_[A-Z0-9]+_\d+_\d+"


def split_title_block(text: Column) -> Column:
    """(title, ref, native) of ``Title [number] [ref]`` or ``[Title] [ref][number]``: brackets are told by the number's form."""
    brackets = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), 1), lambda p: F.trim(p)), lambda p: p != "")
    native = F.filter(brackets, lambda p: p.rlike(f"^{NATIVE_ID}$"))
    others = F.filter(brackets, lambda p: ~p.rlike(f"^{NATIVE_ID}$"))
    outside = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[[^\[\]]+\]", " "), r"\s+", " "), r"^[ :-]+|[ :-]+$", "")
    named = outside != ""
    return F.struct(
        squeeze_text(F.when(named, outside).otherwise(F.get(others, F.lit(0)))).alias("title"),
        squeeze_text(F.when(named, F.get(others, F.lit(0))).otherwise(F.get(others, F.lit(1))), 200).alias("ref"), F.get(native, F.lit(0)).alias("native"),
    )


def feed_href(path: Column) -> Column:
    """Relative feed paths only: no scheme, no parent folder."""
    fine = path.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~path.contains("..") & ~path.contains(":")
    return F.when(fine, path)


def captcha_seen(page: Column) -> Column:
    lowered = F.lower(F.coalesce(page, F.lit("")))
    found = F.lit(False)
    for marker in ("captchaimage", "captcha_image", "enter captcha", "g-recaptcha", "captchatext"):
        found = found | lowered.contains(marker)
    return found
