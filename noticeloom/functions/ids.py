"""Identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(source: Column, source_id: Column) -> Column:
    """24 hexadecimal digits of ``sha256(source::id)``."""
    return F.substring(F.sha2(F.concat(source, F.lit("::"), source_id.cast("string")), 256), 1, 24)


def short_hash(*parts: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def fallback_id(native: Column, title: Column, reference: Column) -> Column:
    """The portal's id, or ``hash:`` and a hash of title and reference."""
    return F.coalesce(F.nullif(F.trim(native), F.lit("")), F.concat(F.lit("hash:"), short_hash(title, reference)))


def content_hash(*columns: Column) -> Column:
    """Over canonical JSON; nulls are part of it."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.concat_ws("\x1f", *parts))), 256)
