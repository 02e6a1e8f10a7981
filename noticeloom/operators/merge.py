"""Upsert of canonical rows: null-preserving merge, tracked changes with severity, revisions, no-op suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.ids import content_hash
from ..schema import SECTIONS, canonical_schema

CRITICAL = ("bid_submission_end", "bid_opening_at")
IMPORTANT = ("estimated_value", "emd_amount", "tender_fee")
LAST_CHANGES = 50


def replaced_array(fresh: Column, old: Column) -> Column:
    """Arrays are replaced whole, by a non-empty one only."""
    return F.when(F.coalesce(F.size(fresh), F.lit(0)) > 0, fresh).otherwise(old)


def merged(kind: DataType, fresh: Column, old: Column) -> Column:
    """A fresh value over a stored one, down through structs: a null never blanks, an array is replaced by a non-empty one only."""
    if isinstance(kind, StructType):
        both = F.struct(*[merged(f.dataType, fresh[f.name], old[f.name]).alias(f.name) for f in kind])
        return F.when(fresh.isNull(), old).when(old.isNull(), fresh).otherwise(both)
    return replaced_array(fresh, old) if isinstance(kind, ArrayType) else F.coalesce(fresh, old)


def merge_canonical(store: DataFrame, incoming: DataFrame, seen_at: Column) -> DataFrame:
    """Canonical rows of both sides by ``canonical_id``, with ``is_new`` and ``changed``; each side has one row an id.

    Sections merge field by field; documents and corrigenda are replaced by non-empty ones, an award whole; the status is the fresh one; an
    empty duplicate group keeps the stored.  Of the provenance only the scrape, the parser, the last sighting and the content hash are fresh: the first
    sighting stays.  ``changed`` holds for rows of both sides that differ but for their provenance, or whose stored hash is another.
    """
    key, schema = "canonical_id", canonical_schema()
    joined = store.select(F.col(key).alias("old_id"), F.struct(*schema.names).alias("old")).join(
        incoming.select(F.col(key).alias("new_id"), F.struct(*schema.names).alias("new")), F.col("old_id") == F.col("new_id"), "full_outer"
    )
    both, old, new = F.col("old_id").isNotNull() & F.col("new_id").isNotNull(), F.col("old"), F.col("new")
    values = {name: old[name] for name in schema.names}
    for name in (*SECTIONS, "documents", "corrigenda"):
        values[name] = merged(schema[name].dataType, new[name], old[name])
    values["award"], values["status"] = F.coalesce(new["award"], old["award"]), new["status"]
    values["possible_duplicate_group"] = F.coalesce(F.nullif(new["possible_duplicate_group"], F.lit("")), old["possible_duplicate_group"])
    body = [name for name in schema.names if name != "provenance"]
    rows = joined.select("old", "new", both.alias("both"), *[F.when(both, values[n]).otherwise(F.coalesce(old[n], new[n])).alias(n) for n in body])
    rows = rows.withColumn("hash", content_hash(*[F.col(n) for n in body]))
    fresh = {"last_seen_at": seen_at, "scraped_at": new["provenance"]["scraped_at"], "parser_version": new["provenance"]["parser_version"], "content_hash": F.col("hash")}
    provenance = F.struct(*[fresh.get(f.name, old["provenance"][f.name]).cast(f.dataType).alias(f.name) for f in schema["provenance"].dataType])
    same = F.struct(*[F.col(n) for n in body]).eqNullSafe(F.struct(*[old[n] for n in body])) & old["provenance"]["content_hash"].eqNullSafe(F.col("hash"))
    whole = F.when(F.col("both"), provenance).otherwise(F.coalesce(old["provenance"], new["provenance"])).alias("provenance")
    return rows.select(*[whole if n == "provenance" else F.col(n) for n in schema.names], old.isNull().alias("is_new"), (F.col("both") & ~same).alias("changed"))


def severity(field: Column) -> Column:
    last = F.element_at(F.split(field, r"\."), -1)
    important = last.isin(*IMPORTANT) | field.startswith("eligibility.") | field.startswith("status")
    return F.when(last.isin(*CRITICAL), "CRITICAL").when(important, "IMPORTANT").otherwise("REVIEW")


def changes(tracked: dict[str, tuple[Column, Column]]) -> Column:
    """``array<struct<field, old, new>>`` of the tracked fields (name to old and new value) that differ; nulls are values."""
    rows = [
        F.when(~old.eqNullSafe(new), F.struct(F.lit(name).alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new")))
        for name, (old, new) in tracked.items()
    ]
    return F.array_compact(F.array(*rows))


def change_text(change: Column) -> Column:
    label = F.replace(F.element_at(F.split(change["field"], r"\."), -1), F.lit("_"), F.lit(" "))
    return (
        F.when(change["field"] == "corrigenda.count", F.concat(F.lit("corrigendum added ("), change["new"], F.lit(" total)")))
        .when(change["old"].isNull(), F.concat(label, F.lit(" set to "), F.coalesce(change["new"], F.lit("None"))))
        .otherwise(F.concat(label, F.lit(": "), change["old"], F.lit(" → "), F.coalesce(change["new"], F.lit("None"))))
    )


def change_summary(found: Column) -> Column:
    text = F.array_join(F.transform(found, change_text), "; ")
    return F.when(F.size(found) > 0, text).otherwise("no tracked changes")


def append_history(old: Column, new: Column, keep: int = LAST_CHANGES) -> Column:
    both = F.concat(F.coalesce(old, F.array()), new)
    return F.slice(both, F.greatest(F.lit(1), F.size(both) - (keep - 1)), keep)


def upsert(store: DataFrame, incoming: DataFrame, key: str, columns: list[str], tracked: dict[str, str], overwritten: tuple[str, ...] = (), grown: tuple[str, ...] = ()) -> DataFrame:
    """One row per key of either side: merged columns (see ``merged``), ``changes``, ``revision``, ``is_new``, ``is_noop``.

    ``tracked`` maps a field's published name to its column; columns in ``grown`` count as changed only if they grow;
    ``overwritten`` columns take the fresh value even if it is null.  ``store`` may have ``revision``.  One shuffle on the key.
    """
    old, new = store.alias("old"), incoming.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    is_new, untouched = F.col(f"old.{key}").isNull(), F.col(f"new.{key}").isNull()
    over = lambda c: F.col(f"new.{c}") if c in overwritten else merged(store.schema[c].dataType, F.col(f"new.{c}"), F.col(f"old.{c}"))
    fresh = lambda c: F.when(untouched, F.col(f"old.{c}")).when(is_new, F.col(f"new.{c}")).otherwise(over(c))
    pairs = {}
    for name, column in tracked.items():
        before, after = F.col(f"old.{column}"), fresh(column)
        pairs[name] = (before, F.when(after > before, after).otherwise(before) if column in grown else after)
    found = F.when(is_new | untouched, F.array().cast("array<struct<field:string,old:string,new:string>>")).otherwise(changes(pairs))
    previous = F.coalesce(F.col("old.revision"), F.lit(0)) if "revision" in store.columns else F.when(is_new, 0).otherwise(1)
    same = ~is_new
    for c in columns:
        same = same & F.col(f"old.{c}").eqNullSafe(fresh(c))
    out = joined.select(F.coalesce(f"old.{key}", f"new.{key}").alias(key), *[fresh(c).alias(c) for c in columns], found.alias("changes"), is_new.alias("is_new"), same.alias("is_noop"), previous.alias("_previous"))
    moved = (F.col("is_new") | (F.size("changes") > 0)).cast("int")
    return out.withColumn("revision", (F.col("_previous") + moved).cast("int")).drop("_previous")
