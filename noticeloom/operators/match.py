"""Profile matching, similar notices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import seconds_until


# Fixed values below: points and the wording of reasons.


@dataclass(frozen=True)
class Profile:
    industries: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    services: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    min_size: float | None = None
    max_size: float | None = None
    msme: bool = False
    startup: bool = False


def match(profile: Profile, now: Column) -> Column:
    """``struct<score int, reasons array<string>>``."""
    category, title = F.lower(F.coalesce("category", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    interest = F.lit(None).cast("string")
    for wish in reversed([w.lower() for w in (*profile.industries, *profile.products, *profile.services) if w]):
        interest = F.when(category.contains(wish) | title.contains(wish), wish).otherwise(interest)
    in_state = F.coalesce(F.col("state").isin(*profile.states), F.lit(False)) if profile.states else F.lit(False)
    low, high = profile.min_size or 0.0, profile.max_size if profile.max_size is not None else float("inf")
    value = F.col("value")
    days = seconds_until(F.col("closing_at"), now) / 86400
    member = profile.msme or profile.startup
    score = (
        F.when(interest.isNotNull(), 30).otherwise(0)
        + (F.when(in_state, 20).otherwise(0) if profile.states else F.lit(10))
        + F.when(value.between(low, high), 25).otherwise(0)
        + F.lit(7 if member else 0)
        + F.when(days >= 7, 10).when(days >= 3, 5).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(interest.isNotNull(), F.concat(F.lit('Matches your interest "'), interest, F.lit('"'))),
            F.when(in_state, F.concat(F.lit("In your preferred state ("), F.col("state"), F.lit(")"))),
            F.when(value.between(low, high), "Contract size fits your range").when(value < low, "Below your minimum contract size").when(value > high, "Above your maximum contract size"),
            F.lit("MSME status may earn exemptions" if profile.msme else "Startup status may earn exemptions" if profile.startup else None),
            F.when(days >= 7, F.lit(None)).when(days >= 3, "Deadline is tight (<7 days)").when(days >= 0, "Closes very soon — review immediately"),
        )
    )
    return F.struct(F.least(F.lit(100), score).cast("int").alias("score"), reasons.alias("reasons"))


def bucket(score: Column) -> Column:
    return F.when(score >= 60, "strong").when(score >= 35, "maybe")


def similar(df: DataFrame, item_id: int | str, top: int = 5) -> DataFrame:
    """Active notices like one: 2 points for the state, 3 for the category, 2 for the authority (nulls are equal), 2 if more than two
    of their title's words, repeats included, are found somewhere in its title.

    The one notice is a single broadcast row.
    """
    one = df.where(F.col("id") == item_id).limit(1)
    one = one.select(*[F.col(c).alias(f"_{c}") for c in ("id", "state", "category", "authority", "title")])
    words = F.split(F.lower(F.coalesce("title", F.lit(""))), r"(?U)\s+")
    shared = F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce("_title", F.lit(""))), w)))
    points = sum((F.when(F.col(c).eqNullSafe(F.col(f"_{c}")), n).otherwise(0) for c, n in (("state", 2), ("category", 3), ("authority", 2))), F.lit(0))
    points = points + F.when(shared > 2, 2).otherwise(0)
    others = df.where("status = 'active'").join(F.broadcast(one), how="cross").where("id <> _id")
    return others.withColumn("points", points).where("points >= 4").orderBy(F.desc("points"), "id").limit(top).select("id", "points")
