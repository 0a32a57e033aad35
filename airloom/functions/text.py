"""Slugs and the row checks of the site dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Key made from a display name. Anything but a-z, 0-9, spaces and hyphens is dropped, not transliterated."""
    kept = F.regexp_replace(F.lower(name), r"(?U)[^a-z0-9\s-]", "")
    hyphened = F.regexp_replace(F.regexp_replace(kept, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "-")
    return F.regexp_replace(F.regexp_replace(hyphened, r"-+", "-"), r"^-|-$", "")


def lookup_slug(name: Column) -> Column:
    """Key guessed from free input: every run of other characters becomes one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def clean(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def site_errors(*, required: bool = True) -> Column:
    """Codes of the broken rules of a site row, in a fixed order; empty when the row is fine.

    With ``required=False`` (partial updates) absent fields are not checked.
    """
    def broken(code: str, field: str, ok: Column) -> Column:
        present = F.col(field).isNotNull()
        failed = (~present | ~ok) if required else (present & ~ok)
        return F.when(failed, F.lit(code))

    def sized(field: str, longest: int) -> Column:
        return F.length(field).between(1, longest)

    zone = F.col("timezone")
    return F.array_compact(F.array(
        broken("name_length", "name", sized("name", 100)),
        broken("country_length", "country", sized("country", 100)),
        broken("country_code_format", "country_code", F.col("country_code").rlike("^[A-Z]{2}$")),
        broken("latitude_range", "latitude", F.col("latitude").between(-90.0, 90.0)),
        broken("longitude_range", "longitude", F.col("longitude").between(-180.0, 180.0)),
        broken("timezone_format", "timezone", sized("timezone", 50) & (zone.contains("/") | (zone == "UTC"))),
    ))
