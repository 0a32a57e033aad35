"""Units and quality flags of single readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airloom.functions.numeric import round_exact
from airloom.schemas import CANONICAL_UNITS, MISSING, PLAUSIBLE_BOUNDS, SUSPECT, VALID


def _map_text(pairs: dict) -> str:
    """A constant map as one SQL expression; built from columns it would take a call per entry."""
    return "map(" + ", ".join(f"'{key}', {value}" for key, value in pairs.items()) + ")"


_UNITS = _map_text({name: f"'{unit}'" for name, unit in CANONICAL_UNITS.items()})
_LOW, _HIGH = (_map_text({name: f"{pair[side]}D" for name, pair in PLAUSIBLE_BOUNDS.items()}) for side in (0, 1))


def canonical_unit(parameter: Column, otherwise: Column | None = None) -> Column:
    """Storage unit of a parameter; an unknown one keeps ``otherwise`` (default ``unknown``)."""
    known = F.try_element_at(F.expr(_UNITS), parameter)
    return F.coalesce(known, F.lit("unknown") if otherwise is None else otherwise)


def normalise_weather(parameter: Column, value: Column, unit: Column) -> Column:
    """Wind speed in km/h becomes m/s with two places; everything else is kept."""
    in_kmh = (parameter == "wind_speed") & (unit == "km/h")
    return F.when(in_kmh, round_exact(value / 3.6, 2)).otherwise(value)


def quality_flag(parameter: Column, value: Column) -> Column:
    """missing for NULL, suspect outside the inclusive plausible range, valid otherwise.

    Unknown parameters have no range and count as valid. NaN compares above every number and is suspect.
    """
    low, high = (F.try_element_at(F.expr(table), parameter) for table in (_LOW, _HIGH))
    outside = (value < low) | (value > high)
    return F.when(value.isNull(), MISSING).when(outside, SUSPECT).otherwise(VALID)
