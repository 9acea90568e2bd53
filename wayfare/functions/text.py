"""Text and record expressions of the station gazetteers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions.constants import NETWORK_WORDS, OPERATOR_WORDS, RAILWAY_KINDS, STATION_KINDS


def normal(x: Column) -> Column:
    """Trimmed, lower-cased, white space runs as one space; null as the empty text."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def either(x: Column, y: Column) -> Column:
    """x unless it is null or empty, else y."""
    return F.coalesce(F.nullif(x, F.lit("")), y)


def number_in(x: Column) -> Column:
    """All digits of a text as one number, 0 where there is none."""
    return F.coalesce(F.regexp_replace(x, "[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))


def confidence(meters: Column) -> Column:
    return F.when(meters <= 300, "high").when(meters <= 800, "medium").otherwise("low")


def is_transit(network: Column, operator: Column, station: Column, railway: Column) -> Column:
    has = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.upper(F.coalesce(x, F.lit(""))), w))
    return has(network, NETWORK_WORDS) | has(operator, OPERATOR_WORDS) | F.coalesce(station.isin(STATION_KINDS), F.lit(False)) | F.coalesce(railway.isin(RAILWAY_KINDS), F.lit(False))


def on_line(ref: Column, name: Column, patterns: Column, hints: Column) -> Column:
    """Whether a part of ref (cut at `;`, trimmed) fits one of the anchored patterns; by name only where ref is empty."""
    parts = F.transform(F.split(F.coalesce(ref, F.lit("")), ";"), lambda r: F.trim(r))
    by_ref = F.exists(parts, lambda r: F.exists(patterns, lambda p: F.rlike(r, F.concat(F.lit("(?U)"), p))))
    return by_ref | ((F.coalesce(ref, F.lit("")) == "") & F.coalesce(F.array_contains(hints, name), F.lit(False)))


def km_text(km: Column) -> Column:
    """One decimal of the number as it is stored, as printf has it: 37.65 is a little less, so it gives 37.6 (Java's %.1f rounds the text 37.65, to 37.7)."""
    size = F.abs(km)
    n = F.floor(size * 10)
    over = (16 * size - (2 * n + 1)) + 4 * size  # 20 * size - (2 * n + 1); near a tie neither step is rounded
    tenths = n + ((over > 0) | ((over == 0) & (n % 2 == 1))).cast("long")
    return F.concat(F.when(km < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" km"))


def value_text(value: Column, view: Column) -> Column:
    """A value rounded half up with its unit: `35 THB` in the cost view, `12 min` in the time view."""
    return F.concat_ws(" ", F.floor(value + 0.5).cast("string"), F.when(view == "cost", "THB").otherwise("min"))


def label_lines(name: Column, other: Column, code: Column, km: Column, value: Column, view: Column) -> Column:
    """The lines of a station's label: its name (else its code), its other name, its code in capitals, and how far and how much."""
    return F.array(either(name, code), F.coalesce(other, F.lit("")), F.upper(code), F.concat_ws(" | ", km_text(km), value_text(value, view)))
