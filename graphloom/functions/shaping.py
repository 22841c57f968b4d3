"""Small value shaping: quotes, shares, sizes, display names, property bags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """Text in single quotes, as messages show names."""
    return F.concat(F.lit("'"), text, F.lit("'"))


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, one decimal, ties to even; null if whole is zero."""
    return F.bround(F.try_divide(part * F.lit(100.0), whole), 1)


def size_label(size: Column) -> Column:
    """Bytes with the largest fitting unit up to GB, one decimal, without a trailing zero.

    Plain bytes go to the even number at a half.  Of larger units the double is taken in whole millionths
    first, halves up, then in tenths, halves up: as the cast of SQL does it, and not by the shortest text of the double."""
    size = size.cast("double")

    def scaled(power: int, unit: str) -> Column:
        millionths = size / 1024**power * 1e6
        whole = F.floor(millionths)
        whole += F.when(millionths - whole >= 0.5, 1).otherwise(0)
        value = F.round(whole.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"), 1).cast("string")
        return F.concat(F.regexp_replace(value, r"\.0$", ""), F.lit(f" {unit}"))

    return F.when(size < 1024, F.format_string("%.0f B", F.rint(size))).when(size < 1024**2, scaled(1, "KB")).when(size < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def shares_label(stats: Column) -> Column:
    """A language map as text, largest share first, ties by name."""
    entries = F.array_sort(F.map_entries(stats), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit(" "), F.regexp_replace(F.round(e["value"], 1).cast("string"), r"\.0$", ""), F.lit("%")))
    return F.when(F.size(entries) == 0, F.lit("No languages detected")).otherwise(F.array_join(shown, ", "))


def stem(name: Column) -> Column:
    """A file name without folder and last suffix."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]+$", "")


def clamped(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def depth_within(value: Column, most: int) -> Column:
    """A requested depth cut to whole numbers from 1 to most; 1 for anything that is no number."""
    whole = F.when(F.isnan(value) | value.isNull() | (F.abs(value) == float("inf")), F.lit(1.0)).otherwise(F.least(F.greatest(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double"), F.lit(1.0)), F.lit(float(most))))
    return whole.cast("int")


def iso_time(time: Column) -> Column:
    """A time as ISO 8601 text in UTC, with microseconds only where there are any."""
    utc = F.to_utc_timestamp(time, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.when(F.unix_micros(time) % 1_000_000 == 0, whole).otherwise(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit("+00:00"))


def properties(columns: list[str], times: tuple[str, ...] = ()) -> Column:
    """A map of the non-null columns, values as text; those named in times as ISO 8601."""
    bag = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[iso_time(F.col(c)) if c in times else F.col(c).cast("string") for c in columns]))
    return F.map_filter(bag, lambda _, v: v.isNotNull())
