"""Small formatting and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_key(surah: Column, ayah: Column) -> Column:
    return F.concat(F.lpad(surah.cast("string"), 3, "0"), F.lpad(ayah.cast("string"), 3, "0"))


def colon_key(surah: Column, ayah: Column) -> Column:
    return F.concat_ws(":", surah.cast("string"), ayah.cast("string"))


def eastern_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", "٠١٢٣٤٥٦٧٨٩")


def half_up(x: Column) -> Column:
    """Rounding to whole numbers with halves upward."""
    return F.floor(x + 0.5)


def hours_until(from_us: Column, to_us: Column) -> Column:
    """Rounded hours between two instants in microseconds, at least 1."""
    return F.greatest(F.lit(1).cast("long"), half_up((to_us - from_us) / 3_600_000_000))


def days_until_label(from_us: Column, to_us: Column) -> Column:
    days = F.ceil((to_us - from_us) / 86_400_000_000)
    return F.when(days <= 0, "due now").otherwise(F.concat(days.cast("string"), F.lit("d")))


def weekday_letter(day: Column) -> Column:
    return F.substring(F.lit("SMTWTFS"), F.dayofweek(day), F.lit(1))


def audio_url(base: Column, path: Column) -> Column:
    """Absolute addresses stay, others follow the base."""
    return F.when(path.rlike("^https?://"), path).otherwise(F.concat_ws("/", F.rtrim(base, F.lit("/")), F.ltrim(path, F.lit("/"))))
