"""Sizes, durations, dates and shortened text as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.paths import parent_display, result_leaf


def _tenths(x: Column) -> Column:
    """Halves go to the even tenth; the formatter alone would round them up."""
    return F.bround(x, 1)


def readable_bytes(n: Column) -> Column:
    unit = lambda power, name: F.format_string(f"%.1f {name}", _tenths(n / F.lit(float(1024**power))))
    return F.when(n >= 1 << 30, unit(3, "GiB")).when(n >= 1 << 20, unit(2, "MiB")).when(n >= 1 << 10, unit(1, "KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def readable_duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.when(whole < 60, F.format_string("%.1f s", _tenths(seconds.cast("double")))).otherwise(F.format_string("%d m %02d s", F.floor(whole / 60).cast("long"), whole % 60))


def readable_time(seconds: Column, offset_minutes: int = 0) -> Column:
    """``YYYY-MM-DD HH:MM`` of epoch seconds, in a session of UTC."""
    return F.date_format(F.timestamp_seconds(seconds + F.lit(60 * offset_minutes)), "yyyy-MM-dd HH:mm")


def seconds_of(mtime_ns: Column) -> Column:
    """Whole seconds, rounded down below the epoch too."""
    return F.floor((mtime_ns - F.pmod(mtime_ns, F.lit(1_000_000_000))) / F.lit(1_000_000_000)).cast("long")


def ellipsize(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(max(most - 1, 0))), F.lit("…")))


def size_mib(text: Column) -> Column:
    """A positive whole number of MiB, or null."""
    n = F.when(F.trim(text).rlike(r"\A\+?[0-9]{1,18}\z"), F.trim(text).cast("long"))
    return F.when(n > 0, n)


def detail_line(file_path: Column, entry_path: Column, hits: Column, size: Column, mtime: Column) -> Column:
    date = F.coalesce(readable_time(mtime), F.lit("—"))
    return F.concat(result_leaf(file_path, entry_path), F.lit(" ["), hits.cast("string"), F.lit("] - "), readable_bytes(size), F.lit(" - "), date, F.lit(" - "), parent_display(file_path, entry_path))
