"""Column functions for the records of runs: name, date and duration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_name(file_name: Column, at: Column) -> Column:
    """The file's name without a FASTA ending, and the UTC second (the session's time zone is taken to be UTC)."""
    return F.concat_ws("_", F.regexp_replace(file_name, r"(?i)\.(fna|fa|fasta)$", ""), F.date_format(at, "yyyyMMdd'T'HHmmss"))


def display_date(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy")


def elapsed_ms(began: Column, ended: Column) -> Column:
    return F.unix_millis(ended.cast("timestamp")) - F.unix_millis(began.cast("timestamp"))


def byte_size(n: Column) -> Column:
    """Bytes, or kilobytes or megabytes (of 1024) with one decimal, halves rounded up."""
    shown = lambda unit, size: F.format_string(f"%.1f {unit}", n / F.lit(float(size)))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, shown("KB", 1 << 10)).otherwise(shown("MB", 1 << 20))


def thousands(n: Column) -> Column:
    """A whole number with separators."""
    return F.format_number(n, 0)


def interval_list(intervals: Column) -> Column:
    """`start-end` of each, by commas."""
    return F.array_join(F.transform(intervals, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ", ")
