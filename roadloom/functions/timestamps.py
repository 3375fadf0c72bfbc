"""One timestamp format for a whole column: detection on a few values, choice by success over all, parsing by expressions.

A family is detected on the first ten non-null values (at least eight in ten must have its form, first family wins). Of its
formats the first that reads more than half of all rows, nulls counted, is taken for the whole column; rows written
otherwise become null. All formats of a family are tried in one aggregation. Instants are microseconds since 1970 UTC;
times without zone are taken as UTC, and the session's time zone plays no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS, DETECT_SHARE, ACCEPT_SHARE, PROBE_ROWS = 10, 0.8, 0.5, 5

#: 1969-2068 is where two-digit years belong; Spark reads 2000-2099. All hundred-year stretches from there have 25 leap days.
_CENTURY_US, _PIVOT_US = 36_525 * 86_400_000_000, 3_124_224_000_000_000


@dataclass(frozen=True)
class Family:
    name: str
    form: str
    formats: tuple[str, ...]


_TIME = r"\d{1,2}:\d{2}:\d{2}(\.\d{1,6})?"


#: Families in order of detection; formats in order of preference. ``unix`` formats are read as numbers.
FAMILIES = (
    Family(
        "iso", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?$",
        ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss"),
    ),
    Family(
        "iso_offset", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?[+-]\d{2}:?\d{2}$",
        ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS[xxx][xx]", "yyyy-MM-dd'T'HH:mm:ss[xxx][xx]"),
    ),
    Family("slash", rf"\d{{1,2}}/\d{{1,2}}/\d{{4}} {_TIME}$", ("d/M/yyyy H:mm:ss.SSSSSS", "d/M/yyyy H:mm:ss", "M/d/yyyy H:mm:ss.SSSSSS", "M/d/yyyy H:mm:ss")),
    Family("dash", rf"\d{{1,2}}-\d{{1,2}}-\d{{4}} {_TIME}$", ("d-M-yyyy H:mm:ss.SSSSSS", "d-M-yyyy H:mm:ss", "M-d-yyyy H:mm:ss.SSSSSS", "M-d-yyyy H:mm:ss")),
    Family("year_first", rf"\d{{4}}-\d{{2}}-\d{{2}} {_TIME}$", ("yyyy-MM-dd H:mm:ss.SSSSSS", "yyyy-MM-dd H:mm:ss")),
    Family("short_year", rf"\d{{1,2}}/\d{{1,2}}/\d{{2}} {_TIME}$", ("d/M/yy H:mm:ss.SSSSSS", "d/M/yy H:mm:ss", "M/d/yy H:mm:ss.SSSSSS", "M/d/yy H:mm:ss")),
    Family("unix_s", r"\d{10}(\.\d{1,6})?$", ("unix_s",)),
    Family("unix_ms", r"\d{13}$", ("unix_ms",)),
    Family("date", r"\d{4}-\d{2}-\d{2}$", ("yyyy-MM-dd",)),
    Family("slash_date", r"\d{1,2}/\d{1,2}/\d{4}$", ("d/M/yyyy", "M/d/yyyy")),
)

#: Tried, each for the whole column, where no family fits: day first, then month first.
FALLBACK = (
    "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "d MMM yyyy H:mm:ss", "d MMM yyyy H:mm",
    "d MMM yyyy", "d/M/yyyy H:mm", "yyyy-MM-dd H:mm", "yyyyMMdd'T'HHmmss'Z'", "d/M/yyyy h:mm:ss a", "M.d.yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a",
)


class TimestampError(ValueError):
    """No row of a timestamp column could be read."""


def detect_family(samples: list[str]) -> Family | None:
    """First family whose form at least eight in ten of the samples have from their start on."""
    for family in FAMILIES if samples else ():
        if sum(bool(re.match(family.form, s)) for s in samples) >= DETECT_SHARE * len(samples):
            return family
    return None


def read_format(c: Column, fmt: str) -> Column:
    """Microseconds of a text by one format; null where it is not written so."""
    if fmt == "unix_s":
        return F.round(c.try_cast("double") * 1e6).cast("bigint")
    if fmt == "unix_ms":
        return c.try_cast("bigint") * 1000
    zoned = "x" in fmt
    at = F.try_to_timestamp(c, F.lit(fmt)) if zoned else F.try_to_timestamp(F.concat(c, F.lit(" +00:00")), F.lit(f"{fmt} xxx"))
    us = F.unix_micros(at)
    if "yy" in fmt and "yyyy" not in fmt:
        us = F.when(us >= _PIVOT_US, us - _CENTURY_US).otherwise(us)
    return us


def samples(df: DataFrame, column: str, order: list[Column], n: int = SAMPLE_ROWS) -> list[str]:
    """First non-null values in the given order."""
    rows = df.where(F.col(f"`{column}`").isNotNull()).orderBy(*order).select(F.col(f"`{column}`").cast("string")).limit(n).collect()
    return [r[0] for r in rows]


@dataclass(frozen=True)
class Choice:
    """The format of a column and how it fares: rows, rows with a value, rows read by it."""

    format: str | None
    rows: int = 0
    present: int = 0
    read: int = 0

    @property
    def failures(self) -> int:
        return self.present - self.read


def try_formats(df: DataFrame, column: str, formats: list[str]) -> list[Choice]:
    """How each format fares over all rows, in one pass."""
    c = F.col(f"`{column}`").cast("string")
    counts = [F.count(read_format(c, f)).alias(f"f{i}") for i, f in enumerate(formats)]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("there"), *counts).first()
    return [Choice(f, row["n"], row["there"], row[f"f{i}"]) for i, f in enumerate(formats)]


def choose_format(df: DataFrame, column: str, order: list[Column]) -> Choice:
    """The one format for a column: of the detected family, else of the fallback list; none if no value can be read."""
    found = samples(df, column, order)
    family = detect_family(found)
    tried: list[Choice] = []
    for formats in ([list(family.formats)] if family else []) + [list(FALLBACK)] if found else []:
        tried += try_formats(df, column, formats)
        best = next((t for t in tried if t.read > ACCEPT_SHARE * t.rows), None)
        if best:
            return best
    # Last resort, where nulls or rubbish are half of the column: what reads most of it.
    best = max(tried, key=lambda t: t.read, default=Choice(None))
    return best if best.read else Choice(None, best.rows, best.present)


def parse_column(df: DataFrame, column: str, order: list[Column], out: str, required: bool = False) -> tuple[DataFrame, Choice]:
    """``df`` with ``out`` (microseconds) of ``column``, and the choice made. ``required``: an error where no value is read."""
    choice = choose_format(df, column, order)
    if choice.format is None and required:
        raise TimestampError(f"no value of {column} can be read as a time")
    parsed = read_format(F.col(f"`{column}`").cast("string"), choice.format) if choice.format else F.lit(None).cast("bigint")
    return df.withColumn(out, parsed), choice


def failing_samples(df: DataFrame, column: str, parsed: str, n: int = 3) -> list[str]:
    """A few of the values that could not be read, for a log."""
    rows = df.where(F.col(f"`{column}`").isNotNull() & F.col(f"`{parsed}`").isNull()).select(F.col(f"`{column}`").cast("string")).limit(n).collect()
    return [r[0] for r in rows]


def has_iso_times(df: DataFrame, column: str, order: list[Column]) -> bool:
    """Does any of the first five values hold a ``T``?"""
    return any("T" in s for s in samples(df, column, order, PROBE_ROWS))


def parse_failures(raw: str, parsed: str) -> Column:
    """Count of values that are there but could not be read."""
    return F.count_if(F.col(f"`{raw}`").isNotNull() & F.col(f"`{parsed}`").isNull())


def supported_formats() -> str:
    return "\n".join(f"{f.name}: {', '.join(f.formats)}" for f in FAMILIES)
