"""Scalar functions of the survey pipeline, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.common import null_tokens_to_null

#: Boolean tokens.
TRUE_TOKENS = ("1", "True", "true", "TRUE", "T", "t")
FALSE_TOKENS = ("0", "False", "false", "FALSE", "F", "f", "")
#: Fixed value: the lane of a fix that leaves the lane as it is.
KEEP_LANE = "-1"


def nulls_of_tokens(df: DataFrame) -> DataFrame:
    """Every text column with null tokens as nulls."""
    return df.select(*[null_tokens_to_null(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def parse_boolean(c: Column) -> Column:
    """Boolean of a token, outer blanks aside; null for anything else and for null."""
    token = F.btrim(c.cast("string"), F.lit(" \t\n\r"))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


def boolean_text(c: Column) -> Column:
    """``True`` / ``False`` of a boolean; null stays null."""
    return F.when(c, "True").when(~c, "False")


def rewrite_lane(current: Column, fix: Column) -> Column:
    """The lane after a fix: the fix replaces a code that is longer than two characters or shorter than two; else its digit.

    ``-1`` and null fixes keep the lane, a null lane becomes the fix.
    """
    changed = F.concat(F.substring(current, 1, 1), fix, F.substring(current, 3, 2_147_483_647))
    return (
        F.when(fix.isNull() | (fix == KEEP_LANE), current)
        .when(F.char_length(fix) > 2, fix)
        .when(F.char_length(current) > 1, changed)
        .otherwise(fix)
    )


def without_last_word(c: Column) -> Column:
    """Cut at the last blank, if there is one."""
    return F.regexp_replace(c, " [^ ]*$", "")


def number(c: Column, strict: bool = False) -> Column:
    """Double of a text; null where it is none, or an error if ``strict``, whatever the session's ANSI mode."""
    found = c.try_cast("double")
    if not strict:
        return found
    bad = F.raise_error(F.concat(F.lit("CAST_INVALID_INPUT: no number: "), c)).cast("double")
    return F.when(c.isNotNull() & found.isNull(), bad).otherwise(found)


def plain_number(c: Column) -> Column:
    """Double of a text in digits, outer blanks aside, with point and exponent if any; null for all others (``1d``, ``NaN``, ``1,000``, ``5 m``)."""
    text = F.btrim(c, F.lit(" \t\n\r"))
    return F.when(text.rlike(r"\A[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))


def round_to_10m(kilometres: Column) -> Column:
    """Metres of a chainage in kilometres, to the nearest ten; ties go to the even ten."""
    return F.bround(kilometres * 1000 / 10, 0) * 10


def to_metres(c: Column, in_kilometres: bool) -> Column:
    return c * 1000 if in_kilometres else c


def epoch_seconds(us: Column) -> Column:
    """Whole seconds since 1970 of microseconds, rounded down."""
    return F.floor(us / F.lit(1_000_000)).cast("bigint")


def standard_time_text(us: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss.SSS`` of microseconds since 1970 UTC; the rest of a millisecond is cut off."""
    day = F.date_from_unix_date(F.floor(us / F.lit(86_400_000_000)).cast("int"))
    ms = F.floor(F.pmod(us, F.lit(86_400_000_000)) / 1000).cast("bigint")
    pad = lambda c, n: F.lpad(c.cast("bigint").cast("string"), n, "0")
    date = F.concat(pad(F.dayofmonth(day), 2), F.lit("/"), pad(F.month(day), 2), F.lit("/"), pad(F.year(day), 4))
    clock = F.concat(pad(F.floor(ms / 3_600_000), 2), F.lit(":"), pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2))
    return F.concat(date, F.lit(" "), clock, F.lit("."), pad(ms % 1000, 3))
