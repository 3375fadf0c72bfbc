"""Reading single written times: every value for itself, in any of the known ways of writing.

``with_written_time`` gives a struct of plain integers; nothing here depends on the session's time zone or on ANSI mode,
because dates are turned into day numbers by arithmetic and texts into numbers by ``try_cast`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.common import apart, filled, fresh, literal_map

DAY_US = 86_400_000_000

#: Seconds east of UTC of zone abbreviations, by the zone in which they are written. ``CST`` of the United
#: States and of Australia differ, so an abbreviation only counts together with the zone of its file; ``*`` is any zone.
ABBREVIATIONS = {
    "*": {"UTC": 0, "GMT": 0, "Z": 0},
    "Europe/London": {"GMT": 0, "BST": 3600},
    "Europe/Dublin": {"GMT": 0, "IST": 3600},
    "Europe/Berlin": {"CET": 3600, "CEST": 7200},
    "Europe/Paris": {"CET": 3600, "CEST": 7200},
    "Europe/Madrid": {"CET": 3600, "CEST": 7200},
    "America/New_York": {"EST": -18000, "EDT": -14400},
    "America/Toronto": {"EST": -18000, "EDT": -14400},
    "America/Chicago": {"CST": -21600, "CDT": -18000},
    "America/Denver": {"MST": -25200, "MDT": -21600},
    "America/Phoenix": {"MST": -25200},
    "America/Los_Angeles": {"PST": -28800, "PDT": -25200},
    "Australia/Sydney": {"AEST": 36000, "AEDT": 39600},
    "Australia/Melbourne": {"AEST": 36000, "AEDT": 39600},
    "Australia/Hobart": {"AEST": 36000, "AEDT": 39600},
    "Australia/Brisbane": {"AEST": 36000},
    "Australia/Adelaide": {"ACST": 34200, "ACDT": 37800},
    "Australia/Darwin": {"ACST": 34200},
    "Australia/Perth": {"AWST": 28800},
    "Pacific/Auckland": {"NZST": 43200, "NZDT": 46800},
    "Asia/Tokyo": {"JST": 32400},
    "Asia/Kolkata": {"IST": 19800},
    "Africa/Johannesburg": {"SAST": 7200},
}

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Every way to write each month.
MONTH_NAMES = (
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"), ("jul", "july"), ("aug", "august"),
    ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"),
)

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s?([AaPp][Mm]))?"
_ZONE = r"(?:\s?([Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?"
_ISO = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|\s+){_CLOCK}{_ZONE}$"
_PAIR = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:[Tt]|,?\s+){_CLOCK}{_ZONE}$"
_NAMED = rf"^(\d{{1,2}})[\s-]+([A-Za-z]{{3,9}})\.?[\s-]+(\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_ZONE}$"
_COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{_ZONE}$"
_UNIX_S = r"^(\d{10})(?:\.(\d{1,9}))?$"
_UNIX_MS = r"^(\d{13})$"


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar, for years 1 to 9999, by integer arithmetic."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mm = F.when(m <= 2, m + 9).otherwise(m - 3)
    div = lambda a, n: F.floor(a / F.lit(n))
    return (yy * 365 + div(yy, 4) - div(yy, 100) + div(yy, 400) + div(mm * 153 + 2, 5) + d - 719_469).cast("bigint")


def real_date(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= length), F.lit(False))


def _year(text: Column) -> Column:
    return F.when(F.length(text) == 2, _int(text) + 2000).otherwise(_int(text))


def _micros(fraction: Column) -> Column:
    return F.coalesce(_int(F.rpad(F.substring(fraction, 1, 6), 6, "0")), F.lit(0))


#: Each way of writing, and its parts in one order: kind, year, two date parts, hour, minute, second, fraction, half of the day, zone.
_FORMS = (
    (_ISO, "I|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (_PAIR, "P|$4|$1|$3|$5|$6|$7|$8|$9|$10"),
    (_UNIX_MS, "M|$1|"),
    (_UNIX_S, "S|$1|$2"),
    (_NAMED, "N|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (_COMPACT, "I|$1|$2|$3|$4|$5|$6|$7||$8"),
)


def with_written_time(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with a struct ``out`` of the written time in column ``value``; null for null tokens and for none of the known forms.

    ``kind``: ``ymd`` (order of the date is written), ``pair`` (a numeric day/month pair) or ``unix``;
    ``dmy_days``/``mdy_days``: day number by either reading, null where that reading is no real date (equal for ``ymd``);
    ``clock_us``: microseconds since midnight, null where it is no time of day; ``unix_us``: the instant, for ``unix``;
    ``zone``: the zone mark as written in capitals, empty without one.
    Both ``dmy_days`` and ``mdy_days`` null, or ``clock_us`` null, means: not readable.

    Every form starts with a digit and every rearranged text with a letter, so each value is matched once and the forms
    after its own fail on the first character. Each step is a projection of its own (see ``apart``): all of it is compiled
    code, and no expression is repeated inside another.
    """
    parts, hour, ymd, dmy = fresh("p", "hour", "ymd", "dmy")
    kind, unix, y, a, b, h, mi, s, us, half, zone = numbers = fresh("kind", "unix", "y", "a", "b", "h", "mi", "s", "us", "half", "zone")
    canon = filled(F.col(f"`{value}`"))
    canon = F.when(F.substring(canon, 1, 1).between("0", "9"), canon)
    for form, rearranged in _FORMS:
        canon = F.regexp_replace(canon, form, rearranged)
    rows = df.withColumn(parts, F.split(canon, r"\|", -1))
    at = lambda i: F.get(F.col(parts), F.lit(i))
    months = literal_map({name: i for i, names in enumerate(MONTH_NAMES, 1) for name in names})
    k = at(0)
    rows = rows.withColumns({
        kind: apart(F.when(k.isin("I", "P", "N", "M", "S"), k)),
        unix: F.when(k == "M", _int(at(1)) * 1000).when(k == "S", _int(at(1)) * 1_000_000 + _micros(at(2))),
        y: F.when(k.isin("I", "P", "N"), _year(at(1))),
        a: F.when(k == "N", F.try_element_at(months, F.lower(at(2)))).otherwise(_int(at(2))),
        b: _int(at(3)), h: _int(at(4)), mi: _int(at(5)), s: F.coalesce(_int(at(6)), F.lit(0)), us: _micros(at(7)),
        half: F.upper(F.coalesce(at(8), F.lit(""))), zone: F.upper(F.coalesce(at(9), F.lit(""))),
    })
    n = {c: F.col(c) for c in numbers}
    rows = rows.withColumns({
        hour: apart(
            F.when((n[mi] > 59) | (n[s] > 59), F.lit(None))
            .when(n[half] == "", F.when(n[h] <= 23, n[h]))
            .when(n[h].between(1, 12), n[h] % 12 + F.when(n[half] == "PM", 12).otherwise(0))
        ),
        ymd: F.when(real_date(n[y], n[a], n[b]), days_from_civil(n[y], n[a], n[b])),
        dmy: F.when((n[kind] == "P") & real_date(n[y], n[b], n[a]), days_from_civil(n[y], n[b], n[a])),
    })
    pair, is_unix = n[kind] == "P", n[kind].isin("M", "S")
    time = F.struct(
        F.when(is_unix, "unix").when(pair, "pair").otherwise("ymd").alias("kind"), F.when(pair, F.col(dmy)).otherwise(F.col(ymd)).cast("bigint").alias("dmy_days"),
        F.col(ymd).cast("bigint").alias("mdy_days"), F.when(~is_unix, ((F.col(hour) * 60 + n[mi]) * 60 + n[s]) * 1_000_000 + n[us]).cast("bigint").alias("clock_us"),
        n[unix].cast("bigint").alias("unix_us"), F.when(is_unix, "Z").otherwise(n[zone]).alias("zone"),
    )
    return rows.withColumn(out, apart(F.when(n[kind].isNotNull(), time))).drop(parts, hour, ymd, dmy, *numbers)


def marks_of_zone(zone: Column, others: dict[str, dict[str, int]] | None = None) -> Column:
    """The zone abbreviations that count in a zone, with their seconds east of UTC: those of any zone and its own.

    ``others`` has the abbreviations of zones that ``ABBREVIATIONS`` does not list.
    """
    every = ABBREVIATIONS["*"]
    table = {name: every | own for name, own in (ABBREVIATIONS | (others or {})).items() if name != "*"}
    entries = ", ".join(f"'{name}', map({', '.join(f"'{k}', {v}" for k, v in own.items())})" for name, own in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), zone), literal_map(every))


def offset_seconds(zone_mark: Column, marks: Column) -> Column:
    """Seconds east of UTC that a zone mark states, by the abbreviations in ``marks``; null without a mark or where it is none of them."""
    sign = F.substring(zone_mark, 1, 1)
    digits = F.translate(zone_mark, "+-:", "")
    hours, minutes = _int(F.substring(digits, 1, 2)), F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    numeric = F.when((hours <= 18) & (minutes <= 59), F.when(sign == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60))
    return F.when(sign.isin("+", "-"), numeric).when(zone_mark != "", F.try_element_at(marks, zone_mark)).cast("bigint")


def _shift(us: Column, zone: Column) -> Column:
    """Wall-clock microseconds in ``zone`` at the instant ``us``."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def with_wall_clock_utc(df: DataFrame, local: str, zone: str, us: str, word: str) -> DataFrame:
    """``df`` with ``us`` and ``word`` of the wall-clock microseconds in column ``local``: the instant, or ``ambiguous`` /
    ``skipped`` at a clock change. Null local time or zone: both null.

    The offsets in force a day before and a day after are both tried. Where they are the same there is no change in between
    and the time exists once; else it exists under those that lead back to it.
    Each step is a projection of its own, so that no expression is repeated inside another.
    """
    at, z = F.col(local), F.col(zone)
    u1, u2 = fresh("u1", "u2")
    out = df.withColumns({u1: apart(at - (_shift(at - DAY_US, z) - (at - DAY_US))), u2: at - (_shift(at + DAY_US, z) - (at + DAY_US))})
    ok1, ok2 = fresh("ok1", "ok2")
    same = F.col(u1) == F.col(u2)
    out = out.withColumns({ok1: apart(F.when(same, True).otherwise(_shift(F.col(u1), z) == at)), ok2: F.when(same, True).otherwise(_shift(F.col(u2), z) == at)})
    twice = F.col(ok1) & F.col(ok2) & (F.col(u1) != F.col(u2))
    never = ~F.col(ok1) & ~F.col(ok2)
    out = out.withColumns({
        us: apart(F.when(twice | never, F.lit(None)).when(F.col(ok1), F.col(u1)).when(F.col(ok2), F.col(u2)).cast("bigint")),
        word: F.when(twice, "ambiguous").when(never, "skipped"),
    })
    return out.drop(u1, u2, ok1, ok2)


def utc_text(us: Column) -> Column:
    """``2024-01-31T05:06:07.000000Z`` of an instant in microseconds, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(us / F.lit(DAY_US)).cast("int"))
    rest = F.pmod(us, F.lit(DAY_US))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    return F.concat(
        day.cast("string"), F.lit("T"), two(F.floor(rest / 3_600_000_000)), F.lit(":"), two(F.floor(rest / 60_000_000) % 60), F.lit(":"),
        two(F.floor(rest / 1_000_000) % 60), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )
