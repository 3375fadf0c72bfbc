"""Mixed timestamp formats and zones: one unambiguous instant for every written time.

Every value is read for itself (``roadloom.functions.instants``). What a value does not say - the order of day and month,
the zone - belongs to its file. Where the file does not state it either, it is estimated by alignment with ingestion: each
candidate history (a zone's whole offset history, or an order of day and month) turns the file's local times into
instants, and the history with the fewest violations wins. Violations are, in this order: values that are no real date
under the candidate; values later than their own ingestion; distance (by medians of the time to ingestion) from the file's
zone-marked times or, without such, from ingestion. Orders are scored in one aggregation per file, in which only files that leave theirs open are read
for their times. Zones are scored on counts: no zone changes its offset within a quarter of an hour of wall-clock time, so
values of one file, quarter and lag (in quarters) are one weighted row before any candidate is tried on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.common import apart, filled, fresh, literal_map, lookup_join
from roadloom.functions.instants import ABBREVIATIONS, DAY_US, marks_of_zone, offset_seconds, utc_text, with_wall_clock_utc, with_written_time
from roadloom.session import cut_lineage

#: A written time may lie this much after its ingestion before it counts as a violation (clocks differ a little).
CLOCK_SLACK_US = 5 * 60 * 1_000_000
#: A distance from ingestion counts up to this many days, so that single rubbish values do not outweigh the rest.
FAR_DAYS = 1000
#: Offsets of zones are whole multiples of this.
QUARTER_US = 900 * 1_000_000


def all_zones(spark: SparkSession) -> list[str]:
    """The zones that the JVM knows: some six hundred, whatever the data."""
    jvm = spark.sparkContext._jvm
    return sorted(jvm.java.lang.String.join(" ", jvm.java.time.ZoneId.getAvailableZoneIds()).split(" "))


def _valid_zone(spark: SparkSession, column: str) -> Column:
    """The trimmed zone name where the JVM knows such a zone, else null."""
    known = "', '".join(all_zones(spark))
    return F.expr(f"CASE WHEN trim(`{column}`) IN ('{known}') THEN trim(`{column}`) END")


def _abbreviations(spark: SparkSession, zone: str) -> dict[str, int]:
    """The JVM's short names of a zone's standard and summer time, and their seconds east of UTC."""
    jvm = spark.sparkContext._jvm
    z, locale = jvm.java.util.TimeZone.getTimeZone(zone), jvm.java.util.Locale.US
    base, more = z.getRawOffset() // 1000, z.getDSTSavings() // 1000
    names = {z.getDisplayName(False, 0, locale).upper(): base} | ({z.getDisplayName(True, 0, locale).upper(): base + more} if more else {})
    return {k: v for k, v in names.items() if k.isalpha()}


def distinct_histories(spark: SparkSession, first_us: int, last_us: int, preferred: list[str]) -> list[str]:
    """One zone for every history of offsets that zones have between two instants; of equal ones a preferred one, else the first by name.

    Histories are compared day by day. The work is bounded by the number of zones and days, whatever the number of rows.
    """
    days = F.sequence(F.lit(first_us // DAY_US - 1), F.lit(last_us // DAY_US + 1))
    offsets = F.transform(days, lambda d: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(d * DAY_US), F.col("zone"))) - d * DAY_US)
    zones = spark.createDataFrame([(z, z not in preferred) for z in all_zones(spark)], "zone string, other boolean").repartition(8)
    best = zones.withColumn("history", F.hash(offsets)).groupBy("history").agg(F.min_by("zone", F.struct("other", "zone")).alias("zone"))
    return sorted(r["zone"] for r in best.collect())


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _score_orders(facts: DataFrame, times: list[str], file_col: str, seen: str) -> DataFrame:
    """Per file whether day-first is the better reading of its numeric dates (ties: day first)."""

    def score(own: str, other: str) -> Column:
        bad, late, far = [], [], []
        for t in times:
            days, alt = F.col(t)[own], F.col(t)[other]
            pair = F.col(t)["kind"] == "pair"
            local = days * DAY_US + F.coalesce(F.col(t)["clock_us"], F.lit(0))
            bad.append(F.count_if(pair & days.isNull() & alt.isNotNull()))
            late.append(F.count_if(pair & (local > F.col(seen) + DAY_US)))
            far.append(F.coalesce(F.sum(F.when(pair, F.least(F.abs(local - F.col(seen)) / DAY_US, F.lit(FAR_DAYS)).cast("bigint"))), F.lit(0)))
        return F.struct(_add(bad), _add(late), _add(far))

    return facts.groupBy(file_col).agg((score("dmy_days", "mdy_days") <= score("mdy_days", "dmy_days")).alias("__guess"))


def _score_zones(facts: DataFrame, times: list[str], file_col: str, seen: str, zones: list[str] | None, preferred: list[str]) -> DataFrame:
    """Per file the zone whose offset history puts its unmarked times best before ingestion and next to its marked ones.

    Distance from ingestion says little of a file without marked times: there a preferred zone goes first. Ties: a preferred
    zone, then by name of the zone. Without ``zones``, all distinct histories over the span of the values.
    """
    (anchor,) = fresh("anchor")
    quarters = lambda c: F.floor(c / F.lit(QUARTER_US)).cast("bigint")
    none = F.lit(None).cast("bigint")
    found = []
    for t in times:
        c = F.col(t)
        days = F.when(F.col("__day_first"), c["dmy_days"]).otherwise(c["mdy_days"])
        local = days * DAY_US + c["clock_us"]
        known = F.coalesce(c["unix_us"], local - offset_seconds(c["zone"], literal_map(ABBREVIATIONS["*"])) * 1_000_000)
        for at, marked in ((F.when(c["zone"] == "", local), False), (known, True)):
            lag = at - F.col(seen)
            late = -quarters(CLOCK_SLACK_US - lag) - 1
            found.append(F.when(at.isNotNull(), F.struct((none if marked else quarters(at)).alias("q"), (none if marked else late).alias("late"), quarters(lag + QUARTER_US // 2).alias("lag"))))
    # One row per file, quarter of wall-clock time and lag in quarters (itself, and after the slack), with the number of values; without
    # a wall-clock time for marked ones. The outer explode keeps filters from being pushed below it, where they would repeat all steps.
    rows = facts.select(file_col, F.explode_outer(F.array_compact(F.array(*found))).alias("v")).where("v is not null")
    every = cut_lineage(rows.groupBy(file_col, "v.q", "v.late", "v.lag").agg(F.count(F.lit(1)).alias("n")))
    counted = every.where("q is not null")
    anchors = every.where("q is null").groupBy(file_col).agg(F.percentile("lag", 0.5, F.col("n")).alias(anchor))
    span = counted.agg(F.min("q"), F.max("q")).first()
    if zones is None:
        zones = distinct_histories(facts.sparkSession, span[0] * QUARTER_US, span[1] * QUARTER_US, preferred) if span[0] is not None else []
    tried = lookup_join(counted, anchors, [file_col]).withColumn("zone", F.explode(F.array(*[F.lit(z) for z in sorted(zones)]).cast("array<string>")))
    tried = with_wall_clock_utc(tried.withColumn("local", F.col("q") * QUARTER_US), "local", "zone", "us", "word")
    offset = (F.col("local") - F.col("us")) / F.lit(QUARTER_US)
    most = FAR_DAYS * DAY_US / QUARTER_US
    away = F.greatest(F.lit(-most), F.least(F.lit(most), F.col("lag") - offset - F.coalesce(F.col(anchor), F.lit(0.0))))
    n, strange = F.col("n"), ~F.col("zone").isin(*preferred) if preferred else F.lit(False)
    scored = tried.groupBy(file_col, "zone").agg(
        F.struct(
            F.sum(F.when(F.col("us").isNull(), n).otherwise(0)),
            F.sum(F.when(F.col("late") >= offset, n).otherwise(0)),
            F.max(F.when(F.col(anchor).isNull(), strange).otherwise(False)),
            F.round(F.abs(F.percentile(away, 0.5, n)), 3),
            F.max(strange),
            F.col("zone"),
        ).alias("score")
    )
    return scored.groupBy(file_col).agg(F.min_by("zone", "score").alias("__guessed_zone"))


def _with_times(df: DataFrame, columns: list[str], times: list[str]) -> DataFrame:
    for c, t in zip(columns, times):
        df = with_written_time(df, c, t)
    return df


def file_histories(df: DataFrame, columns: list[str], files: DataFrame, file_col: str, seen_col: str, zones: list[str] | None = None) -> DataFrame:
    """One row per file: its key, ``__zone``, ``__day_first`` and ``__marks`` (its zone abbreviations); what ``files`` leaves open is estimated from ``df``.

    Files are those listed and those that rows of ``df`` name; of one that is not listed everything is open. Candidate zones
    are ``zones``, else all distinct offset histories that the JVM knows, those of the listed files first among equals. One
    pass over ``df`` gives its files and scores the orders of day and month; only where zones are open, their files are read again.
    """
    spark = df.sparkSession
    seen, *times = fresh("seen", *[f"t{i}" for i in range(len(columns))])
    facts = df.where(F.col(file_col).isNotNull()).select(F.col(file_col), _us(F.col(seen_col)).alias(seen), *[F.col(f"`{c}`") for c in columns])
    order = F.upper(F.trim(F.col("date_order")))
    stated = F.struct(
        _valid_zone(spark, "zone_name").alias("__zone"), F.when(order == "DMY", True).when(order == "MDY", False).alias("__day_first"), _us(F.col("exported_at")).alias("__exported")
    )
    listed = cut_lineage(files.where(F.col(file_col).isNotNull()).groupBy(file_col).agg(F.max(stated).alias("v")).select(file_col, "v.*"))
    evidence = lookup_join(facts, listed, [file_col])
    open_only = [F.when(F.col("__day_first").isNull(), F.col(f"`{c}`")).alias(c) for c in columns]
    evidence = evidence.select(file_col, F.coalesce("__exported", seen).alias(seen), *open_only)
    guessed = _score_orders(_with_times(evidence, columns, times), times, file_col, seen)
    out = listed.join(guessed, [file_col], "full")
    out = cut_lineage(out.select(file_col, "__zone", F.coalesce("__day_first", "__guess", F.lit(True)).alias("__day_first"), "__exported", F.col("__guess").isNotNull().alias("__used")))
    open_zone = out.where("__zone is null and __used").select(file_col, "__day_first", "__exported")
    known = [r[0] for r in out.select("__zone").where("__zone is not null").distinct().collect()]  # zones of the JVM only
    if not open_zone.isEmpty():
        rows = lookup_join(facts, open_zone, [file_col], "inner")
        rows = rows.withColumn(seen, F.coalesce(F.col("__exported"), F.col(seen)))
        zoned = _score_zones(_with_times(rows, columns, times), times, file_col, seen, zones, known)
        out = cut_lineage(out.join(zoned, [file_col], "left").withColumn("__zone", F.coalesce("__zone", "__guessed_zone")))
        known = [r[0] for r in out.select("__zone").where("__zone is not null").distinct().collect()]
    others = {z: _abbreviations(spark, z) for z in known if z not in ABBREVIATIONS}
    return out.select(file_col, "__zone", "__day_first", marks_of_zone(F.col("__zone"), {z: m for z, m in others.items() if m}).alias("__marks"))


def with_instants(
    df: DataFrame, files: DataFrame, columns: list[str], file_col: str = "source_file", seen_col: str = "loaded_at", zones: list[str] | None = None
) -> DataFrame:
    """``df`` with ``<column>_us`` (bigint) and ``<column>_word`` (string) for every written time in ``columns``.

    ``_us`` is the instant in microseconds since 1970 UTC. Where there is none, ``_word`` says why: ``ambiguous`` and
    ``skipped`` for a wall-clock time that its zone has twice or never, ``unreadable`` for anything that is no real date
    with time of day, ``no zone`` where neither the value nor the file nor the estimate gives one. Null tokens have
    neither. Rows are kept one to one, duplicates too; an empty table gives an empty table; extra columns pass through,
    and existing columns of the new names are replaced. A file missing from ``files`` is estimated in zone and order; rows
    without a file have no zone and are day first, as they are no one file to estimate from.
    """
    new = [f"{c}_{k}" for c in columns for k in ("us", "word")]
    df = df.drop(*new)
    times = fresh(*[f"t{i}" for i in range(len(columns))])
    histories = file_histories(df, columns, files, file_col, seen_col, zones)
    out = lookup_join(_with_times(df, columns, times), histories, [file_col])
    for t, c in zip(times, columns):
        raw, v = F.col(f"`{c}`"), F.col(t)
        local, bare, offset, wall, word = fresh("local", "bare", "offset", "wall", "word")
        days = F.when(F.coalesce(F.col("__day_first"), F.lit(True)), v["dmy_days"]).otherwise(v["mdy_days"])
        out = out.withColumns({local: apart(days * DAY_US + v["clock_us"]), offset: offset_seconds(v["zone"], F.coalesce("__marks", literal_map(ABBREVIATIONS["*"]))) * 1_000_000})
        out = out.withColumn(bare, F.when(v["zone"] == "", F.col(local)))
        out = with_wall_clock_utc(out, bare, "__zone", wall, word)
        written = F.col(local) - F.col(offset)
        out = out.withColumns({
            f"{c}_us": apart(F.when(v["kind"] == "unix", v["unix_us"]).when(v["zone"] != "", written).otherwise(F.col(wall))),
            f"{c}_word": F.when(filled(raw).isNull(), F.lit(None).cast("string"))
            .when(v.isNull() | ((v["kind"] != "unix") & (F.col(local).isNull() | ((v["zone"] != "") & F.col(offset).isNull()))), "unreadable")
            .when((v["zone"] == "") & F.col("__zone").isNull(), "no zone")
            .when(v["zone"] == "", F.col(word)),
        })
    # Through a generator, below which no filter on the new columns is pushed: else a caller's "is not null" would
    # repeat all the steps above inside one expression.
    packed = F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in new])))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], packed)


def instants_text(us: Column, word: Column) -> Column:
    """What p2 reports of a value: the UTC text, or the word for a time that a clock change makes ambiguous or skips."""
    return F.when(us.isNotNull(), utc_text(us)).when(word.isin("ambiguous", "skipped"), word)
