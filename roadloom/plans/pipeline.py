"""The survey pipeline: lane fixes by time, then the brief's ranges by road and chainage; rows out are the rows in."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import scalars, timestamps
from roadloom.operators.lookup import FIRST_LISTED, LATEST_START, lookup_interval
from roadloom.operators.ranges import mark_in_range
from roadloom.schema import KILOMETRE_NAMES, LANE_FIX_COLUMNS, SchemaError, missing_exact, missing_flexible, need
from roadloom.sources.csv import (
    BRIEF_SUFFIX, COMPLETE_SUFFIX, LANES_SUFFIX, PLACE, data_columns, output_name, read_kind, read_text_csv, read_typed_csv, with_place, write_csv,
)

log = logging.getLogger("roadloom")

#: Messages of the steps, with their progress in percent.
MESSAGES = {
    "read": ("reading tables", 5), "times": ("reading timestamps", 20), "lanes": ("applying lane fixes", 40),
    "brief": ("marking rows inside the brief", 70), "write": ("writing the result", 90), "done": ("finished", 100),
}
Progress = Callable[[str, int], None]


@dataclass
class Report:
    """What a run did: formats chosen, rows in and out, rows changed and marked."""

    formats: dict[str, str | None] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


def _tell(progress: Progress | None, step: str) -> None:
    message, percent = MESSAGES[step]
    log.info("%s", message)
    if progress:
        progress(message, percent)


def _read_times(df: DataFrame, column: str, order: list, out: str, report: Report) -> DataFrame:
    parsed, choice = timestamps.parse_column(df, column, order, out, required=True)
    report.formats[column], report.counts[f"{column}_failures"], report.counts[f"{column}_rows"] = choice.format, choice.failures, choice.rows
    if choice.failures:
        log.warning("%d values of %s can't be read as %s, such as %s", choice.failures, column, choice.format, timestamps.failing_samples(parsed, column, out))
    return parsed


def apply_lane_fixes(
    lmd: DataFrame, fixes: DataFrame, policy: str = FIRST_LISTED, report: Report | None = None, progress: Progress | None = None, open_start_on_null: bool = False
) -> DataFrame:
    """``lmd`` with lanes rewritten and ``Ignore`` set by the fix that holds at each row's time, in standard time text.

    Times compare in whole seconds, both ends count. Under ``first_listed`` a fix of lane ``-1`` changes nothing; under
    ``latest_start`` it still sets ``Ignore``. ``Ignore`` of rows without a fix keeps its own value if there is one, else
    it is false. Where times are ISO, road names lose their last word. Fixes with an unreadable end never match;
    unreadable starts match from the beginning only with ``open_start_on_null``. Rows are kept one to one.
    """
    lost = missing_exact(data_columns(fixes), LANE_FIX_COLUMNS[:4])
    if lost:
        raise SchemaError(f"lane fixes: no column {', '.join(lost)}")
    gone = missing_flexible(data_columns(lmd), ["TestDateUTC", "Lane", "RoadName"])
    if gone:
        raise SchemaError(f"combined LMD: no column for {', '.join(gone)}")
    report = report or Report()
    lmd, fixes = with_place(lmd), with_place(fixes)
    time_col, lane_col, road_col = (need(lmd.columns, f, "combined LMD") for f in ("TestDateUTC", "Lane", "RoadName"))
    order = [F.col(c) for c in PLACE]
    _tell(progress, "times")
    columns = data_columns(lmd)
    fixes = _read_times(fixes, "From", order, "__from_us", report)
    fixes = _read_times(fixes, "To", order, "__to_us", report)
    rows = _read_times(lmd, time_col, order, "__us", report)
    iso = timestamps.has_iso_times(lmd, time_col, order)
    _tell(progress, "lanes")
    start = scalars.epoch_seconds(F.col("__from_us"))
    listed = fixes.select(
        F.struct(*PLACE).alias("ord"),
        (F.coalesce(start, F.lit(-62_135_596_800)) if open_start_on_null else start).alias("start"),
        scalars.epoch_seconds(F.col("__to_us")).alias("end"),
        F.struct(F.col("Lane").alias("lane"), F.coalesce(scalars.parse_boolean(F.col("Ignore")), F.lit(False)).alias("ignore")).alias("payload"),
    )
    rows = rows.withColumn("__s", scalars.epoch_seconds(F.col("__us")))
    rows = lookup_interval(rows, listed, "__s", policy, out="__fix")
    fix = F.col("__fix")
    own = F.coalesce(scalars.parse_boolean(F.col("Ignore")), F.lit(False)) if "Ignore" in columns else F.lit(False)
    skips = (fix["lane"] == scalars.KEEP_LANE) if policy == FIRST_LISTED else F.lit(False)
    changed = {
        lane_col: scalars.rewrite_lane(F.col(f"`{lane_col}`"), fix["lane"]),
        "Ignore": F.when(fix.isNotNull() & ~F.coalesce(skips, F.lit(False)), fix["ignore"]).otherwise(own),
        time_col: scalars.standard_time_text(F.col("__us")),
    }
    if iso:
        changed[road_col] = scalars.without_last_word(F.col(f"`{road_col}`"))
    out = rows.withColumns({"__matched": fix.isNotNull(), **changed})
    names = columns if "Ignore" in columns else [*columns, "Ignore"]
    return out.select(*[F.col(f"`{c}`") for c in names], *PLACE, "__matched")


def flag_in_brief(df: DataFrame, brief: DataFrame, strict: bool = False, progress: Progress | None = None) -> DataFrame:
    """``df`` with ``InBrief``: is there a range of the brief on the same road that holds the chainage, to ten metres?

    Road ids compare as numbers. Texts that are no numbers match nothing, or raise with ``strict``.
    """
    _tell(progress, "brief")
    start, end = need(brief.columns, "StartChainage", "workbrief"), need(brief.columns, "EndChainage", "workbrief")
    brief_road, road, chainage = need(brief.columns, "RoadID", "workbrief"), need(df.columns, "RoadID"), need(df.columns, "Chainage")
    num = lambda c: scalars.number(F.col(f"`{c}`").cast("string"), strict)
    ranges = brief.select(num(brief_road).alias("k"), scalars.round_to_10m(num(start)).alias("lo"), scalars.round_to_10m(num(end)).alias("hi"))
    rows = df.withColumns({"__road": num(road), "__at": scalars.to_metres(num(chainage), chainage in KILOMETRE_NAMES)})
    marked = mark_in_range(rows, ranges.where("k is not null"), "__road", "__at", "__in", "k", "lo", "hi")
    names = [c for c in df.columns if c not in PLACE and c != "__matched"]
    kept = [c for c in (*PLACE, "__matched") if c in df.columns]
    out = marked.withColumn("InBrief", F.col("__in"))
    return out.select(*[F.col(f"`{c}`") for c in (names if "InBrief" in names else [*names, "InBrief"])], *kept)


def guard_rows(df: DataFrame, expected: int, found: int) -> DataFrame:
    """For tables in memory: too many rows are cut to the number expected, too few logged. ``run_pipeline`` raises on either instead."""
    if found > expected:
        log.error("%d rows instead of %d: cut", found, expected)
        return df.limit(expected)
    if found < expected:
        log.error("only %d of %d rows", found, expected)
    return df


class RowCountError(ValueError):
    """The output has not as many rows as the input; nothing was published."""


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _publish(spark: SparkSession, held: str, path: str, expected: int, found: int) -> None:
    """Move a written output to its place if it has the expected rows; else remove it and raise."""
    fs, source = _file_system(spark, held)
    target = _file_system(spark, path)[1]
    if found != expected:
        fs.delete(source, True)
        raise RowCountError(f"{path}: {found} rows instead of {expected}")
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{held} could not be moved to {path}")


def run_pipeline(
    spark: SparkSession, lmd_path: str, fixes_path: str, brief_path: str, out_path: str | None = None, policy: str = FIRST_LISTED, strict: bool = False,
    plate_required: bool = True, progress: Progress | None = None, single: bool = False, suffix: str = COMPLETE_SUFFIX,
) -> tuple[str, Report]:
    """All three files to one enriched CSV next to the LMD; (path, report). Failures raise typed errors."""
    report = Report()
    _tell(progress, "read")
    fixes, lmd = read_kind(spark, fixes_path, "lane_fixes", plate_required), read_kind(spark, lmd_path, "combined_lmd")
    written = Observation("written")
    rows = apply_lane_fixes(lmd, fixes, policy, report, progress)
    rows = flag_in_brief(rows, read_text_csv(spark, brief_path), strict, progress)
    # Counted above the sort: sorting reads its input twice, once to find its ranges.
    rows = rows.orderBy(*PLACE).observe(written, F.count(F.lit(1)).alias("rows"), F.count_if("__matched").alias("matched"), F.count_if("InBrief").alias("in_brief"))
    _tell(progress, "write")
    path = out_path or output_name(lmd_path, suffix)
    held = f"{path}.unchecked"
    write_csv(rows.drop("__matched"), held, in_order=False, single=single)
    # The rows in were counted when the format of their times was chosen, over all of them.
    rows_in = report.counts[f"{need(lmd.columns, 'TestDateUTC')}_rows"]
    report.counts |= {"rows_in": rows_in, **{("rows_out" if k == "rows" else k): v for k, v in written.get.items()}}
    _publish(spark, held, path, report.counts["rows_in"], report.counts["rows_out"])
    _tell(progress, "done")
    return path, report


def run_lane_fixes(
    spark: SparkSession, lmd_path: str, fixes_path: str, out_path: str | None = None, policy: str = FIRST_LISTED, plate_required: bool = True,
    progress: Progress | None = None, single: bool = False, suffix: str = LANES_SUFFIX,
) -> tuple[str, Report]:
    """The lane fixes alone: LMD and fixes to ``<stem>_<suffix>_<date>.csv``."""
    report = Report()
    _tell(progress, "read")
    fixes, lmd = read_kind(spark, fixes_path, "lane_fixes", plate_required), read_kind(spark, lmd_path, "combined_lmd")
    rows = apply_lane_fixes(lmd, fixes, policy, report, progress)
    path = out_path or output_name(lmd_path, suffix)
    _tell(progress, "write")
    write_csv(rows.drop("__matched"), path, single=single)
    _tell(progress, "done")
    return path, report


def run_brief(
    spark: SparkSession, input_path: str, brief_path: str, out_path: str | None = None, strict: bool = False, progress: Progress | None = None,
    single: bool = False, suffix: str = BRIEF_SUFFIX,
) -> str:
    """The brief's ranges alone, on any table with road and chainage, to ``<stem>_<suffix>_<date>.csv``.

    Types are inferred; a column of times that the reader recognised is written as standard time text.
    """
    _tell(progress, "read")
    rows = flag_in_brief(with_place(read_typed_csv(spark, input_path)), read_text_csv(spark, brief_path), strict, progress)
    times = {c: scalars.standard_time_text(F.unix_micros(F.col(f"`{c}`").cast("timestamp"))) for c, t in rows.dtypes if t.startswith("timestamp")}
    path = out_path or output_name(input_path, suffix)
    _tell(progress, "write")
    write_csv(rows.withColumns(times) if times else rows, path, single=single)
    _tell(progress, "done")
    return path


__all__ = ["FIRST_LISTED", "LATEST_START", "Report", "RowCountError", "apply_lane_fixes", "flag_in_brief", "guard_rows", "run_brief", "run_lane_fixes", "run_pipeline"]
