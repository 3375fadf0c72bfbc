"""The survey pipeline's steps on the whole survey tables, and its sources and schema rules, as queries with their SQL.

The tables' times are written in many ways, the pipeline reads a column by one format: the tables come to it with their
times as instants (p2), written in ISO form; times without an instant are null. Order of listing is that of the ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.common import fresh, null_tokens_to_null, table
from roadloom.functions.instants import utc_text
from roadloom.functions.scalars import nulls_of_tokens
from roadloom.operators.lookup import FIRST_LISTED, LATEST_START
from roadloom.plans.pipeline import apply_lane_fixes, flag_in_brief
from roadloom.plans.survey_queries import fix_instants, lmd_instants
from roadloom.plans.survey_sql import INSTANTS
from roadloom.schema import ALIASES, LANE_FIX_COLUMNS, LMD_MARKERS, file_kind, missing_exact, missing_flexible, resolve
from roadloom.session import ensure_checkpoint_dir
from roadloom.sources.csv import PLACE, read_text_csv, write_csv

_SHOWN = ("lmd_id", "TestDateUTC", "Lane", "RoadName")
_SURVEY_TABLES = ("combined_lmd", "lane_fixes", "workbrief", "survey_files", "road_reference", "raw_lines", "feed_rows")


def _placed(df: DataFrame, key: str) -> DataFrame:
    return nulls_of_tokens(df).withColumns({PLACE[0]: F.lit(""), PLACE[1]: F.lit(0).cast("bigint"), PLACE[2]: F.col(key)})


def _iso(column: str) -> Column:
    return utc_text(F.col(f"{column}_us")).alias(column)


def _lmd(spark: SparkSession, d: str) -> DataFrame:
    return _placed(lmd_instants(spark, d).select("lmd_id", _iso("TestDateUTC"), "Lane", "RoadName", "RoadID", "Chainage", "Ignore"), "lmd_id")


def _fixes(spark: SparkSession, d: str) -> DataFrame:
    return _placed(fix_instants(spark, d).select("fix_id", _iso("From"), _iso("To"), "Lane", "Ignore", "Plate"), "fix_id")


def pipeline_lanes_first(spark: SparkSession, d: str) -> DataFrame:
    """Lane fixes by the first listed fix: lanes, flags, time texts and road names of all rows."""
    return apply_lane_fixes(_lmd(spark, d), _fixes(spark, d), FIRST_LISTED).select(*_SHOWN, "Ignore")


def pipeline_lanes_latest(spark: SparkSession, d: str) -> DataFrame:
    """Lane fixes by the fix that started last."""
    return apply_lane_fixes(_lmd(spark, d), _fixes(spark, d), LATEST_START).select(*_SHOWN, "Ignore")


def pipeline_open_starts(spark: SparkSession, d: str) -> DataFrame:
    """As ``pipeline_lanes_first``, where a fix without a readable start holds from the beginning."""
    return apply_lane_fixes(_lmd(spark, d), _fixes(spark, d), FIRST_LISTED, open_start_on_null=True).select(*_SHOWN, "Ignore")


def pipeline_brief(spark: SparkSession, d: str) -> DataFrame:
    """The brief's mark alone, on all rows."""
    rows = nulls_of_tokens(table(spark, d, "combined_lmd").select("lmd_id", "RoadID", "Chainage"))
    return flag_in_brief(rows, nulls_of_tokens(table(spark, d, "workbrief"))).select("lmd_id", "InBrief")


def pipeline_complete(spark: SparkSession, d: str) -> DataFrame:
    """Lane fixes and the brief's mark, as one plan."""
    rows = apply_lane_fixes(_lmd(spark, d), _fixes(spark, d), FIRST_LISTED)
    return flag_in_brief(rows, nulls_of_tokens(table(spark, d, "workbrief"))).select(*_SHOWN, "Ignore", "InBrief")


def _through_csv(df: DataFrame) -> DataFrame:
    (name,) = fresh("csv")
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}"
    write_csv(df, path, in_order=False)
    return read_text_csv(df.sparkSession, path, place=False)


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All records of all files as fields of a CSV, written and read: quotes, commas and line breaks come back, null tokens as nulls."""
    back = _through_csv(table(spark, d, "raw_lines").select("line_id", "file_name", "kind", "line_no", "record_text"))
    return back.select(F.col("line_id").cast("bigint").alias("line_id"), "file_name", "kind", F.col("line_no").cast("int").alias("line_no"), "record_text")


def csv_flags_and_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Flags are written as ``True`` and ``False``, nulls as nothing."""
    from roadloom.functions.scalars import parse_boolean

    rows = table(spark, d, "combined_lmd").select("lmd_id", parse_boolean(F.col("Ignore")).alias("flag"), null_tokens_to_null(F.col("RoadID")).alias("road_id"))
    return _through_csv(rows).select(F.col("lmd_id").cast("bigint").alias("lmd_id"), "flag", "road_id")


def _columns(spark: SparkSession, d: str) -> list[tuple[str, list[str]]]:
    return [(name, table(spark, d, name).columns) for name in _SURVEY_TABLES]


def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Under which column every field stands in every survey table: the first alias that is there."""
    rows = [(name, field, resolve(columns, field)) for name, columns in _columns(spark, d) for field in ALIASES]
    return spark.createDataFrame([r for r in rows if r[2]], "table_name string, field string, column_name string")


def strict_columns(spark: SparkSession, d: str) -> DataFrame:
    """What every survey table lacks of the exact columns of lane fixes and of the flexible ones of combined LMD, and its kind."""
    rows = [
        (name, len(missing_exact(columns, LANE_FIX_COLUMNS)), len(missing_flexible(columns, ["TestDateUTC", "Lane", "RoadName"])), file_kind(columns))
        for name, columns in _columns(spark, d)
    ]
    return spark.createDataFrame(rows, "table_name string, missing_exact int, missing_flexible int, kind string")


# SQL ---------------------------------------------------------------------------------------------------------------------

_NULLS = "('', 'NULL', 'null', 'NA')"
_TRUE, _FALSE = "('1', 'True', 'true', 'TRUE', 'T', 't')", "('0', 'False', 'false', 'FALSE', 'F', 'f', '')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def _token(c: str) -> str:
    return f"CASE WHEN {c} NOT IN {_NULLS} THEN {c} END"


def _flag(c: str) -> str:
    return f"CASE WHEN {c} NOT IN {_NULLS} THEN CASE WHEN trim({c}, {_BLANKS}) IN {_TRUE} THEN true WHEN trim({c}, {_BLANKS}) IN {_FALSE} THEN false END END"


def _number(c: str) -> str:
    return rf"CASE WHEN regexp_full_match(trim({c}, {_BLANKS}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({c}, {_BLANKS}) AS DOUBLE) END"


def _lane_sql(open_starts: bool = False) -> str:
    start = "coalesce(a.us // 1000000 - CASE WHEN a.us < 0 AND a.us % 1000000 <> 0 THEN 1 ELSE 0 END, -62135596800)" if open_starts else "a.us // 1000000"
    return f"""WITH {INSTANTS},
fixes AS (SELECT fix_id AS ord, {start} AS s, b.us // 1000000 AS e, {_token('"Lane"')} AS fl, coalesce({_flag('"Ignore"')}, false) AS fi
    FROM lane_fixes LEFT JOIN t2 a ON a.src = 'fix_from' AND a.row_id = fix_id LEFT JOIN t2 b ON b.src = 'fix_to' AND b.row_id = fix_id),
facts AS (SELECT lmd_id, us, us // 1000000 AS t, {_token('"Lane"')} AS lane, regexp_replace({_token('"RoadName"')}, ' [^ ]*$', '') AS road,
    coalesce({_flag('"Ignore"')}, false) AS own, "RoadID" AS rid, "Chainage" AS ch FROM combined_lmd LEFT JOIN t2 ON src = 'lmd' AND row_id = lmd_id)"""


_FIRST = ", held AS (SELECT lmd_id, min_by(struct_pack(fl := fl, fi := fi), ord) AS f FROM facts JOIN fixes ON t BETWEEN s AND e GROUP BY lmd_id)"
_LATEST = """, one AS (SELECT s, max_by(e, ord) AS e, max_by(struct_pack(fl := fl, fi := fi), ord) AS f FROM (SELECT * FROM fixes WHERE s IS NOT NULL AND e IS NOT NULL) GROUP BY s),
held AS (SELECT lmd_id, CASE WHEN t <= one.e THEN one.f END AS f FROM facts ASOF LEFT JOIN one ON facts.t >= one.s)"""
_LANE = "CASE WHEN f.fl IS NULL OR f.fl = '-1' THEN lane WHEN length(f.fl) > 2 THEN f.fl WHEN length(lane) > 1 THEN substr(lane, 1, 1) || f.fl || substr(lane, 3) ELSE f.fl END"


def _shown_sql(skips: str) -> str:
    return f"""lmd_id, strftime(make_timestamp(us // 1000 * 1000), '%d/%m/%Y %H:%M:%S.%g') AS "TestDateUTC", {_LANE} AS "Lane", road AS "RoadName",
    CASE WHEN f IS NOT NULL AND NOT ({skips}) THEN f.fi ELSE own END AS "Ignore" """


_SKIPS = "coalesce(f.fl = '-1', false)"
_BRIEF = f"""ranges AS (SELECT {_number('"RoadID"')} AS k, round_even({_number('start_chainage')} * 1000 / 10, 0) * 10 AS lo, round_even({_number('end_chainage')} * 1000 / 10, 0) * 10 AS hi FROM workbrief)"""


def _in_brief(rid: str, chainage: str) -> str:
    return f"EXISTS (SELECT 1 FROM ranges WHERE k = {_number(rid)} AND {_number(chainage)} BETWEEN lo AND hi)"


def _alias_sql() -> str:
    listed = ", ".join(f"('{field}', '{name}', {i})" for field, names in ALIASES.items() for i, name in enumerate(names))
    tables = ", ".join(f"'{t}'" for t in _SURVEY_TABLES)
    return f"""WITH listed AS (SELECT * FROM (VALUES {listed}) AS v(field, column_name, place))
SELECT table_name, field, min_by(column_name, place) AS column_name FROM listed JOIN information_schema.columns AS c USING (column_name) WHERE table_name IN ({tables}) GROUP BY table_name, field"""


def _strict_sql() -> str:
    tables = ", ".join(f"'{t}'" for t in _SURVEY_TABLES)
    has = lambda name: f"count(*) FILTER (WHERE column_name = '{name}')"
    any_of = lambda field: f"least(1, count(*) FILTER (WHERE column_name IN ({', '.join(repr(a) for a in ALIASES[field])})))"
    exact = reduce(lambda a, b: f"{a} + {b}", [has(c) for c in LANE_FIX_COLUMNS])
    flexible = reduce(lambda a, b: f"{a} + {b}", [any_of(f) for f in ("TestDateUTC", "Lane", "RoadName")])
    marker = f"count(*) FILTER (WHERE column_name IN ({', '.join(repr(c) for c in LMD_MARKERS)}))"
    return f"""SELECT table_name, CAST(5 - ({exact}) AS INTEGER) AS missing_exact, CAST(3 - ({flexible}) AS INTEGER) AS missing_flexible,
    CASE WHEN {exact} = 5 THEN 'lane_fixes' WHEN {marker} > 0 THEN 'combined_lmd' WHEN {has('RoadName')} + {has('Lane')} = 2 AND count(*) < 20 THEN 'workbrief' ELSE 'unknown' END AS kind
FROM information_schema.columns WHERE table_name IN ({tables}) GROUP BY table_name"""


QUERIES = {
    f.__name__: f
    for f in (
        pipeline_lanes_first, pipeline_lanes_latest, pipeline_open_starts, pipeline_brief, pipeline_complete, csv_round_trip, csv_flags_and_nulls, alias_resolution, strict_columns,
    )
}
SQL = {
    "pipeline_lanes_first": f"{_lane_sql()}{_FIRST} SELECT {_shown_sql(_SKIPS)} FROM facts LEFT JOIN held USING (lmd_id)",
    "pipeline_lanes_latest": f"{_lane_sql()}{_LATEST} SELECT {_shown_sql('false')} FROM facts LEFT JOIN held USING (lmd_id)",
    "pipeline_open_starts": f"{_lane_sql(True)}{_FIRST} SELECT {_shown_sql(_SKIPS)} FROM facts LEFT JOIN held USING (lmd_id)",
    "pipeline_brief": f"""WITH {_BRIEF} SELECT lmd_id, {_in_brief('"RoadID"', '"Chainage"')} AS "InBrief" FROM combined_lmd""",
    "pipeline_complete": f"""{_lane_sql()}{_FIRST}, {_BRIEF} SELECT {_shown_sql(_SKIPS)}, {_in_brief('rid', 'ch')} AS "InBrief" FROM facts LEFT JOIN held USING (lmd_id)""",
    "csv_round_trip": f"SELECT line_id, {_token('file_name')} AS file_name, {_token('kind')} AS kind, line_no, {_token('record_text')} AS record_text FROM raw_lines",
    "csv_flags_and_nulls": f"""SELECT lmd_id, CASE WHEN b THEN 'True' WHEN NOT b THEN 'False' END AS flag, r AS road_id
    FROM (SELECT lmd_id, CASE WHEN trim("Ignore", {_BLANKS}) IN {_TRUE} THEN true WHEN trim("Ignore", {_BLANKS}) IN {_FALSE} THEN false END AS b, {_token('"RoadID"')} AS r FROM combined_lmd)""",
    "alias_resolution": _alias_sql(),
    "strict_columns": _strict_sql(),
}
