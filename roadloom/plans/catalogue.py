"""Queries over the operators of the survey pipeline, on whole stand-in tables, each with its SQL.

Facts are ``events`` (time, lane from the user) and ``lineitem``; intervals are all ``events`` widened by their value,
ranges are all of ``part``. Text forms of times are made from ``events`` and ``orders`` and read back by detection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.common import null_tokens_to_null, table
from roadloom.functions import scalars, timestamps
from roadloom.operators.lookup import CHUNK_S, FIRST_LISTED, LATEST_START, lookup_interval, segments
from roadloom.operators.ranges import mark_in_range
from roadloom.schema import file_kind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _micros(c: Column) -> Column:
    """Microseconds since 1970 of a time without zone, taken as UTC whatever the session's zone; a plain cast where that is UTC."""
    if SparkSession.getActiveSession().conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z"):
        return F.unix_micros(c.cast("timestamp"))
    # Offsets of zones are whole minutes, so what lies below a minute is the same in all of them.
    clock = (F.hour(c) * 60 + F.minute(c)).cast("bigint") * 60_000_000 + F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(60_000_000))
    return F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + clock


# Facts and intervals -----------------------------------------------------------------------------------------------------

_LANE_SQL = "CASE user_id % 4 WHEN 0 THEN 'L1' WHEN 1 THEN 'R1A' WHEN 2 THEN '1' END"
_FIX_LANE_SQL = "CASE event_type WHEN 'view' THEN '2' WHEN 'click' THEN '-1' WHEN 'error' THEN 'TURN' WHEN 'signup' THEN '3' END"
_FIXES_SQL = f"""fixes AS (SELECT -event_id AS ord, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s,
    CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS e, {_FIX_LANE_SQL} AS fl, value > 10 AS fi FROM events)"""
_FACTS_SQL = f"facts AS (SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, {_LANE_SQL} AS lane FROM events)"


def _rewrite_sql(lane: str, fix: str) -> str:
    return (
        f"CASE WHEN {fix} IS NULL OR {fix} = '-1' THEN {lane} WHEN length({fix}) > 2 THEN {fix} "
        f"WHEN length({lane}) > 1 THEN substr({lane}, 1, 1) || {fix} || substr({lane}, 3) ELSE {fix} END"
    )


def _facts(spark: SparkSession, d: str, *further: str) -> DataFrame:
    user = F.col("user_id") % 4
    lane = F.when(user == 0, "L1").when(user == 1, "R1A").when(user == 2, "1")
    return table(spark, d, "events").select("event_id", scalars.epoch_seconds(_micros(F.col("ts"))).alias("t"), lane.alias("lane"), *further)


def _fixes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    lane = F.when(kind == "view", "2").when(kind == "click", "-1").when(kind == "error", "TURN").when(kind == "signup", "3")
    start = scalars.epoch_seconds(_micros(F.col("ts")))
    return table(spark, d, "events").select(
        (-F.col("event_id")).alias("ord"), start.alias("start"), (start + F.floor(F.col("value") * 60).cast("bigint")).alias("end"),
        F.struct(lane.alias("lane"), (F.col("value") > 10).alias("ignore")).alias("payload"),
    )


def _lane_fixed(spark: SparkSession, d: str, policy: str, *further: str) -> DataFrame:
    rows = lookup_interval(_facts(spark, d, *further), _fixes(spark, d), "t", policy, out="fix")
    fix = F.col("fix")
    skip = F.coalesce(fix["lane"] == "-1", F.lit(False)) if policy == FIRST_LISTED else F.lit(False)
    return rows.select(
        "event_id", scalars.rewrite_lane(F.col("lane"), fix["lane"]).alias("lane"), F.when(fix.isNotNull() & ~skip, fix["ignore"]).otherwise(False).alias("ignore"), *further
    )


_FIRST_SQL = f"""WITH {_FIXES_SQL}, {_FACTS_SQL},
m AS (SELECT event_id, min_by(fl, ord) AS x, min_by(struct_pack(fl := fl, fi := fi), ord) AS f FROM facts JOIN fixes ON t BETWEEN s AND e GROUP BY event_id)
SELECT event_id, {_rewrite_sql('lane', 'f.fl')} AS lane, CASE WHEN f IS NOT NULL AND coalesce(f.fl, '') <> '-1' THEN f.fi ELSE false END AS ignore
FROM facts LEFT JOIN m USING (event_id)"""


@_query(_FIRST_SQL)
def lane_fix_first_listed(spark: SparkSession, d: str) -> DataFrame:
    return _lane_fixed(spark, d, FIRST_LISTED)


@_query(
    f"""WITH {_FIXES_SQL}, {_FACTS_SQL},
one AS (SELECT s, max_by(e, ord) AS e, max_by(struct_pack(fl := fl, fi := fi), ord) AS f FROM fixes GROUP BY s),
m AS (SELECT event_id, lane, CASE WHEN t <= one.e THEN one.f END AS f FROM facts ASOF LEFT JOIN one ON facts.t >= one.s)
SELECT event_id, {_rewrite_sql('lane', 'f.fl')} AS lane, CASE WHEN f IS NOT NULL THEN f.fi ELSE false END AS ignore FROM m"""
)
def lane_fix_latest_start(spark: SparkSession, d: str) -> DataFrame:
    return _lane_fixed(spark, d, LATEST_START)


@_query(f"WITH {_FIXES_SQL}, {_FACTS_SQL} SELECT event_id, CAST(min(ord) AS BIGINT) AS ord FROM facts JOIN fixes ON t BETWEEN s AND e GROUP BY event_id")
def lane_fix_segments(spark: SparkSession, d: str) -> DataFrame:
    """Which interval holds at each fact, through the segments alone."""
    fixes = _fixes(spark, d).withColumn("payload", F.struct("ord"))
    index, facts = segments(fixes, FIRST_LISTED), _facts(spark, d)
    hit = (F.floor(facts["t"] / F.lit(CHUNK_S)) == index["chunk"]) & facts["t"].between(index["lo"], index["hi"])
    return facts.join(index, hit).select("event_id", F.col("payload.ord").alias("ord"))


# Ranges ------------------------------------------------------------------------------------------------------------------


@_query(
    "SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND l_quantity BETWEEN p_size AND p_size + 10) AS in_brief FROM lineitem"
)
def in_brief_exists(spark: SparkSession, d: str) -> DataFrame:
    ranges = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + 10).cast("double").alias("hi"))
    marked = mark_in_range(table(spark, d, "lineitem"), ranges, "l_partkey", "l_quantity", "in_brief", "p_partkey", "lo", "hi")
    return marked.select("l_orderkey", "l_linenumber", "in_brief")


@_query(
    """SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey
    AND l_quantity * 1000 BETWEEN round_even(p_retailprice / 100 * 1000 / 10, 0) * 10 AND round_even((p_retailprice / 100 + 9) * 1000 / 10, 0) * 10) AS in_brief FROM lineitem"""
)
def in_brief_km(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("p_retailprice") / 100
    ranges = table(spark, d, "part").select("p_partkey", scalars.round_to_10m(start).alias("lo"), scalars.round_to_10m(start + 9).alias("hi"))
    facts = table(spark, d, "lineitem").withColumn("m", scalars.to_metres(F.col("l_quantity"), True))
    return mark_in_range(facts, ranges, "l_partkey", "m", "in_brief", "p_partkey", "lo", "hi").select("l_orderkey", "l_linenumber", "in_brief")


@_query(
    f"""WITH {_FIXES_SQL}, {_FACTS_SQL},
m AS (SELECT event_id, min_by(struct_pack(fl := fl, fi := fi), ord) AS f FROM facts JOIN fixes ON t BETWEEN s AND e GROUP BY event_id)
SELECT event_id, {_rewrite_sql('lane', 'f.fl')} AS lane, CASE WHEN f IS NOT NULL AND coalesce(f.fl, '') <> '-1' THEN f.fi ELSE false END AS ignore,
strftime(ts, '%d/%m/%Y %H:%M:%S.%g') AS time_text,
EXISTS (SELECT 1 FROM part WHERE p_partkey = user_id AND value BETWEEN p_size AND p_size + 10) AS in_brief
FROM facts JOIN events USING (event_id) LEFT JOIN m USING (event_id)"""
)
def combined_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Lane fixes, standard time text and the range mark in one plan."""
    rows = _lane_fixed(spark, d, FIRST_LISTED, "user_id", "value", "ts").withColumn("time_text", scalars.standard_time_text(_micros(F.col("ts"))))
    ranges = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + 10).cast("double").alias("hi"))
    marked = mark_in_range(rows, ranges, "user_id", "value", "in_brief", "p_partkey", "lo", "hi")
    return marked.select("event_id", "lane", "ignore", "time_text", "in_brief")


# Scalars -----------------------------------------------------------------------------------------------------------------


@_query(f"SELECT event_id, {_rewrite_sql('lane', 'fix')} AS lane FROM (SELECT event_id, {_LANE_SQL} AS lane, {_FIX_LANE_SQL} AS fix FROM events)")
def lane_rewrite(spark: SparkSession, d: str) -> DataFrame:
    rows = _facts(spark, d, "event_type")
    kind = F.col("event_type")
    fix = F.when(kind == "view", "2").when(kind == "click", "-1").when(kind == "error", "TURN").when(kind == "signup", "3")
    return rows.select("event_id", scalars.rewrite_lane(F.col("lane"), fix).alias("lane"))


@_query("SELECT p_partkey, regexp_replace(p_name, ' [^ ]*$', '') AS name FROM part")
def road_name_strip_last_word(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scalars.without_last_word(F.col("p_name")).alias("name"))


_BOOL_SQL = """CASE WHEN trim("Ignore", ' ' || chr(9) || chr(10) || chr(13)) IN ('1','True','true','TRUE','T','t') THEN true
    WHEN trim("Ignore", ' ' || chr(9) || chr(10) || chr(13)) IN ('0','False','false','FALSE','F','f','') THEN false END"""


@_query(f'SELECT lmd_id, {_BOOL_SQL} AS ignore FROM combined_lmd')
def bool_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "combined_lmd").select("lmd_id", scalars.parse_boolean(F.col("Ignore")).alias("ignore"))


@_query(f"SELECT lmd_id, CASE WHEN b THEN 'True' WHEN NOT b THEN 'False' END AS ignore FROM (SELECT lmd_id, {_BOOL_SQL} AS b FROM combined_lmd)")
def bool_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "combined_lmd").select("lmd_id", scalars.boolean_text(scalars.parse_boolean(F.col("Ignore"))).alias("ignore"))


@_query("""SELECT lmd_id, CASE WHEN "RoadID" NOT IN ('','NULL','null','NA') THEN "RoadID" END AS road_id, CASE WHEN "Lane" NOT IN ('','NULL','null','NA') THEN "Lane" END AS lane FROM combined_lmd""")
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "combined_lmd")
    return rows.select("lmd_id", null_tokens_to_null(F.col("RoadID")).alias("road_id"), null_tokens_to_null(F.col("Lane")).alias("lane"))


_NUMBERS_SQL = r"""SELECT lmd_id, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(v AS DOUBLE) END AS chainage
    FROM (SELECT lmd_id, trim("Chainage", ' ' || chr(9) || chr(10) || chr(13)) AS v FROM combined_lmd)"""


@_query(_NUMBERS_SQL)
def number_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Every row; texts that are no numbers give null."""
    return table(spark, d, "combined_lmd").select("lmd_id", scalars.plain_number(F.col("Chainage")).alias("chainage"))


QUERIES["number_coerce_all"], SQL["number_coerce_all"] = number_coerce, _NUMBERS_SQL


@_query("SELECT p_partkey, round_even(p_retailprice / 1000 * 1000 / 10, 0) * 10 AS metres FROM part")
def round_to_10m(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scalars.round_to_10m(F.col("p_retailprice") / 1000).alias("metres"))


# Timestamps --------------------------------------------------------------------------------------------------------------


def _read_back(spark: SparkSession, d: str, source: str, key: str, ts: str, text: Column) -> DataFrame:
    rows = table(spark, d, source).select(key, text.alias("text"))
    out, _ = timestamps.parse_column(rows, "text", [F.col(key)], "us")
    return out.select(key, "us")


def _ts_query(name: str, source: str, key: str, ts: str, text: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _read_back(spark, d, source, key, ts, text())

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, CAST({sql} AS BIGINT) AS us FROM {source}"


def _fmt(c: str, pattern: str) -> Callable[[], Column]:
    return lambda: F.date_format(c, pattern)


_MS, _SEC = "epoch_us(ts) // 1000 * 1000", "epoch_us(ts) // 1000000 * 1000000"
for _name, _pattern, _sql in (
    ("ts_iso", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", _MS),
    ("ts_iso_offset", "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'", f"{_MS} - 7200000000"),
    ("ts_dmy_slash", "dd/MM/yyyy HH:mm:ss", _SEC),
    ("ts_mdy_slash", "MM/dd/yyyy HH:mm:ss", f"CASE WHEN strptime(strftime(ts, '%m/%d/%Y %H:%M:%S'), '%m/%d/%Y %H:%M:%S') IS NOT NULL THEN {_SEC} END"),
    ("ts_dmy_dash", "d-M-yyyy H:mm:ss.SSS", _MS),
    ("ts_ymd_space", "yyyy-MM-dd H:mm:ss", _SEC),
):
    _ts_query(_name, "events", "event_id", "ts", _fmt("ts", _pattern), _sql)
_ts_query("ts_short_year", "orders", "o_orderkey", "o_orderdate", _fmt("o_orderdate", "dd/MM/yy HH:mm:ss"), "epoch_us(try_strptime(strftime(o_orderdate, '%d/%m/%y %H:%M:%S'), '%d/%m/%y %H:%M:%S'))")
_ts_query("ts_unix_s", "events", "event_id", "ts", lambda: F.floor(_micros(F.col("ts")) / 1_000_000).cast("bigint").cast("string"), _SEC)
_ts_query("ts_unix_ms", "events", "event_id", "ts", lambda: F.floor(_micros(F.col("ts")) / 1000).cast("bigint").cast("string"), _MS)
_ts_query("ts_date", "orders", "o_orderkey", "o_orderdate", _fmt("o_orderdate", "yyyy-MM-dd"), "epoch_us(date_trunc('day', o_orderdate))")
_ts_query("ts_date_slash", "orders", "o_orderkey", "o_orderdate", _fmt("o_orderdate", "d/M/yyyy"), "epoch_us(date_trunc('day', o_orderdate))")
_ts_query("ts_fallback", "orders", "o_orderkey", "o_orderdate", _fmt("o_orderdate", "dd.MM.yyyy HH:mm"), "epoch_us(date_trunc('minute', o_orderdate))")


@_query("SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S.%g') AS text FROM events")
def ts_format_out(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalars.standard_time_text(_micros(F.col("ts"))).alias("text"))


@_query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events")
def epoch_floor_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalars.epoch_seconds(_micros(F.col("ts"))).alias("s"))


@_query(
    """SELECT count(*) AS n, count(try_strptime(t, '%d/%m/%Y %H:%M:%S')) AS day_first, count(try_strptime(t, '%m/%d/%Y %H:%M:%S')) AS month_first
    FROM (SELECT strftime(ts, '%m/%d/%Y %H:%M:%S') AS t FROM events)"""
)
def ts_detect_success_rate(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format("ts", "MM/dd/yyyy HH:mm:ss")
    reads = lambda f: F.count(timestamps.read_format(text, f))
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), reads("d/M/yyyy H:mm:ss").alias("day_first"), reads("M/d/yyyy H:mm:ss").alias("month_first"))


@_query(
    """SELECT count(*) FILTER (WHERE v IS NOT NULL AND try_strptime(v, '%Y-%m-%dT%H:%M:%S.%gZ') IS NULL) AS failures, count(*) FILTER (WHERE v IS NULL) AS nulls
    FROM (SELECT CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d') WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS v FROM events)"""
)
def parse_failure_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "error", F.date_format("ts", "yyyy-MM-dd")).when(kind != "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    rows = table(spark, d, "events").select(text.alias("v"))
    rows = rows.withColumn("us", timestamps.read_format(F.col("v"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return rows.agg(timestamps.parse_failures("v", "us").alias("failures"), F.count_if(F.col("v").isNull()).alias("nulls"))


@_query(f"SELECT (SELECT count(*) FROM events) AS rows_in, (SELECT count(*) FROM ({_FIRST_SQL})) AS rows_out, (SELECT count(*) FROM ({_FIRST_SQL}) WHERE ignore) AS ignored")
def row_count_guard(spark: SparkSession, d: str) -> DataFrame:
    """Rows in are rows out, whatever overlaps."""
    seen = table(spark, d, "events").agg(F.count(F.lit(1)).alias("rows_in"), F.lit(0).alias("rows_out"), F.lit(0).alias("ignored"))
    fixed = _lane_fixed(spark, d, FIRST_LISTED).agg(F.lit(0).alias("rows_in"), F.count(F.lit(1)).alias("rows_out"), F.count_if("ignore").alias("ignored"))
    return seen.unionByName(fixed).agg(*[F.sum(c).alias(c) for c in ("rows_in", "rows_out", "ignored")])


_KINDS = ("combined_lmd", "lane_fixes", "workbrief", "orders")


@_query("SELECT * FROM (VALUES ('combined_lmd', 'combined_lmd'), ('lane_fixes', 'lane_fixes'), ('workbrief', 'workbrief'), ('orders', 'unknown')) AS v(table_name, kind)")
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = [(name, file_kind(table(spark, d, name).columns)) for name in _KINDS]
    return spark.createDataFrame(rows, "table_name string, kind string")
