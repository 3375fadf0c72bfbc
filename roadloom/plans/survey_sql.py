"""SQL for DuckDB that gives the rows of p1 to p4 by other means: plain joins and windows over whole tables."""

from __future__ import annotations

from roadloom.functions.instants import ABBREVIATIONS, MONTHS
from roadloom.schema import field_keys

_NULLS = "('', 'NULL', 'null', 'NA')"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.](\d{1,9}))?)?(?: ?([AaPp][Mm]))?"
_ZONE = r"(?: ?(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,5}))?"
_PARTS = "['h', 'mi', 's', 'f', 'ap', 'z']"
_ABBR = ", ".join(f"('{zone}', '{name}', {seconds})" for zone, names in ABBREVIATIONS.items() for name, seconds in names.items())
_MONTHS = ", ".join(f"'{m}'" for m in MONTHS)


def _shift(us: str) -> str:
    return f"epoch_us(timezone(zone_name, make_timestamptz({us})))"


#: Instants of every written time: t2 has src, row_id, us and word.
INSTANTS = rf"""vals AS (
    SELECT 'lmd' AS src, lmd_id AS row_id, source_file, "TestDateUTC" AS raw, loaded_at FROM combined_lmd
    UNION ALL SELECT 'fix_from', fix_id, source_file, "From", loaded_at FROM lane_fixes
    UNION ALL SELECT 'fix_to', fix_id, source_file, "To", loaded_at FROM lane_fixes),
texts AS (SELECT src, row_id, source_file, loaded_at, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS v FROM vals),
formed AS (SELECT *,
    regexp_extract(v, '^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]{_CLOCK}{_ZONE}$', ['y', 'm', 'd', 'h', 'mi', 's', 'f', 'ap', 'z']) AS i,
    regexp_extract(v, '^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}}) {_CLOCK}{_ZONE}$', ['a', 'b', 'y', 'h', 'mi', 's', 'f', 'ap', 'z']) AS p,
    regexp_extract(v, '^(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) {_CLOCK}{_ZONE}$', ['d', 'm', 'y', 'h', 'mi', 's', 'f', 'ap', 'z']) AS n,
    regexp_extract(v, '^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(Z)$', ['y', 'm', 'd', 'h', 'mi', 's', 'z']) AS c
    FROM texts WHERE v IS NOT NULL AND v NOT IN {_NULLS}),
parts AS (SELECT src, row_id, source_file, loaded_at, v, p.y <> '' AS pair,
    CASE WHEN i.y <> '' THEN try_cast(i.y || '-' || i.m || '-' || i.d AS DATE)
         WHEN p.y <> '' THEN try_cast(right('20' || p.y, 4) || '-' || p.b || '-' || p.a AS DATE)
         WHEN n.y <> '' THEN try_cast(n.y || '-' || list_position([{_MONTHS}], lower(n.m)) || '-' || n.d AS DATE)
         WHEN c.y <> '' THEN try_cast(c.y || '-' || c.m || '-' || c.d AS DATE) END AS dmy,
    CASE WHEN p.y <> '' THEN try_cast(right('20' || p.y, 4) || '-' || p.a || '-' || p.b AS DATE) END AS mdy,
    i.h || p.h || n.h || c.h AS h, i.mi || p.mi || n.mi || c.mi AS mi, i.s || p.s || n.s || c.s AS s, i.f || p.f || n.f AS f,
    upper(i.ap || p.ap || n.ap) AS ap, i.z || p.z || n.z || c.z AS z,
    CASE WHEN regexp_full_match(v, '\d{{13}}') THEN CAST(v AS BIGINT) * 1000
         WHEN regexp_full_match(v, '\d{{10}}([.]\d{{1,9}})?')
         THEN CAST(left(v, 10) AS BIGINT) * 1000000 + CAST(rpad(left(substr(v, 12), 6), 6, '0') AS BIGINT) END AS unix
    FROM formed),
clocks AS (SELECT *, CASE
    WHEN h = '' OR CAST(mi AS INT) > 59 OR (s <> '' AND CAST(s AS INT) > 59) THEN NULL
    WHEN ap = '' AND CAST(h AS INT) > 23 OR ap <> '' AND CAST(h AS INT) NOT BETWEEN 1 AND 12 THEN NULL
    ELSE ((CASE WHEN ap = '' THEN CAST(h AS BIGINT) ELSE CAST(h AS BIGINT) % 12 + CASE ap WHEN 'PM' THEN 12 ELSE 0 END END * 60 + CAST(mi AS BIGINT)) * 60
        + CASE s WHEN '' THEN 0 ELSE CAST(s AS BIGINT) END) * 1000000 + CASE f WHEN '' THEN 0 ELSE CAST(rpad(left(f, 6), 6, '0') AS BIGINT) END END AS clock
    FROM parts),
evidence AS (SELECT source_file,
    count(*) FILTER (WHERE pair AND dmy IS NULL AND mdy IS NOT NULL) AS bad_dmy, count(*) FILTER (WHERE pair AND mdy IS NULL AND dmy IS NOT NULL) AS bad_mdy,
    sum(least(abs(date_diff('day', dmy, CAST(coalesce(exported_at, loaded_at) AS DATE))), 1000)) FILTER (WHERE pair) AS far_dmy,
    sum(least(abs(date_diff('day', mdy, CAST(coalesce(exported_at, loaded_at) AS DATE))), 1000)) FILTER (WHERE pair) AS far_mdy
    FROM clocks JOIN survey_files USING (source_file) GROUP BY source_file),
orders_of AS (SELECT source_file, zone_name, CASE date_order WHEN 'DMY' THEN true WHEN 'MDY' THEN false
    ELSE coalesce((bad_dmy, coalesce(far_dmy, 0)) <= (bad_mdy, coalesce(far_mdy, 0)), true) END AS day_first
    FROM survey_files LEFT JOIN evidence USING (source_file)),
abbr AS (SELECT * FROM (VALUES {_ABBR}) AS a(zone, name, seconds)),
local_times AS (SELECT src, row_id, z, unix, zone_name, epoch_us(CASE WHEN pair AND NOT day_first THEN mdy ELSE dmy END) + clock AS l,
    CASE WHEN z[1] IN ('+', '-') THEN (CASE z[1] WHEN '-' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS BIGINT) * 3600 + CAST(right(z, 2) AS BIGINT) * 60)
         ELSE (SELECT any_value(seconds) FROM abbr WHERE name = z AND zone IN ('*', zone_name)) END AS offset_s
    FROM clocks JOIN orders_of USING (source_file)),
tried AS (SELECT *, l - ({_shift('l - 86400000000')} - (l - 86400000000)) AS u1, l - ({_shift('l + 86400000000')} - (l + 86400000000)) AS u2 FROM local_times),
checked AS (SELECT *, {_shift('u1')} = l AS ok1, {_shift('u2')} = l AS ok2 FROM tried),
t2 AS (SELECT src, row_id,
    CASE WHEN unix IS NOT NULL THEN unix WHEN z <> '' THEN l - offset_s * 1000000 WHEN ok1 AND ok2 AND u1 <> u2 OR NOT ok1 AND NOT ok2 THEN NULL WHEN ok1 THEN u1 ELSE u2 END AS us,
    CASE WHEN unix IS NOT NULL OR z <> '' OR l IS NULL THEN NULL WHEN ok1 AND ok2 AND u1 <> u2 THEN 'ambiguous' WHEN NOT ok1 AND NOT ok2 THEN 'skipped' END AS word
    FROM checked)"""

P2 = f"""WITH {INSTANTS} SELECT src, row_id, CASE WHEN us IS NOT NULL THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') ELSE word END AS utc_text
FROM t2 WHERE us IS NOT NULL OR word IS NOT NULL"""


def _plate(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN {_NULLS} THEN nullif(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g'), '') END"


P1 = f"""WITH {INSTANTS},
spans AS (SELECT {_plate('"Plate"')} AS plate, a.us AS s, b.us AS e FROM lane_fixes
    JOIN t2 a ON a.src = 'fix_from' AND a.row_id = fix_id JOIN t2 b ON b.src = 'fix_to' AND b.row_id = fix_id),
ordered AS (SELECT *, max(e) OVER (PARTITION BY plate ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM spans WHERE plate IS NOT NULL AND s <= e),
islands AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY plate ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM ordered),
periods AS (SELECT plate, island, min(s) AS a, max(e) AS b FROM islands GROUP BY plate, island),
followed AS (SELECT plate, b, lead(a) OVER (PARTITION BY plate ORDER BY a) AS later FROM periods)
SELECT plate, 'period' AS kind, a AS start_us, b AS end_us FROM periods UNION ALL SELECT plate, 'gap', b, later FROM followed WHERE later IS NOT NULL"""

_FIELDS = ", ".join(f"('{k}', '{v}')" for k, v in field_keys().items())

P4 = rf"""WITH keys AS (SELECT feed, file_seq, unnest(json_keys(payload)) AS name, payload FROM feed_rows WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
typed AS (SELECT feed, file_seq, name, lower(regexp_replace(name, '[\s_-]', '', 'g')) AS bare,
    CASE json_type(payload, '$."' || name || '"') WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind FROM keys),
field_of AS (SELECT * FROM (VALUES {_FIELDS}) AS f(bare, field)),
counted AS (SELECT feed, file_seq, coalesce(field, bare) AS field, name, kind, count(*) AS n FROM typed LEFT JOIN field_of USING (bare) GROUP BY ALL),
names AS (SELECT feed, file_seq, field, min_by(name, (-n, name)) AS name FROM (SELECT feed, file_seq, field, name, sum(n) AS n FROM counted GROUP BY ALL) GROUP BY ALL),
kinds AS (SELECT feed, file_seq, field, min_by(kind, (-n, kind)) AS kind FROM (SELECT feed, file_seq, field, kind, sum(n) AS n FROM counted WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY ALL),
follows AS (SELECT feed, file_seq, lead(file_seq) OVER (PARTITION BY feed ORDER BY file_seq) AS later FROM (SELECT DISTINCT feed, file_seq FROM feed_rows)),
old AS (SELECT feed, later AS file_seq, field, name FROM names JOIN follows USING (feed, file_seq) WHERE later IS NOT NULL),
new AS (SELECT feed, file_seq, field, name FROM names WHERE (feed, file_seq) IN (SELECT (feed, later) FROM follows WHERE later IS NOT NULL)),
both_sides AS (SELECT feed, file_seq, old.name AS o, new.name AS n FROM old FULL JOIN new USING (feed, file_seq, field)),
turned AS (SELECT feed, file_seq, field, kind, lag(kind) OVER (PARTITION BY feed, field ORDER BY file_seq) AS last FROM kinds)
SELECT feed, file_seq, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'renamed' END AS change, coalesce(o, '') AS old_name, coalesce(n, '') AS new_name
FROM both_sides WHERE o IS DISTINCT FROM n
UNION ALL SELECT feed, file_seq, 'retyped', name, name FROM turned JOIN names USING (feed, file_seq, field) WHERE last <> kind"""

_FIELD = r"""("(?:[^"]|"")*"|[^",]*)"""
_REAL_CLOCK = r"([0-9]|[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]{1,6})?"


def _real_time(c: str) -> str:
    date = (
        f"try_cast(CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-') THEN left({c}, 10) "
        f"ELSE regexp_extract({c}, '^([0-9]+)/([0-9]+)/([0-9]{{4}})', 3) || '-' || regexp_extract({c}, '^([0-9]+)/([0-9]+)/', 2) || '-' || regexp_extract({c}, '^([0-9]+)/', 1) END AS DATE) IS NOT NULL"
    )
    form = rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_REAL_CLOCK}(Z|[+-](0[0-9]|1[0-3]):?[0-5][0-9]|[+-]14:?00)?|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} {_REAL_CLOCK}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {_REAL_CLOCK}"
    return f"({c} IN {_NULLS} OR regexp_full_match({c}, '[0-9]{{10}}([.][0-9]{{1,6}})?|[0-9]{{13}}') OR regexp_full_match({c}, '{form}') AND {date})"


def _plain_value(name: str) -> str:
    raw = f"fields[list_position(names, '{name}')]"
    return f"CASE WHEN {raw}[1] = '\"' THEN replace({raw}[2:-2], '\"\"', '\"') ELSE {raw} END"


def _value(name: str) -> str:
    plain = _plain_value(name)
    return f"coalesce(trim({plain}, ' ' || chr(9) || chr(10) || chr(13)), '')"


_P3 = rf"""WITH texts AS (SELECT line_id, file_name, kind, line_no, regexp_replace(coalesce(record_text, ''), '\r$', '') AS t FROM raw_lines),
heads AS (SELECT file_name, [trim(x, '" ') FOR x IN regexp_extract_all(',' || min_by(t, line_id), ',{_FIELD}', 1)] AS names FROM texts WHERE line_no = 1 GROUP BY file_name),
split AS (SELECT line_id, kind, names, regexp_full_match(t, '{_FIELD}(,{_FIELD})*') AS formed, regexp_extract_all(',' || t, ',{_FIELD}', 1) AS fields
    FROM texts LEFT JOIN heads USING (file_name) WHERE line_no <> 1),
named AS (SELECT line_id, kind, formed, coalesce(len(fields) = len(names), false) AS fits, {_value('TestDateUTC')} AS v_time, {_value('From')} AS v_from, {_value('To')} AS v_to,
    {_value('Lane')} AS v_lane, {_value('Ignore')} AS v_ignore FROM split),
judged AS (SELECT line_id, CASE WHEN NOT formed THEN 'quoting' WHEN NOT fits THEN 'columns'
    WHEN kind = 'lmd' AND NOT {_real_time('v_time')} OR kind = 'fixes' AND NOT ({_real_time('v_from')} AND {_real_time('v_to')}) THEN 'timestamp'
    WHEN kind = 'lmd' AND v_lane NOT IN {_NULLS} AND NOT regexp_full_match(v_lane, '[LR]?[1-9][A-Z]?') THEN 'lane'
    WHEN kind = 'fixes' AND v_ignore NOT IN ('1', 'True', 'true', 'TRUE', 'T', 't', '0', 'False', 'false', 'FALSE', 'F', 'f', '', 'NULL', 'null', 'NA') THEN 'ignore' END AS reason FROM named)"""

P3 = f"{_P3} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"

LOADED_FIELDS = ("TestDateUTC", "From", "To", "Lane", "Ignore", "Plate", "RoadName")
_LOADED = ", ".join(f'{_plain_value(c)} AS "{c}"' for c in LOADED_FIELDS)
P3_LOADED = f"{_P3} SELECT line_id, kind, {_LOADED} FROM split WHERE line_id IN (SELECT line_id FROM judged WHERE reason IS NULL)"

TABLE_FIELDS = ("TestDateUTC", "From", "To", "Lane", "Ignore", "Plate", "RoadName", "RoadID", "Chainage")
_WIDE = ", ".join(f"any_value(value) FILTER (WHERE field = '{f}') AS \"{f}\"" for f in TABLE_FIELDS)

P4_TABLE = rf"""WITH rows_of AS (SELECT feed_row_id, feed, file_seq, payload, json_valid(payload) AND json_type(payload) = 'OBJECT' AS good FROM feed_rows),
pairs AS (SELECT feed_row_id, feed, file_seq, payload, unnest(json_keys(payload)) AS name FROM rows_of WHERE good),
typed AS (SELECT feed_row_id, feed, file_seq, name, lower(regexp_replace(name, '[\s_-]', '', 'g')) AS bare, json_extract_string(payload, '$."' || name || '"') AS value,
    CASE json_type(payload, '$."' || name || '"') WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind FROM pairs),
field_of AS (SELECT * FROM (VALUES {_FIELDS}) AS f(bare, field)),
fielded AS (SELECT feed_row_id, feed, file_seq, name, kind, coalesce(field, bare) AS field, CASE kind WHEN 'number' THEN regexp_replace(value, '[.]0+$', '') ELSE value END AS value
    FROM typed LEFT JOIN field_of USING (bare)),
names AS (SELECT feed, file_seq, field, min_by(name, (-n, name)) AS name FROM (SELECT feed, file_seq, field, name, count(*) AS n FROM fielded GROUP BY ALL) GROUP BY ALL),
kinds AS (SELECT feed, file_seq, field, min_by(kind, (-n, kind)) AS kind FROM (SELECT feed, file_seq, field, kind, count(*) AS n FROM fielded WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY ALL),
prints AS (SELECT feed, file_seq, list((field, name, kind) ORDER BY field) AS print FROM names LEFT JOIN kinds USING (feed, file_seq, field) GROUP BY ALL),
turns AS (SELECT feed, file_seq, CASE WHEN lag(print) OVER w IS NOT DISTINCT FROM print THEN 0 ELSE 1 END AS turn FROM prints WINDOW w AS (PARTITION BY feed ORDER BY file_seq)),
versions AS (SELECT feed, file_seq, CAST(sum(turn) OVER (PARTITION BY feed ORDER BY file_seq) AS INTEGER) AS version FROM turns),
single AS (SELECT feed_row_id, field, min_by(value, name) AS value FROM fielded WHERE kind IS NOT NULL GROUP BY ALL),
wide AS (SELECT feed_row_id, {_WIDE} FROM single GROUP BY feed_row_id)
SELECT feed, file_seq, feed_row_id, {", ".join(f'"{f}"' for f in TABLE_FIELDS)}, version FROM rows_of LEFT JOIN wide USING (feed_row_id) LEFT JOIN versions USING (feed, file_seq)"""

# Beside the table of nine names: all fields of all rows, typed, chainages in metres.
_TEXTS = ("RoadName", "RoadID", "Lane", "TestDateUTC", "From", "To", "Plate", "RegionID", "Travel", "BinViewerVersion")
_NUMBERS = ("Chainage", "StartChainage", "EndChainage", "tsdSlope2000", "compositeModulus200")
_KNOWN = ", ".join(f"'{f}'" for f in (*_TEXTS, *_NUMBERS, "Ignore"))
_MARKERS = ", ".join(f"('{f.lower()}', '{f}')" for f in ("BinViewerVersion", "tsdSlope2000", "compositeModulus200"))
_DIGITS = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.][0-9]+)?(?:[eE][+-]?[0-9]{1,3})?"
_BY_FIELD = ", ".join([f"any_value(value) FILTER (WHERE field = '{f}') AS \"{f}\"" for f in _TEXTS] + [f"any_value(number) FILTER (WHERE field = '{f}') AS \"{f}\"" for f in _NUMBERS])
_TEXT_MAP = "coalesce(map_from_entries(list((field, value) ORDER BY field) FILTER (WHERE {})), map_from_entries([]::STRUCT(k VARCHAR, v VARCHAR)[]))"

P4_WHOLE = rf"""{P4_TABLE[: P4_TABLE.index("single AS")]}
marker_of AS (SELECT * FROM (VALUES {_MARKERS}) AS m(field, marker)),
firsts AS (SELECT feed_row_id, coalesce(marker, field) AS field, min_by(value, name) AS value, min(name) IN ('location', 'Location') AS far
    FROM fielded LEFT JOIN marker_of USING (field) WHERE kind IS NOT NULL GROUP BY ALL),
cleaned AS (SELECT *, trim(value, ' ' || chr(9) || chr(10) || chr(13)) AS v FROM firsts),
measured AS (SELECT *, v IN {_NULLS} AS none, replace(regexp_extract(v, '^({_DIGITS}) ?([kK]?[mM])?$', 1), ',', '') AS digits,
    lower(regexp_extract(v, '^({_DIGITS}) ?([kK]?[mM])?$', 2)) AS unit FROM cleaned),
numbered AS (SELECT *, CASE WHEN field NOT IN ('Chainage', 'StartChainage', 'EndChainage', 'tsdSlope2000', 'compositeModulus200') OR digits = '' OR unit <> '' AND field <> 'Chainage' THEN NULL
    WHEN field = 'Chainage' AND (unit = 'km' OR unit = '' AND far) THEN CASE WHEN digits LIKE '%e%' OR digits LIKE '%E%' THEN try_cast(digits AS DOUBLE) * 1000 ELSE try_cast(digits || 'e3' AS DOUBLE) END
    ELSE try_cast(digits AS DOUBLE) END AS number,
    CASE WHEN field = 'Ignore' AND v IN ('1', 'True', 'true', 'TRUE', 'T', 't') THEN true WHEN field = 'Ignore' AND v IN ('0', 'False', 'false', 'FALSE', 'F', 'f', '') THEN false END AS flag FROM measured),
wide AS (SELECT feed_row_id, {_BY_FIELD}, bool_or(flag) FILTER (WHERE field = 'Ignore') AS "Ignore",
    {_TEXT_MAP.format(f"field NOT IN ({_KNOWN})")} AS others,
    {_TEXT_MAP.format("field IN ('Ignore', 'Chainage', 'StartChainage', 'EndChainage', 'tsdSlope2000', 'compositeModulus200') AND NOT none AND number IS NULL AND flag IS NULL")} AS unread
    FROM numbered GROUP BY feed_row_id)
SELECT feed, file_seq, feed_row_id, version, {", ".join(f'"{f}"' for f in (*_TEXTS, *_NUMBERS, "Ignore"))},
    coalesce(others, map_from_entries([]::STRUCT(k VARCHAR, v VARCHAR)[])) AS others, coalesce(unread, map_from_entries([]::STRUCT(k VARCHAR, v VARCHAR)[])) AS unread
FROM rows_of LEFT JOIN wide USING (feed_row_id) LEFT JOIN versions USING (feed, file_seq)"""

# Beside the seven columns of the loaded records: all of them, by cells.
_FOUND = ", ".join(f"any_value(text) FILTER (WHERE field = '{f}' AND turn = 1) AS \"{f}\"" for f in (*_TEXTS, *_NUMBERS, "Ignore"))
P3_WHOLE = rf"""{_P3},
cells AS (SELECT line_id, kind, unnest(names) AS name, unnest(fields) AS raw, generate_subscripts(names, 1) AS i FROM split WHERE line_id IN (SELECT line_id FROM judged WHERE reason IS NULL)),
field_of AS (SELECT * FROM (VALUES {_FIELDS}, {_MARKERS}) AS f(bare, field)),
told AS (SELECT line_id, kind, name, i, field, CASE WHEN raw[1] = '"' THEN replace(raw[2:-2], '""', '"') ELSE raw END AS text,
    row_number() OVER (PARTITION BY line_id, name ORDER BY i) AS repeat, row_number() OVER (PARTITION BY line_id, field ORDER BY name <> field, i) AS turn
    FROM (SELECT *, lower(regexp_replace(name, '[\s_-]', '', 'g')) AS bare FROM cells) AS c LEFT JOIN field_of USING (bare)),
labelled AS (SELECT *, CASE WHEN repeat = 1 THEN name ELSE name || ' (' || repeat || ')' END AS label FROM told)
SELECT line_id, kind, {_FOUND}, coalesce(map_from_entries(list((label, text) ORDER BY label) FILTER (WHERE field IS NULL OR turn > 1)), map_from_entries([]::STRUCT(k VARCHAR, v VARCHAR)[])) AS others
FROM labelled GROUP BY line_id, kind"""
