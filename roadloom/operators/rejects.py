"""Records that fail to parse: valid ones load on a fast columnar path, broken ones come out with the reason.

Records meet the header of their file by a join (never grouped by file). A block of them, of whatever files, is parsed and
checked column by column in one go. Where anything in it fails, it is halved, again and again, until what is left is clean
or a single record, which is then diagnosed strictly. The bulk checks are never looser than the strict ones, so the result
does not depend on how records fall into blocks.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.common import NULL_TOKENS, lookup_join
from roadloom.functions.scalars import FALSE_TOKENS, TRUE_TOKENS
from roadloom.operators.drift import WIDE_FIELDS, field_of
from roadloom.schema import field_keys, loose
from roadloom.session import map_batches

#: Boolean tokens, null tokens included.
BOOLEANS = frozenset((*TRUE_TOKENS, *FALSE_TOKENS, *NULL_TOKENS))

_LANE = r"[LR]?[1-9][A-Z]?"
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2}):(?P<s>\d{2})(?:\.\d{1,6})?"
#: The families in which a record may write its times: ISO and ISO offset, d/m/yyyy (day first), yyyy-mm-dd with time.
_STRICT_TIMES = [
    re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})T{_CLOCK}(?:Z|[+-](?P<oh>\d{{2}}):?(?P<om>\d{{2}}))?", re.ASCII),
    re.compile(rf"(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<y>\d{{4}}) {_CLOCK}", re.ASCII),
    re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}}) {_CLOCK}", re.ASCII),
]
_UNIX = re.compile(r"\d{10}(?:\.\d{1,6})?|\d{13}", re.ASCII)
#: A real offset is at most this far from UTC.
MAX_OFFSET_MINUTES = 14 * 60

_BULK_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?"
_BULK_MD = r"(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
_BULK_DM = r"(?:(?:0?[1-9]|1\d|2[0-8])/(?:0?[1-9]|1[0-2])|(?:29|30)/(?:0?[13-9]|1[0-2])|31/(?:0?[13578]|1[02]))"
#: Times that are certainly real; the 29th of February is left to the strict test.
_BULK_TIME = (
    rf"^(?:(?:20|19)\d\d-{_BULK_MD}T{_BULK_CLOCK}(?:Z|[+-](?:0\d|1[0-3]):?[0-5]\d)?|{_BULK_DM}/(?:20|19)\d\d {_BULK_CLOCK}"
    rf"|(?:20|19)\d\d-{_BULK_MD} {_BULK_CLOCK}|\d{{10}}(?:\.\d{{1,6}})?|\d{{13}})$"
)
_BULK_RECORD = r'^(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*$'


def is_real_time(text: str) -> bool:
    """A time of one of the known families that a calendar and a clock have."""
    if _UNIX.fullmatch(text):
        return True
    for pattern in _STRICT_TIMES:
        m = pattern.fullmatch(text)
        if m:
            g = m.groupdict()
            y, mo, d = int(g["y"]), int(g["m"]), int(g["d"])
            if y < 1 or not 1 <= mo <= 12 or not 1 <= d <= pd.Period(year=max(y, 1), month=mo, freq="M").days_in_month:
                return False
            if int(g["h"]) > 23 or int(g["mi"]) > 59 or int(g["s"]) > 59:
                return False
            if g.get("oh"):
                return int(g["om"]) <= 59 and int(g["oh"]) * 60 + int(g["om"]) <= MAX_OFFSET_MINUTES
            return True
    return False


def split_strictly(record: str) -> list[str] | None:
    """Fields of a record; none where a quotation mark stands anywhere but around a whole field or doubled inside one."""
    fields, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            j, part = i + 1, []
            while True:
                k = record.find('"', j)
                if k < 0:
                    return None
                part.append(record[j:k])
                if record[k + 1 : k + 2] == '"':
                    part.append('"')
                    j = k + 2
                    continue
                i = k + 1
                break
            fields.append("".join(part))
            if i < n and record[i] != ",":
                return None
        else:
            k = record.find(",", i)
            k = n if k < 0 else k
            if '"' in record[i:k]:
                return None
            fields.append(record[i:k])
            i = k
        if i >= n:
            return fields
        i += 1


class Layout:
    """What the header of a file says: number of fields, and which of them are times, lanes or flags."""

    def __init__(self, header: str | None, kind: str):
        names = split_strictly(_content(header)) if header is not None else None
        self.names = [x.strip() for x in names] if names else None
        keys = field_keys()
        fields = [keys.get(loose(x), x) for x in self.names or []]
        wanted = ("TestDateUTC",) if kind == "lmd" else ("From", "To")
        self.times = [i for i, f in enumerate(fields) if f in ("TestDateUTC", "From", "To") and f in wanted]
        self.lanes = [i for i, f in enumerate(fields) if f == "Lane"] if kind == "lmd" else []
        self.flags = [i for i, f in enumerate(fields) if f == "Ignore"] if kind == "fixes" else []

    def diagnose(self, record: str) -> tuple[str | None, list[str] | None]:
        """(reason, fields) of one record by the strict rules, first reason that applies."""
        fields = split_strictly(record)
        if fields is None:
            return "quoting", None
        if self.names is None or len(fields) != len(self.names):
            return "columns", None
        clean = [x.strip() for x in fields]
        for at, reason, good in ((self.times, "timestamp", is_real_time), (self.lanes, "lane", re.compile(_LANE).fullmatch), (self.flags, "ignore", BOOLEANS.__contains__)):
            if any(clean[i] not in NULL_TOKENS and not good(clean[i]) for i in at):
                return reason, None
        return None, fields


def _content(record: str | None) -> str:
    """Without the carriage return (or line end) that ends it."""
    record = record or ""
    return record[:-1] if record.endswith("\r") else record.removesuffix("\r\n").removesuffix("\n")


class Bulk:
    """Records parsed and checked as columns in one go: which are certainly valid, and their fields.

    ``suspects`` counts, up to each record, those that a check does not let pass. A block of records is clean if its count
    is zero, so it can be halved and tested again without parsing anything twice.
    """

    def __init__(self, layouts: list[Layout], records: list[str]):
        good = pc.match_substring_regex(pa.array(records, pa.string()), _BULK_RECORD).to_numpy(zero_copy_only=False) & np.array([r != "" for r in records], bool)
        formed = np.flatnonzero(good).tolist()
        csv.field_size_limit(2**31 - 1)
        rows = list(csv.reader([records[i] for i in formed]))
        if len(rows) != len(formed):  # can't be, as every one of them is a whole record
            formed, rows, good = [], [], np.zeros(len(records), bool)
        self.fields: list[list[str] | None] = [None] * len(records)
        checked: dict[str, tuple[list[int], list[str]]] = {"times": ([], []), "lanes": ([], []), "flags": ([], [])}
        for i, row in zip(formed, rows):
            layout = layouts[i]
            if layout.names is None or len(row) != len(layout.names):
                good[i] = False
                continue
            self.fields[i] = row
            for what, (at, values) in checked.items():
                for k in getattr(layout, what):
                    at.append(i)
                    values.append(row[k].strip())
        for what, test in (
            ("times", lambda c: pc.match_substring_regex(c, _BULK_TIME)),
            ("lanes", lambda c: pc.match_substring_regex(c, f"^{_LANE}$")),
            ("flags", lambda c: pc.is_in(c, pa.array(sorted(BOOLEANS)))),
        ):
            at, values = checked[what]
            column = pa.array(values, pa.string())
            passed = pc.or_(pc.is_in(column, pa.array(NULL_TOKENS)), test(column)).to_numpy(zero_copy_only=False)
            good[np.array(at, np.int64)[~passed]] = False
        self.suspects = np.concatenate([[0], np.cumsum(~good)])

    def clean(self, a: int, b: int) -> bool:
        return self.suspects[a] == self.suspects[b]


def parse_mixed(layouts: list[Layout], records: list[str]) -> list[tuple[str | None, list[str] | None]]:
    """(reason, fields) of every record, each under its own layout: clean blocks as they were parsed in bulk, failing ones
    by halves, down to the single records, which are diagnosed strictly."""
    bulk = Bulk(layouts, records)
    out: list[tuple[str | None, list[str] | None]] = [(None, f) for f in bulk.fields]
    todo = [(0, len(records))]
    while todo:
        a, b = todo.pop()
        if bulk.clean(a, b):
            continue
        if b - a == 1:
            out[a] = layouts[a].diagnose(records[a])
        else:
            middle = (a + b) // 2
            todo += [(a, middle), (middle, b)]
    return out


def parse_block(layout: Layout, records: list[str]) -> list[tuple[str | None, list[str] | None]]:
    """(reason, fields) of every record of one layout."""
    return parse_mixed([layout] * len(records), records)


def parse_records(df: DataFrame, with_fields: bool = True) -> DataFrame:
    """(line_id, file_name, kind, line_no, reason, names, fields): every record but the headers, once each.

    ``reason`` is null for valid records, whose ``fields`` are then the texts under ``names`` (the header of the file);
    else it is the first that applies of ``quoting``, ``columns``, ``timestamp``, ``lane`` and ``ignore``. A null record
    counts as an empty one. A file without a header has no layout: its records are ``quoting`` or ``columns``. Of several
    headers of a file the one of the smallest ``line_id`` holds. ``kind`` other than ``lmd`` or ``fixes``: layout only.
    Repeated records are kept, empty tables give empty ones, further columns are not carried on. Without ``with_fields``
    the last two columns are left out, for reports that need the reasons alone.
    """
    headers = df.where("line_no = 1 and file_name is not null").groupBy("file_name").agg(F.min_by("record_text", "line_id").alias("__header"))
    rows = df.where("line_no is null or line_no <> 1").select("line_id", "file_name", "kind", "line_no", "record_text")
    joined = lookup_join(rows, headers, ["file_name"]).select("line_id", "file_name", "kind", "line_no", "record_text", "__header")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str | None, str | None], Layout] = {}
        for batch in batches:
            header = batch["__header"].astype(object).where(batch["__header"].notna(), None)
            kind = batch["kind"].astype(object).where(batch["kind"].notna(), None)
            layouts = [known.get(key) or known.setdefault(key, Layout(key[0], key[1] or "")) for key in zip(header, kind)]
            judged = parse_mixed(layouts, [_content(t if isinstance(t, str) else "") for t in batch["record_text"]])
            out = {"line_id": batch["line_id"], "file_name": batch["file_name"], "kind": batch["kind"], "line_no": batch["line_no"], "reason": [r for r, _ in judged]}
            if with_fields:
                out |= {"names": [x.names for x in layouts], "fields": [f for _, f in judged]}
            yield pd.DataFrame(out)

    schema = "line_id bigint, file_name string, kind string, line_no int, reason string" + (", names array<string>, fields array<string>" if with_fields else "")
    return map_batches(joined, run, schema)


def loaded_records(parsed: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The valid records of one kind as a table with the named columns (null where a file has no such column)."""
    rows = parsed.where(F.col("reason").isNull() & (F.col("kind") == kind))
    at = lambda c: F.get("fields", (F.array_position("names", F.lit(c)) - 1).cast("int"))
    return rows.select("line_id", "file_name", "line_no", *[F.when(~F.trim(at(c)).isin(*NULL_TOKENS), F.trim(at(c))).alias(c) for c in columns])


def whole_records(parsed: DataFrame, fields: tuple[str, ...] = WIDE_FIELDS) -> DataFrame:
    """The valid records of all kinds with every column of their file: line_id, file_name, kind, line_no, ``fields``, ``others``.

    A field stands in the column named so, else in the first one under an alias of it (as in the checks: without case,
    blanks, ``_`` and ``-``); it is null where the file has none. ``others`` maps the names of all further columns to their
    texts, a second column of one field among them; a repeated name gets its number behind it (``Note (2)``). Texts are as
    written, blanks and null tokens too.
    """
    rows = parsed.where("reason is null")
    keys = F.transform("names", field_of)
    rows = rows.select("line_id", "file_name", "kind", "line_no", "names", "fields", keys.alias("__keys"))
    place = F.array(*[F.coalesce(F.nullif(F.array_position("names", f), F.lit(0)), F.array_position("__keys", field_keys().get(loose(f), loose(f)))) for f in fields])
    rows = rows.withColumn("__places", place)
    before = lambda n, i: F.size(F.filter(F.slice(F.col("names"), F.lit(1), i), lambda x: x == n))
    label = lambda n, i: F.when(before(n, i) == 0, n).otherwise(F.concat(n, F.lit(" ("), (before(n, i) + 1).cast("string"), F.lit(")")))
    entries = F.transform("names", lambda n, i: F.struct(label(n, i).alias("name"), F.get("fields", i).alias("text"), (i + 1).cast("bigint").alias("place")))
    rest = F.filter(entries, lambda e: ~F.array_contains("__places", e["place"]))
    others = F.map_from_entries(F.array_sort(F.transform(rest, lambda e: F.struct(e["name"].alias("name"), e["text"].alias("text")))))
    at = lambda k: F.get("fields", (F.get("__places", F.lit(k)) - 1).cast("int"))
    return rows.select("line_id", "file_name", "kind", "line_no", *[at(k).alias(f) for k, f in enumerate(fields)], others.alias("others"))


def rejected_records(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("line_id", "reason")
