"""Column names: aliases, resolution of the first present alias, file kinds, required columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Names under which a field may stand, in order of priority (first present wins).
ALIASES: dict[str, tuple[str, ...]] = {
    "RoadName": ("Road Name", "RoadName", "road_name", "roadname"),
    "RoadID": ("Road ID", "RoadID", "road_id", "roadid", "ROADID", "Road_ID", "road ID"),
    "Lane": ("Lane", "lane"),
    "Chainage": ("Chainage", "chainage", "CHAINAGE", "Location", "location"),
    "TestDateUTC": ("TestDateUTC", "Test Date UTC", "test_date_utc"),
    "From": ("From", "from", "FROM", "Start Time", "start_time"),
    "To": ("To", "to", "TO", "End Time", "end_time"),
    "Ignore": ("Ignore", "ignore", "IGNORE", "Skip", "skip"),
    "Plate": ("Plate", "plate", "PLATE", "License Plate", "license_plate"),
    "RegionID": ("RegionID", "regionid", "REGIONID", "Region ID", "region_id"),
    "Travel": ("Travel", "travel", "TRAVEL", "Direction", "direction"),
    "StartChainage": ("Start Chainage (km)", "From Chainage", "From", "start_chainage", "from_chainage"),
    "EndChainage": ("End Chainage (km)", "To Chainage", "To", "end_chainage", "to_chainage"),
}

#: Chainage columns of these names are in kilometres, the others in metres.
KILOMETRE_NAMES = ("location", "Location")

#: What tells the kinds of files apart.
LANE_FIX_COLUMNS = ("From", "To", "Lane", "Ignore", "Plate")
LMD_MARKERS = ("TestDateUTC", "BinViewerVersion", "tsdSlope2000", "compositeModulus200")
BRIEF_COLUMNS, BRIEF_MAX_COLUMNS = ("RoadName", "Lane"), 20


class SchemaError(ValueError):
    """Columns that a step needs are missing, or a file is of another kind than asked for."""


def resolve(columns: Iterable[str], field: str) -> str | None:
    """The column under which ``field`` stands: its first alias that is present, else none."""
    present = set(columns)
    return next((a for a in ALIASES.get(field, (field,)) if a in present), None)


def need(columns: Iterable[str], field: str, what: str = "table") -> str:
    found = resolve(columns, field)
    if found is None:
        raise SchemaError(f"{what}: no column for {field}; looked for {', '.join(ALIASES.get(field, (field,)))}")
    return found


def missing_exact(columns: Iterable[str], required: Iterable[str]) -> list[str]:
    """Required names that are not there exactly as written."""
    present = set(columns)
    return [c for c in required if c not in present]


def missing_flexible(columns: Iterable[str], fields: Iterable[str]) -> list[str]:
    """Fields of which no alias is there."""
    columns = list(columns)
    return [f for f in fields if resolve(columns, f) is None]


def file_kind(columns: Iterable[str], plate_required: bool = True) -> str:
    """``lane_fixes``, ``combined_lmd``, ``workbrief`` or ``unknown``; the order of the tests matters."""
    names = list(columns)
    present = set(names)
    fixes = set(LANE_FIX_COLUMNS) - (set() if plate_required else {"Plate"})
    if fixes <= present:
        return "lane_fixes"
    if present & set(LMD_MARKERS):
        return "combined_lmd"
    if set(BRIEF_COLUMNS) <= present and len(names) < BRIEF_MAX_COLUMNS:
        return "workbrief"
    return "unknown"


def require_kind(columns: Iterable[str], kind: str, plate_required: bool = True) -> None:
    found = file_kind(columns, plate_required)
    if found != kind:
        raise SchemaError(f"expected a {kind} file, but its columns are those of: {found}")


def loose(name: str) -> str:
    """A name without case, blanks, ``_`` and ``-``."""
    return re.sub(r"[\s_-]", "", name).lower()


def field_keys() -> dict[str, str]:
    """Loose name of every alias to its field. From and To of fixes go before the chainage ends that share these names."""
    keys: dict[str, str] = {}
    for field, names in ALIASES.items():
        for name in (field, *names):
            keys.setdefault(loose(name), field)
    return keys
