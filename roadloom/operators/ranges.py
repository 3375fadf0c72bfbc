"""Existence of a range: is there a range of the same key that holds a value? Rows are marked, never multiplied.

The ranges of a key are first merged into disjoint ones (the range-sorted operator of ``coverage``, so one key with a third
of all ranges is no bottleneck). Each value then lies in one merged range at most, and a left join gives the mark. Ranges
are indexed by cells as wide as befits their length - levels, of which there are a few - so that a range of any width,
mistyped ones too, has at most ``SPREAD`` + 1 cells. Unbounded ranges have none: of each key there are at most two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.common import fits_broadcast, fresh
from roadloom.operators.coverage import continuous_periods
from roadloom.session import cut_lineage

#: Units of a cell of the lowest level; how many cells a range may have, and by how much cells widen from level to level.
CELL, SPREAD = 1000.0, 64

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _common_key(left: str, right: str) -> str:
    """The type in which two keys compare; an error where they are of different kinds."""
    if left == right:
        return left
    if left in _WHOLE and right in _WHOLE:
        return "bigint"
    numeric = lambda t: t in (*_WHOLE, "float", "double") or t.startswith("decimal")
    if numeric(left) and numeric(right):
        return "double"
    raise TypeError(f"keys of type {left} and {right} don't compare")


def _key_text(c: Column, kind: str) -> Column:
    """Equal keys have equal texts: minus zero is zero, and decimals have no trailing zeros."""
    if kind in ("float", "double"):
        return (c.cast(kind) + F.lit(0.0)).cast("string")
    return c.cast(kind).cast("string")


def mark_in_range(facts: DataFrame, ranges: DataFrame, key: str, value: str, out: str, range_key: str, start: str, end: str) -> DataFrame:
    """``facts``, one to one, with boolean ``out``: some range of the same key has ``start`` <= value <= ``end``.

    Values and ends compare as doubles, exactly. Numeric keys compare by value whatever their types (as doubles where these
    differ in kind); a key that is no number compares with its own type only, else this is an error. A null key, value,
    start or end and NaN match nothing; backward ranges hold nothing. An existing column ``out`` is replaced.
    """
    types, other = dict(facts.dtypes), dict(ranges.dtypes)
    kind = _common_key(types[key], other[range_key])
    clean = ranges.select(_key_text(F.col(range_key), kind).alias("k"), F.col(start).cast("double").alias("lo"), F.col(end).cast("double").alias("hi"))
    merged = continuous_periods(clean, "k", "lo", "hi").where("kind = 'period'").select(F.col("k").alias("__k"), F.col("start_us").alias("__lo"), F.col("end_us").alias("__hi"))
    length = F.col("__hi") - F.col("__lo")
    level = F.when(length <= SPREAD * CELL, 0).when(length <= F.lit(1e300), F.ceil(F.log(length / (SPREAD * CELL)) / F.log(F.lit(float(SPREAD))))).otherwise(-1)
    width = F.lit(CELL) * F.pow(F.lit(float(SPREAD)), F.col("__level"))
    cells = F.when(F.col("__level") < 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width)))
    index = cut_lineage(merged.withColumn("__level", level.cast("int")).withColumn("__cell", F.explode(cells)))
    facts = facts.drop(out)
    columns = [F.col(f"`{c}`") for c in facts.columns]
    at = F.col(f"`{value}`").cast("double")
    fact_key, place, hit = fresh("key", "at", "hit")
    rows = facts.select("*", _key_text(F.col(f"`{key}`"), kind).alias(fact_key), F.when(~F.isnan(at), at).alias(place), F.lit(False).alias(hit))
    levels = sorted(r[0] for r in index.select("__level").distinct().collect())
    for number in levels:  # one for every factor of 64 in length: a few
        k, lo, hi, cells = fresh("k", "lo", "hi", "cell")
        part = index.where(F.col("__level") == number).select(F.col("__k").alias(k), F.col("__lo").alias(lo), F.col("__hi").alias(hi), F.col("__cell").alias(cells))
        # Measured too long, it must be told so: Spark's own estimate knows nothing of the cells, and would broadcast it.
        part = F.broadcast(part) if fits_broadcast(part) else part.hint("merge")
        cell = F.lit(0) if number < 0 else F.floor(F.col(place) / F.lit(CELL * float(SPREAD) ** number))
        where = (F.col(fact_key) == F.col(k)) & (cell == F.col(cells)) & F.col(place).between(F.col(lo), F.col(hi))
        rows = rows.join(part, where, "left").select(*columns, fact_key, place, (F.col(hit) | F.col(k).isNotNull()).alias(hit))
    return rows.select(*columns, F.col(hit).alias(out))
