"""Pairing records of two tables by nearest time: neighbour intervals, then a range join on partitioned interval cells.

Every right-hand time owns the whole instants that are nearer to it than to any other time of its entity, cut off at the
tolerance: an interval between the midpoints to its neighbours. Only neighbours within twice the tolerance matter, so they
are looked for inside stretches of time (with their edges repeated on both sides), never over all times of an entity. The
intervals are indexed by the cells of time that they touch - at most two, as a cell is as wide as an interval can be - and
the left-hand times meet them in an equi-join on (entity, cell) with the interval as a condition. Intervals of an entity
are disjoint: each left-hand row meets at most one, and nothing has to be ranked afterwards. The index is written once and
measured: if it is small enough it is broadcast and the left-hand rows are not moved, else both sides meet by (entity, cell).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.common import fits_broadcast
from roadloom.session import cut_lineage

#: An index of at most so many short rows (and ``BROADCAST_CHARS``) is broadcast.
BROADCAST_INDEX = 600_000
#: Neighbours are looked for within stretches of this many tolerances.
STRETCH = 60


def neighbour_intervals(right: DataFrame, tolerance: int) -> DataFrame:
    """(key, t, id, lo, hi) of the distinct (key, t) of ``right``: the whole instants nearest to ``t`` and within tolerance.

    An instant as near to two times goes to the one of the smaller id. Times at the same instant count as one, under the
    smallest id. Rows with a null key, time or id are left out.
    """
    points = right.where("key is not null and t is not null and id is not null").groupBy("key", "t").agg(F.min("id").alias("id"))
    width = STRETCH * tolerance
    cell = lambda t: F.floor(t / F.lit(width)).cast("bigint")
    # Edges: a point within two tolerances of the next or last stretch is also seen there, as a neighbour only.
    reach = 2 * tolerance
    spread = points.withColumn("stretch", F.explode(F.array_distinct(F.array(cell(F.col("t")), cell(F.col("t") - reach), cell(F.col("t") + reach)))))
    w = W.partitionBy("key", "stretch").orderBy("t")
    near = spread.withColumns({"pt": F.lag("t").over(w), "pid": F.lag("id").over(w), "nt": F.lead("t").over(w), "nid": F.lead("id").over(w)})
    near = near.where(F.col("stretch") == cell(F.col("t")))
    # Below: the first instant nearer to t than to pt. Of an even sum the middle instant is a tie.
    back, fore = F.col("pt") + F.col("t"), F.col("t") + F.col("nt")
    half = lambda x: F.expr(f"{x} >> 1")
    near = near.withColumns({"b": back, "f": fore})
    lo = half("b") + F.when((F.pmod(F.col("b"), F.lit(2)) == 0) & (F.col("id") < F.col("pid")), 0).otherwise(1)
    hi = half("f") - F.when((F.pmod(F.col("f"), F.lit(2)) == 0) & (F.col("nid") < F.col("id")), 1).otherwise(0)
    return near.select(
        "key", "t", "id",
        F.greatest(F.col("t") - tolerance, lo).alias("lo"),
        F.least(F.col("t") + tolerance, hi).alias("hi"),
    ).where("lo <= hi")


def pair_nearest(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """(left_id, right_id): every row of ``left`` with a nearest time of ``right`` under the same key, within ``tolerance``.

    Both sides come as (key, t, id) with whole numbers as times; ``tolerance`` is at least 1 and itself still near. Of
    times equally near, before or after, the smallest id wins. Rows with a null key or time pair with nothing; repeated
    rows of ``left`` are paired each for itself, repeated times of ``right`` count once. Empty tables give no pairs.
    Columns other than the three are not looked at.
    """
    width = 2 * tolerance + 1
    cell = lambda t: F.floor(t / F.lit(width)).cast("bigint")
    spans = neighbour_intervals(right.select("key", "t", "id"), tolerance)
    index = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))).select("key", "cell", "lo", "hi", F.col("id").alias("right_id"))
    index = cut_lineage(index)
    if fits_broadcast(index, BROADCAST_INDEX):
        index = F.broadcast(index)
    facts = left.where("key is not null and t is not null").select("key", F.col("t").alias("x"), F.col("id").alias("left_id"), cell(F.col("t")).alias("cell"))
    near = facts.join(index, (facts["key"] == index["key"]) & (facts["cell"] == index["cell"]) & facts["x"].between(index["lo"], index["hi"]))
    return near.select("left_id", "right_id")
