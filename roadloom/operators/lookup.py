"""Point-in-interval lookup, at most one interval per row, by either of two policies.

Overlapping intervals are first cut into disjoint segments, each with the one interval that holds there; a lookup in
segments can match once at most, so rows are never multiplied and nothing is aggregated on the facts' side. Segments are
cut within chunks of time (long intervals are clipped to each chunk they cover, and to the time span of the facts), so no
task sees all intervals, and no interval is paired with another however many overlap; facts meet the segments in an
equi-join on the chunk with the segment as a condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.common import fits_broadcast
from roadloom.session import cut_lineage

FIRST_LISTED, LATEST_START = "first_listed", "latest_start"
#: Seconds of a chunk; a power of two.
CHUNK_S = 4096


def _chunk(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("bigint")


def _clipped(df: DataFrame, keys: list[str], lo: Column, hi: Column, width: int) -> DataFrame:
    """One row per chunk that an interval covers, with its ends clipped to the chunk."""
    rows = df.withColumns({"__a": lo, "__b": hi}).where("__a <= __b")
    rows = rows.withColumn("chunk", F.explode(F.sequence(_chunk(F.col("__a"), width), _chunk(F.col("__b"), width))))
    edge = F.col("chunk") * width
    return rows.withColumns({"__a": F.greatest(F.col("__a"), edge), "__b": F.least(F.col("__b"), edge + (width - 1))})


def _tree_nodes(parts: DataFrame, levels: int) -> DataFrame:
    """Each part [a, b] as the nodes (level, node) of a binary tree that together are just it: at most two of each level.

    Going up the tree, level k has left the nodes from ceil(a / 2^k) to floor((b + 1) / 2^k), the last not counted; an odd
    one at either end is taken there, as its parent would reach out.
    """
    rows = parts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    rows = rows.withColumns({"__l": F.expr("shiftright(a + shiftleft(1L, level) - 1, level)"), "__r": F.expr("shiftright(b + 1, level)")})
    left = F.when((F.col("__l") % 2 == 1) & (F.col("__l") < F.col("__r")), F.col("__l"))
    right = F.when((F.col("__r") % 2 == 1) & (F.col("__l") + F.col("__l") % 2 < F.col("__r")), F.col("__r") - 1)
    rows = rows.where(left.isNotNull() | right.isNotNull())
    return rows.withColumn("node", F.explode(F.array_compact(F.array(left, right)))).drop("__l", "__r")


def _first_listed(fixes: DataFrame, keys: list[str], width: int) -> DataFrame:
    """No interval is compared with another: each is cut into nodes of a binary tree over its chunk, a node keeps the one
    listed first (combined before the shuffle), and the start of each segment asks the nodes above it. Between two starts or
    ends, which are whole seconds and so at most ``width`` in a chunk, the winner is the same.
    """
    levels = width.bit_length() - 1
    parts = _clipped(fixes, keys, F.col("start"), F.col("end"), width)
    base = F.col("chunk") * width
    parts = parts.select(*keys, "chunk", (F.col("__a") - base).cast("bigint").alias("a"), (F.col("__b") - base).cast("bigint").alias("b"), "ord", "payload")
    cuts = parts.select(*keys, "chunk", F.explode(F.array(F.col("a"), F.col("b") + 1)).alias("cut")).distinct()
    following = F.lead("cut").over(W.partitionBy(*keys, "chunk").orderBy("cut"))
    spans = cuts.withColumn("stop", following - 1).where("stop is not null")
    nodes = _tree_nodes(parts, levels).groupBy(*keys, "chunk", "level", "node").agg(F.struct(F.min("ord").alias("ord"), F.min_by("payload", "ord").alias("payload")).alias("best"))
    asks = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.expr("shiftright(cut, level)"))
    met = asks.join(nodes, [*keys, "chunk", "level", "node"])
    won = met.groupBy(*keys, "chunk", "cut", "stop").agg(F.min_by("best.payload", "best.ord").alias("payload"))
    return won.select(*keys, "chunk", (F.col("cut") + base).alias("lo"), (F.col("stop") + base).alias("hi"), "payload")


def _latest_start(fixes: DataFrame, keys: list[str], width: int, bounds: tuple[int, int] | None) -> DataFrame:
    """The interval of the latest start holds until the next start, if its own end is not before; backward ones block too."""
    per_start = fixes.groupBy(*keys, "start").agg(F.max_by(F.struct("end", "payload"), "ord").alias("v"))
    per_start = per_start.select(*keys, "start", "v.end", "v.payload").withColumn("chunk", _chunk(F.col("start"), width))
    inside = F.lead("start").over(W.partitionBy(*keys, "chunk").orderBy("start"))
    # The start after the last one of a chunk is the first of the next chunk that has any: one row per chunk is sorted for it.
    firsts = per_start.groupBy(*keys, "chunk").agg(F.min("start").alias("first"))
    window = W.partitionBy(*keys).orderBy("chunk") if keys else W.orderBy("chunk")
    nexts = firsts.select(*keys, "chunk", F.lead("first").over(window).alias("later"))
    found = per_start.withColumn("inside", inside).join(nexts, [*keys, "chunk"], "left").drop("chunk")
    hi = F.least(F.col("end"), F.coalesce("inside", "later") - 1)
    lo = F.col("start")
    if bounds:
        lo, hi = F.greatest(lo, F.lit(bounds[0])), F.least(hi, F.lit(bounds[1]))
    parts = _clipped(found, keys, lo, hi, width)
    return parts.select(*keys, "chunk", F.col("__a").alias("lo"), F.col("__b").alias("hi"), "payload")


def segments(fixes: DataFrame, policy: str = FIRST_LISTED, keys: list[str] | None = None, bounds: tuple[int, int] | None = None, width: int = CHUNK_S) -> DataFrame:
    """(keys, chunk, lo, hi, payload): disjoint segments of whole seconds, closed at both ends, within chunks of time.

    ``fixes`` has keys, ``ord`` (order of listing), ``start``, ``end`` (seconds) and ``payload``. ``first_listed``: where
    intervals overlap, the one listed first holds. ``latest_start``: only the interval that started last counts (of equal
    starts the one listed last), even where it has ended and an earlier one still covers. Rows with a null start or end
    never match. ``bounds`` clips intervals to the span that will be asked for.
    """
    if width & (width - 1):
        raise ValueError("the width of chunks must be a power of two")
    keys = keys or []
    rows = fixes.where("start is not null and end is not null").select(*keys, "ord", "start", "end", "payload")
    if policy == LATEST_START:
        return _latest_start(rows, keys, width, bounds)
    if bounds:
        rows = rows.withColumns({"start": F.greatest("start", F.lit(bounds[0])), "end": F.least("end", F.lit(bounds[1]))})
    return _first_listed(rows, keys, width)


def lookup_interval(
    facts: DataFrame, fixes: DataFrame, at: str, policy: str = FIRST_LISTED, keys: list[str] | None = None, out: str = "payload", width: int = CHUNK_S
) -> DataFrame:
    """``facts``, one to one, with ``out``: the payload of the interval that holds at the second in column ``at``, or null.

    Facts with a null time or key match nothing and stay. Segments are broadcast where counted to be few, else joined by
    (keys, chunk).
    """
    keys = keys or []
    span = facts.agg(F.min(at), F.max(at)).first()
    bounds = (span[0], span[1]) if span[0] is not None else (0, -1)
    index = segments(fixes, policy, keys, bounds, width).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("chunk").alias("__chunk"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("payload").alias("__payload"))
    index = cut_lineage(index)
    if fits_broadcast(index):
        index = F.broadcast(index)
    where = (_chunk(facts[at], width) == index["__chunk"]) & facts[at].between(index["__lo"], index["__hi"])
    for k in keys:
        where = where & (facts[k] == index[f"__k_{k}"])
    joined = facts.join(index, where, "left")
    return joined.select(*[facts[f"`{c}`"] for c in facts.columns if c != out], F.col("__payload").alias(out))
