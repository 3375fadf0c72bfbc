"""The lookups over streams: segments and merged ranges are static, so each is a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.common import fits_broadcast
from roadloom.operators.lookup import CHUNK_S, FIRST_LISTED, segments
from roadloom.session import cut_lineage


def stream_lookup(facts: DataFrame, fixes: DataFrame, at: str, bounds: tuple[int, int], policy: str = FIRST_LISTED, out: str = "payload") -> DataFrame:
    """A stream of facts with the payload of the interval that holds at the second in ``at``, or null; one to one.

    ``bounds`` is the span of time that the stream may ask for; facts outside it match nothing. No state is kept, so there
    is no watermark and late facts are looked up like any others.
    """
    index = segments(fixes, policy, None, bounds)
    # Written once: else every micro-batch would cut the segments anew.
    index = index.select(F.col("chunk").alias("__chunk"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("payload").alias("__payload"))
    index = cut_lineage(index)
    if fits_broadcast(index):
        index = F.broadcast(index)
    where = (F.floor(facts[at] / F.lit(CHUNK_S)) == index["__chunk"]) & facts[at].between(index["__lo"], index["__hi"])
    return facts.join(index, where, "left").select(*[facts[f"`{c}`"] for c in facts.columns], F.col("__payload").alias(out))
