"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

1. Every document is measured in tokens of a public tokenizer; sums by source come from one aggregation.
2. Each source gets a quota: its share of the budget, capped at its tokens times its repeats. What capped or empty sources
   leave over goes to the others in proportion to their shares.
3. The documents of a source, in shuffled order, are one stream of tokens, over again in every round up to its repeats.
   The stream ends with the document whose middle is the last before the quota, so a source misses its quota by half a
   document at most. Streams are cut into blocks of ``block_tokens``: a long text lies in several, and all but the last are full.
4. A schedule of slots, one for every block: slot i goes to the source in whose stretch of the cumulative quotas the point
   frac(i * golden ratio) falls, so every stretch of the schedule holds the sources in near exact shares. Slots are ranked
   within their source, and rank r takes block r of its stream: the pieces of documents in order of their slots.

Ranks and running sums are taken in two levels - bounded chunks, then the sums of the chunks - so no source is ever sorted
or summed in one task, however large its part of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.common import lookup_join
from roadloom.session import cut_lineage, map_batches

#: A public tokenizer's file; a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Tokens of a block, rows of a chunk.
BLOCK_TOKENS, CHUNK_ROWS = 512, 50_000
#: Texts that are encoded at a time, and fractional part of the golden ratio.
ENCODE_ROWS, GOLDEN = 256, 0.6180339887498949


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, tokens) of every document, over its whole text; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        encoder.encode_special_tokens = True
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["t"]]
            counts: list[int] = []
            for a in range(0, len(texts), ENCODE_ROWS):
                counts += [len(e.ids) for e in encoder.encode_batch(texts[a : a + ENCODE_ROWS], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": batch["d"], "source": batch["s"], "tokens": counts})

    rows = documents.select(F.col(id_col).cast("bigint").alias("d"), F.col(source_col).alias("s"), F.col(text_col).alias("t")).where("d is not null")
    return map_batches(rows, run, "doc_id bigint, source string, tokens bigint")


def quotas(available: dict[str, int], targets: dict[str, tuple[float, int]], budget: int) -> dict[str, float]:
    """Tokens that each source is to give: shares of the budget, capped by repeats, the rest spread over the others."""
    caps = {s: available.get(s, 0) * max(0, repeats) for s, (_, repeats) in targets.items()}
    out: dict[str, float] = {s: 0.0 for s in targets}
    active = {s for s, (share, _) in targets.items() if share > 0 and caps[s] > 0}
    left = float(budget)
    while active and left > 0:
        weight = sum(targets[s][0] for s in active)
        full = {s for s in active if targets[s][0] / weight * left >= caps[s]}
        if not full:
            out |= {s: targets[s][0] / weight * left for s in active}
            break
        for s in full:
            out[s] = float(caps[s])
            left -= caps[s]
        active -= full
    return out


def schedule(spark: SparkSession, shares: dict[str, float], slots: int) -> DataFrame:
    """(slot, source, rank): the source of every slot, and its rank among the slots of its source, from 0."""
    names = [s for s in sorted(shares) if shares[s] > 0]
    bounds = np.cumsum([shares[s] for s in names]) / (sum(shares.values()) or 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = batch["id"].to_numpy()
            at = np.searchsorted(bounds, (slot * GOLDEN + 0.5) % 1.0, side="right")
            yield pd.DataFrame({"slot": slot, "source": np.array(names, object)[np.minimum(at, len(names) - 1)]})

    picked = map_batches(spark.range(slots), run, "slot bigint, source string").withColumn("chunk", F.floor(F.col("slot") / CHUNK_ROWS))
    counts = picked.groupBy("source", "chunk").count()
    before = F.sum("count").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("source", "chunk", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    return picked.withColumn("inside", inside).join(starts, ["source", "chunk"]).select("slot", "source", (F.col("start") + F.col("inside")).alias("rank"))


def token_blocks(counted: DataFrame, block_tokens: int, documents: int, seed: int) -> DataFrame:
    """(doc_id, source, tokens, offset, block): the place of each document in the stream of its source in shuffled order, and the block in which it begins."""
    buckets = max(1, -(-documents // CHUNK_ROWS))
    rows = counted.withColumns({"bucket": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)), "mixed": F.xxhash64(F.lit(seed + 1), "doc_id")})
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    w = W.partitionBy("source", "bucket").orderBy("mixed", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    offset = F.col("start") + F.col("inside")
    return inside.join(starts, ["source", "bucket"]).select("doc_id", "source", "tokens", offset.alias("offset"), F.floor(offset / block_tokens).cast("bigint").alias("block"))


class Mix:
    """A mix of ``documents`` by ``targets``: ``chosen``, ``report`` and ``schedule``, each a table.

    ``budget`` defaults to the tokens of all documents of the target sources. A document is used at most its source's
    ``max_repeats`` times. Documents without source, of a source without target, or without tokens are not used; of
    repeated rows with one id the one of the most tokens counts. Of repeated target rows the largest share counts; a null
    share counts as 0, null repeats as 1. Empty tables give an empty mix. The list of targets is held by the driver.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER, seed: int = 7):
        self.spark, self.block_tokens, self.seed = documents.sparkSession, block_tokens, seed
        rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("n")).collect()
        self.wanted = {r["source"]: (float(r["share"] or 0), 1 if r["n"] is None else int(r["n"])) for r in rows}
        names = self.spark.createDataFrame([(s,) for s in sorted(self.wanted)], "source string")
        counted = token_counts(documents, tokenizer).where("source is not null and tokens > 0")
        counted = counted.groupBy("doc_id").agg(F.max_by(F.struct("source", "tokens"), F.struct("tokens", "source")).alias("v")).select("doc_id", "v.*")
        self.counted = cut_lineage(lookup_join(counted, names, ["source"], "left_semi"))
        sums = {r["source"]: (r["t"], r["n"]) for r in self.counted.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("doc_id").alias("n")).collect()}
        self.available = {s: int(t) for s, (t, _) in sums.items()}
        self.documents = sum(n for _, n in sums.values())
        self.quota = quotas(self.available, self.wanted, sum(self.available.values()) if budget is None else budget)

    def _used(self) -> DataFrame:
        """(doc_id, source, tokens, offset, total, uses) of the documents that are used."""
        plan = self.spark.createDataFrame([(s, t, float(self.quota[s])) for s, t in sorted(self.available.items())], "source string, total bigint, quota double")
        placed = lookup_join(token_blocks(self.counted, self.block_tokens, self.documents, self.seed), plan, ["source"], "inner")
        rounds = F.floor(F.col("quota") / F.col("total"))
        last = F.when(F.col("offset") + F.col("tokens") / 2 <= F.col("quota") - rounds * F.col("total"), 1).otherwise(0)
        return placed.withColumn("uses", (rounds + last).cast("int")).where("uses > 0").select("doc_id", "source", "tokens", "offset", "total", "uses")

    @property
    def chosen(self) -> DataFrame:
        """(doc_id, source, tokens, uses)."""
        return self._used().select("doc_id", "source", "tokens", "uses")

    @property
    def report(self) -> DataFrame:
        """(source, target_share, available_tokens, quota_tokens, actual_tokens, actual_share), a row for every target source."""
        used = self._used().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("actual_tokens"))
        plan = self.spark.createDataFrame(
            [(s, self.wanted[s][0], self.available.get(s, 0), float(self.quota[s])) for s in sorted(self.wanted)],
            "source string, target_share double, available_tokens bigint, quota_tokens double",
        )
        report = plan.join(used, ["source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
        total = F.sum("actual_tokens").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # a row for every target source
        return report.withColumn("actual_share", F.when(total > 0, F.col("actual_tokens") / total).otherwise(0.0))

    @property
    def schedule(self) -> DataFrame:
        """(slot, source, doc_id, round, first_token, tokens): what stands in each slot, pieces of documents in order of ``first_token``.

        All pieces of a slot are of one source and come to ``block_tokens``, but for the last block of a source. Joined on
        (source, rank), which is a key of the slots, so no source is in one task.
        """
        size = self.block_tokens
        uses = self._used().withColumn("round", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
        uses = uses.withColumn("begin", F.col("round") * F.col("total") + F.col("offset")).withColumn("end", F.col("begin") + F.col("tokens"))
        block = lambda c: F.floor(c / F.lit(size)).cast("bigint")
        pieces = uses.withColumn("rank", F.explode(F.sequence(block(F.col("begin")), block(F.col("end") - 1))))
        a, b = F.greatest(F.col("begin"), F.col("rank") * size), F.least(F.col("end"), (F.col("rank") + 1) * size)
        pieces = pieces.select("source", "rank", "doc_id", "round", (a - F.col("begin")).alias("first_token"), (b - a).alias("tokens"))
        needed = int(sum(self.quota.values()) // size) + len(self.quota)
        if needed <= len(self.quota):
            slots = self.spark.createDataFrame([], "slot bigint, source string, rank bigint")
        else:
            # Golden-ratio points miss a share by a few slots only; a block beyond them would come last, not be lost.
            margin = len(self.quota) * (needed.bit_length() + 4)
            slots = schedule(self.spark, self.quota, needed + margin)
        placed = pieces.join(slots, ["source", "rank"], "left")
        return placed.select(F.coalesce("slot", F.col("rank") + 2 * needed + 10**9).alias("slot"), "source", "doc_id", "round", "first_token", "tokens")


def mix_sources(
    documents: DataFrame, targets: DataFrame, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents and the report of a ``Mix``."""
    mix = Mix(documents, targets, budget, block_tokens, tokenizer, seed)
    return mix.chosen, mix.report
