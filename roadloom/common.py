"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as null in the text columns of survey files.
NULL_TOKENS = ("", "NULL", "null", "NA")

_BLANKS = " \t\n\x0b\x0c\r\u00a0\u2007\ufeff"

#: A side of a join is broadcast only when it was measured to have at most so many rows and so many characters.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 64_000_000

#: Copies of the small side, and salts of the large one, where a counted side is too long to be broadcast: at least and at most.
SALTS, MOST_SALTS = 16, 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def trim_blanks(c: Column) -> Column:
    """Without outer white space of any kind (tabs, line ends and no-break spaces too)."""
    return F.btrim(c, F.lit(_BLANKS))


def filled(c: Column) -> Column:
    """Trimmed text, null where only a null token stands there."""
    return null_tokens_to_null(trim_blanks(c))


def plate_key(c: Column) -> Column:
    """Plates compare in capitals with letters and digits only; null tokens are no plate."""
    key = F.regexp_replace(F.upper(filled(c)), r"[^\p{L}\p{Nd}]", "")
    return F.when(key != "", key)


def literal_map(table: dict[str, int]) -> Column:
    """A map of plain words to whole numbers, as one expression (each literal of a long list would cost a call to the JVM)."""
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in table.items()) + ")")


def apart(c: Column) -> Column:
    """``c``, through an expression that takes its projection out of whole-stage code generation.

    For projections of very many expressions: in one stage they make one method of more than 8,000 bytes, which the JVM
    never compiles. A projection by itself is generated as many small methods and runs several times as fast.
    """
    return F.transform(F.array(c), lambda x: x)[0]


def fresh(*hints: str) -> list[str]:
    """Column names that cannot clash with those of a caller's table."""
    tag = uuid.uuid4().hex[:8]
    return [f"__{h}_{tag}" for h in hints]


def fits_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Is the table within the bounds of a broadcast? At most one row beyond the bound is looked at."""
    sizes = small.limit(limit + 1).select(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns]))).alias("chars"))
    row = sizes.agg(F.count(F.lit(1)), F.sum("chars")).first()
    return row[0] <= limit and (row[1] or 0) <= BROADCAST_CHARS


def salts(spark: SparkSession) -> int:
    """A key with a third of all rows is spread over a third of what runs at a time, within bounds."""
    return min(MOST_SALTS, max(SALTS, spark.sparkContext.defaultParallelism // 3))


def lookup_join(facts: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join of a long table with one that holds each key once.

    ``small`` is measured: up to ``limit`` rows it is broadcast and the facts are not moved. Beyond that the join is
    salted - every fact goes to one of several copies of its key - so that a key with a third of all facts is spread.
    """
    if fits_broadcast(small, limit):
        return facts.join(F.broadcast(small), keys, how)
    (salt,) = fresh("salt")
    copies_of = salts(facts.sparkSession)
    # From the row itself, not at random: a task that runs again after a loss must send its rows to the same places.
    kept = [c for c, t in facts.dtypes if not any(x in t for x in ("map<", "variant"))]
    spread = facts.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in kept]), F.lit(copies_of)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(copies_of)])))
    return spread.join(copies, [*keys, salt], how).drop(salt)


def bounded_shard(rows: DataFrame, columns: list[str], shard: int, shards: int, most: int) -> list[tuple]:
    """The rows of one of several hash shards of a table of distinct rows, for a structure that is broadcast.

    Hashing is nearly even, so ``most`` is set well above the even share; more than that is an error, never a loss of rows.
    """
    found = rows.where(F.pmod(F.xxhash64(*columns), F.lit(shards)) == shard).select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows in shard {shard} of {shards}")
    return sorted(tuple(r) for r in found)
