"""CSV sources and sinks of survey files, and in-memory tables under the same rules."""

from __future__ import annotations

import datetime
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.scalars import boolean_text, nulls_of_tokens
from roadloom.schema import SchemaError, require_kind

#: Columns that keep a row's place in its file.
PLACE = ["__file", "__block", "__row"]
#: Suffixes of outputs, unless the caller gives another.
LANES_SUFFIX, BRIEF_SUFFIX, COMPLETE_SUFFIX = "lanes", "workbrief", "complete"
EXTENSIONS = (".csv",)


class MissingFileError(FileNotFoundError):
    """An input path that does not exist."""


def require_file(spark: SparkSession, path: str) -> None:
    """An error where no file or folder stands at a path (patterns are allowed)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        raise MissingFileError(f"{path}: no such file")


def read_text_csv(spark: SparkSession, path: str, place: bool = True, multiline: bool = True) -> DataFrame:
    """Every column as text, null tokens as nulls; with ``place`` also where in which file each row stands.

    Header names are taken as written; names that differ only in case need ``spark.sql.caseSensitive``. Quoted fields may
    hold line breaks, so a file is read by one task; ``multiline`` false splits long files that are known to hold none.
    """
    require_file(spark, path)
    df = spark.read.options(header=True, inferSchema=False, escape='"', enforceSchema=False, multiLine=multiline).csv(path)
    if not place:
        return nulls_of_tokens(df)
    rows = df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]))
    rows = rows.withColumn(PLACE[2], F.monotonically_increasing_id())
    return nulls_of_tokens(rows.select(*[F.col(f"`{c}`") for c in df.columns], *PLACE))


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Types and dates inferred, null tokens as nulls in text columns."""
    require_file(spark, path)
    return nulls_of_tokens(spark.read.options(header=True, inferSchema=True, escape='"', multiLine=True).csv(path))


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a CSV file, broken ones too."""
    require_file(spark, path)
    return spark.read.options(header=True, mode="PERMISSIVE", escape='"', multiLine=True).csv(path).count()


def with_place(df: DataFrame) -> DataFrame:
    """An in-memory table with the places of its rows: the order in which its partitions hold them."""
    if all(c in df.columns for c in PLACE):
        return df
    return df.withColumns({PLACE[0]: F.lit(""), PLACE[1]: F.lit(0).cast("bigint"), PLACE[2]: F.monotonically_increasing_id()})


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in PLACE]


def read_kind(spark: SparkSession, path: str, kind: str, plate_required: bool = True, multiline: bool = True) -> DataFrame:
    """A text CSV that must be of one kind by its header."""
    if not re.search("|".join(re.escape(e) for e in EXTENSIONS) + "$", path.lower()) and "." in PurePosixPath(path).name:
        raise SchemaError(f"{path}: not one of {', '.join(EXTENSIONS)}")
    df = read_text_csv(spark, path, multiline=multiline)
    require_kind(data_columns(df), kind, plate_required)
    return df


def output_name(input_path: str, suffix: str, day: datetime.date | None = None) -> str:
    """``<stem>_<suffix>_<YYYYMMDD>.csv`` next to the input."""
    path = PurePosixPath(input_path)
    return str(path.with_name(f"{path.stem}_{suffix}_{(day or datetime.date.today()):%Y%m%d}.csv"))


def for_csv(df: DataFrame) -> DataFrame:
    """Booleans as ``True``/``False``, everything else as it is, places left out."""
    return df.select(*[boolean_text(F.col(f"`{c}`")).alias(c) if t == "boolean" else F.col(f"`{c}`") for c, t in df.dtypes if c not in PLACE])


def write_csv(df: DataFrame, path: str, in_order: bool = True, single: bool = False) -> None:
    """A folder of CSV parts: header, nulls empty, quotes doubled; in file order where places are known.

    ``single`` writes one part; it is for results that fit one task.
    """
    if in_order and all(c in df.columns for c in PLACE):
        df = df.orderBy(*PLACE)
    out = for_csv(df)
    if single:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(header=True, nullValue="", emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_csv_file(df: DataFrame, path: str, in_order: bool = True) -> None:
    """One CSV file of exactly this name; for results that fit one task."""
    spark = df.sparkSession
    held = f"{path}.parts"
    write_csv(df, held, in_order, single=True)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = fs.globStatus(hadoop.Path(f"{held}/part-*"))
    fs.delete(target, True)
    if not fs.rename(part.getPath(), target):
        raise OSError(f"{held} could not be moved to {path}")
    fs.delete(hadoop.Path(held), True)
