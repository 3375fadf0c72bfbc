"""Queries p1 to p4 over the survey tables and their single-problem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.common import plate_key, table
from roadloom.operators.clocks import instants_text, with_instants
from roadloom.operators.coverage import continuous_periods
from roadloom.operators.drift import schema_changes, unified_table, whole_table
from roadloom.operators.rejects import parse_records, rejected_records, whole_records
from roadloom.plans import survey_sql


def fix_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_instants(table(spark, sf_dir, "lane_fixes"), table(spark, sf_dir, "survey_files"), ["From", "To"])


def lmd_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_instants(table(spark, sf_dir, "combined_lmd"), table(spark, sf_dir, "survey_files"), ["TestDateUTC"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lmd, fixes = lmd_instants(spark, sf_dir), fix_instants(spark, sf_dir)

    def part(df: DataFrame, src: str, key: str, c: str) -> DataFrame:
        return df.select(F.lit(src).alias("src"), F.col(key).alias("row_id"), instants_text(F.col(f"{c}_us"), F.col(f"{c}_word")).alias("utc_text"))

    both = fixes.select(
        F.col("fix_id").alias("row_id"),
        F.explode(
            F.array(
                F.struct(F.lit("fix_from").alias("src"), instants_text(F.col("From_us"), F.col("From_word")).alias("utc_text")),
                F.struct(F.lit("fix_to").alias("src"), instants_text(F.col("To_us"), F.col("To_word")).alias("utc_text")),
            )
        ).alias("v"),
    ).select("v.src", "row_id", "v.utc_text")
    return part(lmd, "lmd", "lmd_id", "TestDateUTC").unionByName(both).where("utc_text is not null")


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones of all files of ``combined_lmd`` withheld and estimated anew: per file its values without zone mark that have an
    instant by the stated zone, and how many of them get the same one by the estimate."""
    files = table(spark, sf_dir, "survey_files")
    stated = lmd_instants(spark, sf_dir).withColumnsRenamed({"TestDateUTC_us": "stated_us", "TestDateUTC_word": "stated_word"})
    marked = F.col("TestDateUTC").rlike(r"(?i)([0-9]|\s)(Z|[+-][0-9]{2}:?[0-9]{2}|[A-Z]{3,5})\s*$|^\s*[0-9]{10,}") & ~F.col("TestDateUTC").rlike(r"(?i)[AP]M\s*$")
    bare = stated.withColumn("counts", F.col("stated_us").isNotNull() & ~marked)
    both = with_instants(bare, files.withColumn("zone_name", F.lit(None).cast("string")), ["TestDateUTC"])
    same = F.coalesce(F.col("stated_us") == F.col("TestDateUTC_us"), F.lit(False))
    return both.groupBy("source_file").agg(F.count_if("counts").alias("n_values"), F.count_if(F.col("counts") & same).alias("n_same"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = fix_instants(spark, sf_dir).select(plate_key(F.col("Plate")).alias("plate"), "From_us", "To_us")
    return continuous_periods(fixes, "plate", "From_us", "To_us")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_records(parse_records(table(spark, sf_dir, "raw_lines"), with_fields=False))


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven columns, found by exact name, of the valid records of both kinds, as they load: all columns are in ``p3_whole``."""
    parsed = parse_records(table(spark, sf_dir, "raw_lines"))
    at = lambda c: F.get("fields", (F.array_position("names", F.lit(c)) - 1).cast("int"))
    return parsed.where("reason is null").select("line_id", "kind", *[at(c).alias(c) for c in survey_sql.LOADED_FIELDS])


def p3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records of both kinds with all columns of their files, as they load."""
    return whole_records(parse_records(table(spark, sf_dir, "raw_lines"))).drop("file_name", "line_no")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "feed_rows"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all feeds under nine known columns as text, as written and without the other fields: see ``p4_whole``."""
    return unified_table(table(spark, sf_dir, "feed_rows"), list(survey_sql.TABLE_FIELDS))


def p4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all feeds with all their fields, whatever their files call them, typed and with chainages in metres."""
    return whole_table(table(spark, sf_dir, "feed_rows"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_loaded": p3_loaded, "p4_found": p4_found, "p4_table": p4_table}
QUERIES |= {"p2_zones": p2_zones}
QUERIES |= {"p3_whole": p3_whole, "p4_whole": p4_whole}
SQL: dict[str, str] = {
    "p1_found": survey_sql.P1, "p2_found": survey_sql.P2, "p3_found": survey_sql.P3, "p3_loaded": survey_sql.P3_LOADED, "p4_found": survey_sql.P4, "p4_table": survey_sql.P4_TABLE,
}
SQL |= {"p3_whole": survey_sql.P3_WHOLE, "p4_whole": survey_sql.P4_WHOLE}
