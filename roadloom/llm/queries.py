"""Queries p5 to p9 over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.common import plate_key, table
from roadloom.llm.canonical import map_names
from roadloom.llm.leaks import leaked_items
from roadloom.llm.mixing import Mix, mix_sources
from roadloom.llm.nearest import pair_nearest
from roadloom.llm.quality import COMMON_WORDS, not_prose, quality_statistics, text_figures
from roadloom.plans import survey_sql
from roadloom.plans.survey_queries import fix_instants, lmd_instants

#: Production parameters.
NEAREST_TOLERANCE_US = 5_000_000


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lmd = lmd_instants(spark, sf_dir).select(plate_key(F.col("Plate")).alias("key"), F.col("TestDateUTC_us").alias("t"), F.col("lmd_id").alias("id"))
    fixes = fix_instants(spark, sf_dir).select(plate_key(F.col("Plate")).alias("key"), F.explode(F.array("From_us", "To_us")).alias("t"), F.col("fix_id").alias("id"))
    return pair_nearest(lmd, fixes, NEAREST_TOLERANCE_US).select(F.col("right_id").alias("fix_id"), F.col("left_id").alias("lmd_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "combined_lmd").select("source_file", "RoadName").unionByName(table(spark, sf_dir, "workbrief").select("source_file", "RoadName"))
    found = map_names(typed, table(spark, sf_dir, "road_reference"), ["source_file"], "RoadName", "road_ref_id", "canonical_name")
    return found.select("source_file", F.col("RoadName").alias("raw_name"), "road_ref_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule itself: the pieces of documents in every slot."""
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).schedule


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of all sources."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_prose(table(spark, sf_dir, "documents"))


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of every document."""
    return quality_statistics(table(spark, sf_dir, "documents"))


def p9_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain figures of every document, without labels."""
    return table(spark, sf_dir, "documents").select("doc_id", *text_figures(F.col("text")))


QUERIES = {
    "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_mix": p8_mix, "p8_schedule": p8_schedule, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_stats": p9_stats, "p9_figures": p9_figures,
}
_PLATE = """CASE WHEN trim("Plate") NOT IN ('', 'NULL', 'null', 'NA') THEN nullif(regexp_replace(upper("Plate"), '[^A-Z0-9]', '', 'g'), '') END"""
P5 = f"""WITH {survey_sql.INSTANTS},
ends AS (SELECT {_PLATE} AS plate, us, fix_id FROM lane_fixes JOIN t2 ON src IN ('fix_from', 'fix_to') AND row_id = fix_id WHERE us IS NOT NULL),
facts AS (SELECT {_PLATE} AS plate, us AS t, lmd_id FROM combined_lmd JOIN t2 ON src = 'lmd' AND row_id = lmd_id WHERE us IS NOT NULL)
SELECT min_by(fix_id, (abs(us - t), fix_id)) AS fix_id, lmd_id FROM facts JOIN ends USING (plate) WHERE abs(us - t) <= 5000000 GROUP BY lmd_id"""
_WORDS = r"regexp_extract_all(t, '\p{L}+(?:[''’-]\p{L}+)*')"
_USUAL = ", ".join(f"'{w}'" for w in sorted(COMMON_WORDS))
P9_FIGURES = rf"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, {_WORDS} AS words, regexp_replace(t, '\s+', '', 'g') AS solid, list_filter(regexp_split_to_array(t, '\r\n|[\n\r]'), lambda x: trim(x) <> '') AS lines FROM texts)
SELECT doc_id, CAST(len(words) AS INTEGER) AS word_count, CASE WHEN len(words) > 0 THEN length(array_to_string(words, '')) / len(words) END AS mean_word_length,
    CASE WHEN length(solid) > 0 THEN (length(solid) - length(regexp_replace(solid, '[^\p{{L}}\p{{N}}]', '', 'g'))) / length(solid) END AS symbol_ratio,
    CASE WHEN length(solid) > 0 THEN length(regexp_replace(solid, '\P{{Nd}}', '', 'g')) / length(solid) END AS digit_ratio,
    CAST(len(lines) AS INTEGER) AS line_count,
    CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(regexp_replace(x, '\s+$', ''), '[.!?…:][''"”’)»\]]*$'))) / len(lines) END AS terminal_line_share,
    CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: lower(w) IN ({_USUAL}))) / len(words) END AS common_word_share
FROM parts"""
SQL: dict[str, str] = {"p5_found": P5, "p9_figures": P9_FIGURES}
