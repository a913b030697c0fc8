"""The registered queries over this subpackage's operators, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontamination, licenses, line_dedup, substring_dedup, warc
from tidewright.llm.common import table
from tidewright.llm.decontamination import contamination
from tidewright.llm.language import identify_held_out
from tidewright.llm.media import media_features, store_media
from tidewright.llm.packing import pack
from tidewright.llm.simhash import simhash_components
from tidewright.llm.substring_dedup import dedup_substrings
from tidewright.llm.toxicity import held_out_scores


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", keep_ids=False)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), keep_text=False)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_bundles(table(spark, sf_dir, "pages")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_line_dedup": op4_line_dedup,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_media": op10_media,
}
ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
}
