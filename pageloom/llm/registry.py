"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.runtime import cut, spread
from ..plans.runtime import table as plain_table
from . import language, neardup, normalize, packing, pii, quality, reading, scans, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """An input table; those with texts over all cores."""
    out = plain_table(spark, d, name)
    return spread(out) if name in ("ocr_text", "documents") else out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return normalize.look_alike_pairs(table(spark, d, "ocr_text"))


def p2_normalized(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalized(table(spark, d, "ocr_text").distinct()).select("file_id", "normal")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return normalize.look_alike_classes(table(spark, d, "ocr_text"))


def _p3(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("ocr_text", "files", "lang_packs", "common_words", "documents")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(*_p3(spark, d), wrong_only=True).select("file_id", "seg_no", "lang")


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(*_p3(spark, d))


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(*_p3(spark, d)).drop("segments")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "ocr_text"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.linked(table(spark, d, "ocr_text"))[0]


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return neardup.linked(table(spark, d, "ocr_text"))[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "ocr_text"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "ocr_text").distinct())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(table(spark, d, "ocr_text"), table(spark, d, "common_words"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "ocr_text").distinct(), table(spark, d, "common_words"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "ocr_text"), table(spark, d, "common_words"))


def p7_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics_table(table(spark, d, "ocr_text"), table(spark, d, "common_words"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokenizer.token_counts(table(spark, d, "documents")))
    return packing.packed(sizes, table(spark, d, "pack_capacities"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).filter("level <> 'middle'").select("doc_id", "level")


def queries() -> dict[str, Query]:
    return {"p2_found": p2_found, "p2_normalized": p2_normalized, "p2_classes": p2_classes, "p3_found": p3_found, "p3_segments": p3_segments, "p3_languages": p3_languages, "p4_found": p4_found, "p4_groups": p4_groups, "p4_links": p4_links, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_found": p7_found, "p7_statistics": p7_statistics, "p8_ids": p8_ids, "p9_packed": p9_packed, "p10_found": p10_found, "p10_levels": p10_levels}


def oracle_sql() -> dict[str, str]:
    return {}
