"""The catalogue of language packs as DataFrame operators: filter, difference, lookup and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import verified


def catalogue(spark: SparkSession, path: str | None) -> DataFrame:
    """The table of packs (code, name, iso1, kind, size, sha256) at ``path``; empty without one."""
    schema = "code string, name string, iso1 string, kind string, size long, sha256 string"
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def matching(packs: DataFrame, text: str | None = None) -> DataFrame:
    """Packs whose code or name holds the text, in any case; all without a text."""
    if not text:
        return packs
    t = F.lit(text.lower())
    return packs.filter(F.contains(F.lower("code"), t) | F.contains(F.lower("name"), t))


def with_status(packs: DataFrame, installed: DataFrame) -> DataFrame:
    """Adds ``status`` (installed or available) and ``detector``."""
    here = installed.select("code", F.lit(True).alias("_here")).distinct()
    return packs.join(here, "code", "left").select(*packs.columns, F.when(F.col("_here"), "installed").otherwise("available").alias("status"), (F.col("kind") == "detector").alias("detector"))


def missing(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """Wanted codes that aren't installed, each once."""
    return wanted.select("code").filter("code is not null").distinct().join(installed.select("code"), "code", "left_anti")


def to_copy(active: DataFrame, target: DataFrame) -> DataFrame:
    """Codes of the active folder that the target folder doesn't hold yet."""
    return missing(active, target)


def from_locale(rows: DataFrame, packs: DataFrame, locale: str = "lang") -> DataFrame:
    """Adds the pack code of a locale: by its two-letter language, else the language as a code itself."""
    tag = F.lower(F.element_at(F.split(F.replace(F.col(locale), F.lit("-"), F.lit("_")), "_"), 1))
    iso = packs.filter("iso1 is not null").select(F.col("iso1").alias("_iso"), F.col("code").alias("_a")).dropDuplicates(["_iso"])
    return rows.withColumn("_tag", tag).join(iso, F.col("_tag") == F.col("_iso"), "left").select(*rows.columns, F.coalesce("_a", "_tag").alias("code"))


def verify(downloads: DataFrame, packs: DataFrame) -> DataFrame:
    """(code, ok) of downloaded files (code, content): size and hash must both be those of the catalogue."""
    return downloads.join(packs.select("code", "size", "sha256"), "code", "left").select("code", F.coalesce(verified(F.col("content"), F.col("size"), F.col("sha256")), F.lit(False)).alias("ok"))
