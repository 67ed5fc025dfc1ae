"""The core queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import incremental
from . import core_queries
from .runtime import table

Query = Callable[[SparkSession, str], DataFrame]

P1_SQL = r"""
WITH ok AS (SELECT started_at, finished_at FROM index_runs WHERE status = 'ok' AND finished_at IS NOT NULL),
stored AS (
  SELECT f.path, arg_max(f.mtime, CAST(f.indexed_at AS TIMESTAMPTZ)) AS mtime
  FROM files f JOIN ok ON (CAST(f.indexed_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC') BETWEEN ok.started_at AND ok.finished_at
  WHERE f.path IS NOT NULL GROUP BY f.path),
disk AS (
  SELECT path, arg_max(kind, ts) AS kind, arg_max(mtime, ts) AS mtime
  FROM (SELECT path, ts, kind, coalesce(mtime, -1) AS mtime FROM watch_events WHERE kind <> 'access' AND path IS NOT NULL) GROUP BY path)
SELECT d.path FROM disk d LEFT JOIN stored s ON s.path = d.path
WHERE d.kind <> 'remove' AND regexp_matches(d.path, '(?i)[^/\\]\.(jpg|jpeg|png|webp|gif|bmp|tiff|tif)$')
  AND (s.path IS NULL OR s.mtime IS NULL OR s.mtime <> d.mtime)
"""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.files_to_process(table(spark, d, "files"), table(spark, d, "index_runs"), table(spark, d, "watch_events"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return core_queries.QUERIES["search_term"](spark, d)


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found} | core_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL} | core_queries.SQL
