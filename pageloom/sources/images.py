"""Images on disk: discovery, explicit lists, and recognition behind an interface."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import IMAGE_EXTENSIONS

def is_supported(path: str) -> bool:
    root, ext = os.path.splitext(path)
    return bool(os.path.basename(root)) and ext[1:].lower() in IMAGE_EXTENSIONS


def _walk(top: str) -> Iterator[tuple[str, float]]:
    """Images below a folder; links to folders aren't followed, what can't be read is skipped."""
    stack = [top]
    while stack:
        try:
            entries = list(os.scandir(stack.pop()))
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    stack.append(e.path)
                elif e.is_file() and is_supported(e.path):
                    yield e.path, max(0.0, e.stat().st_mtime)
            except OSError:
                continue


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime) of every image below ``root``. The folders right below it are walked by tasks of their own."""
    root = os.path.realpath(root)
    try:
        top = list(os.scandir(root))
    except OSError:
        top = []
    dirs = [e.path for e in top if e.is_dir(follow_symlinks=False)]
    here = []
    for e in top:
        try:
            if is_supported(e.path) and e.is_file():
                here.append((e.path, max(0.0, e.stat().st_mtime)))
        except OSError:  # gone since it was listed
            continue

    def run(frames):
        for f in frames:
            rows = [r for d in f["dir"] for r in _walk(d)]
            yield pd.DataFrame(rows, columns=["path", "mtime"])

    schema = "path string, mtime double"
    found = spark.createDataFrame(pd.DataFrame(here, columns=["path", "mtime"]).astype({"path": "object", "mtime": "float64"}), schema)
    if dirs:
        found = found.unionByName(spark.createDataFrame([(d,) for d in dirs], "dir string").repartition(len(dirs)).mapInPandas(run, schema))
    return found


def from_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime) of the given images that exist; others are dropped."""
    rows = []
    for p in paths:
        p = os.path.realpath(p)
        if is_supported(p) and os.path.isfile(p):
            rows.append((p, max(0.0, os.stat(p).st_mtime)))
    return spark.createDataFrame(sorted(set(rows)), "path string, mtime double")


class SidecarRecognizer:
    """Reads the text of ``image.png`` from ``image.png.txt``: stands in where no recognition engine is installed."""

    def __call__(self, path: str, lang: str) -> str | None:
        try:
            with open(f"{path}.txt", encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None


def recognized(images: DataFrame, recognizer: Callable[[str, str], str | None], lang: str = "eng") -> DataFrame:
    """(path, mtime, status, text, reason): text, empty or failed. A failure touches its own image only."""

    def run(frames):
        for f in frames:
            out = []
            for p, m in zip(f["path"], f["mtime"]):
                try:
                    t = recognizer(p, lang)
                    reason = None if t is not None else "decode or engine failure"
                except Exception:
                    t, reason = None, "panic during OCR"
                t = " ".join(t.split()) if t is not None else None
                out.append((p, m, "failed" if t is None else "text" if t else "empty", t, reason))
            yield pd.DataFrame(out, columns=["path", "mtime", "status", "text", "reason"])

    return images.select("path", "mtime").mapInPandas(run, "path string, mtime double, status string, text string, reason string")


def failures(results: DataFrame) -> DataFrame:
    """Lines ``path<TAB>reason`` of the failed log."""
    return results.filter("status = 'failed'").select(F.concat_ws("\t", "path", "reason").alias("value"))
