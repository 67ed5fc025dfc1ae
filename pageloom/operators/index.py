"""Incremental maintenance of the index: differences, pruning, upserts, deletes, renames, dry runs and statistics.

Every operator is a join of tables keyed by path, so that any of them may be larger than memory. New ids are numbered per
partition with offsets from partition counts, so that no window gathers all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .incremental import is_image

#: Images of a dry run that are tried out; images of a batch.
SAMPLE, BATCH = 33, 16


def numbered(rows: DataFrame, order: list, to: str, first: int = 0) -> DataFrame:
    """Adds consecutive numbers from ``first`` in the order of ``order``; equal rows of the order come in any order.

    Rows are range-partitioned once and written with their place (partition and row within it), so that counting and
    numbering read the same partitions, whatever columns each needs. Only the counts are summed up in one task: one row a
    partition, which is also what is broadcast. An order that leaves many rows equal is spread by a hash of the whole row.
    """
    spread = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])
    place = F.monotonically_increasing_id()  # partition in the upper bits, row within it in the lower 33
    held = cut(rows.repartitionByRange(*order, spread).sortWithinPartitions(*order, spread).withColumn("_place", place))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return held.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + within + first).drop("_part", "_before", "_place")


def under(path: Column, root: str) -> Column:
    """True for the root itself and what lies below it, by whole path components."""
    base = root.rstrip("/")
    return (path == (base or "/")) | path.startswith(base + "/")


def difference(disk: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """(path, mtime, state): new, changed or skipped for every image on disk; mtimes are compared exactly."""
    s = stored.select("path", F.col("mtime").alias("_stored"), F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "new").when(F.lit(not full) & F.col("mtime").eqNullSafe(F.col("_stored")), "skipped").otherwise("changed")
    return disk.join(s, "path", "left").select("path", "mtime", state.alias("state"))


def stale(disk: DataFrame, stored: DataFrame, root: str) -> DataFrame:
    """Stored rows under the root that are no longer on disk."""
    return stored.filter(under(F.col("path"), root)).join(disk.select("path"), "path", "left_anti")


def dry_run(disk: DataFrame, stored: DataFrame, root: str) -> DataFrame:
    """One row: to_process, new_files, changed, skipped, stale."""
    d = difference(disk, stored).agg(F.count_if(F.col("state") == "new").alias("new_files"), F.count_if(F.col("state") == "changed").alias("changed"), F.count_if(F.col("state") == "skipped").alias("skipped"))
    gone = stale(disk, stored, root).agg(F.count("*").alias("stale"))
    return d.join(gone, F.lit(True)).select((F.col("new_files") + F.col("changed")).alias("to_process"), "new_files", "changed", "skipped", "stale")


def strided_sample(rows: DataFrame, order: str = "path", size: int = SAMPLE) -> DataFrame:
    """At most ``size`` rows at equal strides over the whole order."""
    n = numbered(rows, [F.col(order)], "_k")
    stride = F.greatest(F.lit(1), F.floor(F.lit(rows.count()) / size))
    return n.filter(F.col("_k") % stride == 0).filter(F.col("_k") / stride < size).drop("_k")


def batches(rows: DataFrame, order: str = "path", size: int = BATCH) -> DataFrame:
    """Adds ``batch``: consecutive groups of ``size`` rows, the last may be shorter."""
    return numbered(rows, [F.col(order)], "_k").withColumn("batch", F.floor(F.col("_k") / size)).drop("_k")


def upsert(files: DataFrame, results: DataFrame, indexed_at: str, lang: str | None) -> DataFrame:
    """``files`` with results (path, mtime, status, text) merged in: ids of known paths stay, new paths get new ones.

    A failed result writes nothing and leaves what was stored; empty ones count as read. Of several results of a path the
    one with the greatest mtime counts.
    """
    done = results.filter(F.col("status") != "failed").groupBy("path").agg(F.max(F.struct("mtime", F.coalesce("text", F.lit("")).alias("text"))).alias("_r"))
    both = files.join(done, "path", "full")
    got = F.col("_r").isNotNull()
    merged = both.select(
        "id", "path", F.when(got, F.col("_r.mtime")).otherwise(F.col("mtime")).alias("mtime"), F.when(got, F.lit(indexed_at)).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.when(got, F.lit(lang)).otherwise(F.col("lang")).alias("lang"), F.col("_r.text").alias("text"), got.alias("written"),
    )
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    fresh = numbered(merged.filter("id is null").drop("id"), [F.col("path")], "id", top + 1)
    return merged.filter("id is not null").unionByName(fresh)


def run_counters(files: DataFrame, results: DataFrame, skipped: int = 0, deleted: int = 0) -> DataFrame:
    """One row: indexed (new paths), updated (known paths), failed, skipped, deleted."""
    known = files.select("path", F.lit(True).alias("_known"))
    r = results.join(known, "path", "left")
    ok = F.col("status") != "failed"
    return r.agg(F.count_if(ok & F.col("_known").isNull()).alias("indexed"), F.count_if(ok & F.col("_known").isNotNull()).alias("updated"), F.count_if(~ok).alias("failed")).select(
        "*", F.lit(skipped).alias("skipped"), F.lit(deleted).alias("deleted")
    )


def delete(files: DataFrame, paths: DataFrame) -> DataFrame:
    """``files`` without the given paths; unknown paths are ignored."""
    return files.join(paths.select("path").distinct(), "path", "left_anti")


def rename(files: DataFrame, moves: DataFrame) -> DataFrame:
    """``files`` after moves (old, new): what stood at a new path goes, the row at the old path takes it, whole row kept."""
    cleared = files.join(moves.select(F.col("new").alias("path")), "path", "left_anti")
    return cleared.join(moves.withColumnRenamed("old", "path"), "path", "left").select(*[F.coalesce("new", "path").alias("path") if c == "path" else F.col(c) for c in files.columns])


def watch_plan(touched: DataFrame, stored: DataFrame, disk: DataFrame) -> DataFrame:
    """(action, path, new_path) for a batch of touched paths.

    A path that is gone but was stored, and one that is there but wasn't, are one renamed file if their mtimes are equal;
    pairs are one to one, in order of path. What is left is deleted or read anew; paths that are neither need nothing.
    """
    t = touched.select("path").distinct()
    state = t.join(stored.select("path", F.col("mtime").alias("_stored")), "path", "left").join(disk.select("path", F.col("mtime").alias("_disk")), "path", "left")
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
    gone = state.filter("_disk is null and _stored is not null").select("path", F.col("_stored").alias("_m")).withColumn("_k", rank("_m"))
    there = state.filter("_disk is not null")
    fresh = there.filter("_stored is null").select("path", F.col("_disk").alias("_m")).withColumn("_k", rank("_m"))
    pairs = gone.withColumnRenamed("path", "old").join(fresh.withColumnRenamed("path", "new"), ["_m", "_k"])
    deletes = gone.join(pairs.select(F.col("old").alias("path")), "path", "left_anti")
    changed = there.join(pairs.select(F.col("new").alias("path")), "path", "left_anti")
    none = F.lit(None).cast("string").alias("new_path")
    return (
        pairs.select(F.lit("rename").alias("action"), F.col("old").alias("path"), F.col("new").alias("new_path"))
        .unionByName(deletes.select(F.lit("delete").alias("action"), "path", none))
        .unionByName(changed.select(F.lit("index").alias("action"), "path", none))
    )


def touched_paths(events: DataFrame) -> DataFrame:
    """Distinct image paths of events that change something: reads and paths without an image's extension drop out."""
    return events.filter((F.col("kind") != "access") & is_image(F.col("path"))).select("path").distinct()


def stats(files: DataFrame) -> DataFrame:
    """One row: file_count and last_indexed_at (null without files)."""
    return files.agg(F.count("*").alias("file_count"), F.max("indexed_at").alias("last_indexed_at"))


def confident_text(words: DataFrame, key: str, order: str, word: str, conf: str, least: float) -> DataFrame:
    """(key, text): the words of at least the confidence in order, joined by a space; nothing kept gives empty text."""
    w = F.trim(F.col(word))
    keep = F.when((F.col(conf) >= least) & (w != ""), F.struct(F.col(order).alias("o"), w.alias("w")))
    return words.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(keep)), lambda x: x["w"]), " ").alias("text"))


def stage_profile(samples: DataFrame) -> DataFrame:
    """(stage, mean_ms, median_ms, share) over images of the least time of each stage; samples: image, stage, ms."""
    least = samples.groupBy("image", "stage").agg(F.min("ms").alias("ms"))
    per = least.groupBy("stage").agg(F.avg("ms").alias("mean_ms"), F.percentile("ms", 0.5).alias("median_ms"), F.sum("ms").alias("_s"))
    return per.join(least.agg(F.sum("ms").alias("_all")), F.lit(True)).select("stage", "mean_ms", "median_ms", (F.col("_s") / F.col("_all")).alias("share"))


def mean_seconds(samples: DataFrame, budget: float = 12.0) -> DataFrame:
    """One row (seconds, measured): the mean over successful samples after the first, until the budget of time is used.

    samples: k (order), seconds, ok. At least one sample is measured even beyond the budget. The samples are those of a dry
    run (``SAMPLE`` at most), so that one task may order them.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    used = samples.withColumn("_used", F.coalesce(F.sum("seconds").over(w), F.lit(0.0))).withColumn("_done", F.coalesce(F.sum(F.when(F.col("ok") & (F.col("k") > 0), 1).otherwise(0)).over(w), F.lit(0)))
    open_ = used.filter((F.col("_used") < budget) | (F.col("_done") < 1))
    return open_.filter((F.col("k") > 0) & F.col("ok")).agg(F.avg("seconds").alias("seconds"), F.count("*").alias("measured"))
