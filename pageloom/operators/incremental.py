"""Processing only new or changed records.

Three pieces, all plain DataFrame plans:

* ``latest_state``   folds an append-only change log into one version per key;
* ``settled_ledger`` keeps, per key, the version stored by the last *successful* transaction;
* ``changed``        anti-joins current ``(key, version)`` pairs with the ledger.

``reread_position`` gives the point from which a log has to be read again: the start of the oldest
transaction that was still open when the last successful run ended. Rows between that point and the end of
the last run may already be processed; the ledger anti-join removes exactly those, so nothing is skipped
and nothing is done twice, whatever failed in between. ``Ledger`` persists the pairs of each run in its own
directory and makes them visible by one atomic rename, so that a run that dies leaves no trace; ``DiskState`` keeps the
folded log between runs, so that only what arrived after the reread position is read.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions of the images that can be indexed (fixed values).
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "tif")


def is_image(path: Column) -> Column:
    """True where a path ends in a supported extension, in any case. A path without a name before the dot counts as
    having no extension, as for a dot file."""
    return path.rlike(r"(?i)[^/\\]\.(?:" + "|".join(IMAGE_EXTENSIONS) + r")$")


def instant(text: Column) -> Column:
    """ISO-8601 text with any offset as a timestamp; null where it can't be read.

    ``Z``, ``+02:00`` and ``+0200`` are understood, fractions kept to the microsecond; text without an offset is UTC.
    """
    t = F.regexp_replace(F.trim(text), r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.try_to_timestamp(F.when(t.rlike(r"(?:[zZ]|[+-]\d\d:\d\d)$"), t).otherwise(F.concat(t, F.lit("Z"))))


def reread_position(runs: DataFrame) -> DataFrame:
    """One row ``(position)``: where the change log must be read from.

    ``runs``: started_at, finished_at, status. The position is the earliest start among the runs that were open at some
    time up to the end of the last successful run and didn't succeed themselves, or the start of that run if there is
    none. Null (read everything) where no run ever succeeded or ``runs`` is empty.
    """
    ok = (F.col("status") == "ok") & F.col("finished_at").isNotNull()
    last = runs.filter(ok).agg(F.max("finished_at").alias("_end"), F.max("started_at").alias("_start"))
    unfinished = runs.filter(~F.coalesce(ok, F.lit(False))).select(F.col("started_at").alias("_s"))
    return (
        last.join(unfinished, F.col("_s") <= F.col("_end"), "left")
        .groupBy("_end", "_start")
        .agg(F.min("_s").alias("_open"))
        .select(F.when(F.col("_end").isNotNull(), F.least("_start", F.coalesce("_open", "_start"))).alias("position"))
    )


def _days(start: Column, end: Column) -> Column:
    return F.sequence(F.to_date(start), F.to_date(end))


def within_successful_run(rows: DataFrame, at: str, runs: DataFrame) -> DataFrame:
    """The rows whose instant ``at`` lies between start and end (both included) of a run with status ok.

    The interval join is an equi-join on the calendar day with the bounds as residual: either side may be large, neither
    has to be broadcast, and a run's length only adds one row per day. Runs don't overlap, and a semi join keeps each
    row once even if they do. Rows with a null instant and runs without an end never match.
    """
    spans = (
        runs.filter((F.col("status") == "ok") & F.col("started_at").isNotNull() & (F.col("finished_at") >= F.col("started_at")))
        .select(F.col("started_at").cast("timestamp").alias("_from"), F.col("finished_at").cast("timestamp").alias("_to"))
        .select("_from", "_to", F.explode(_days(F.col("_from"), F.col("_to"))).alias("_day"))
    )
    return rows.join(spans, (F.to_date(at) == F.col("_day")) & F.col(at).between(F.col("_from"), F.col("_to")), "left_semi")


def latest_state(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per key with ``values`` of its greatest row by ``order``; rows with a null key are ignored.

    A keyed aggregate with map-side combine, so that a key with any share of the rows costs one row per map task.
    Ties are broken by the values, so that repeated rows and rows delivered again can't change the result.
    """
    top = F.max(F.struct(*order, *values)).alias("_top")
    return log.filter(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, *[F.col(f"_top.{v}").alias(v) for v in values])


def changed(current: DataFrame, ledger: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of ``current`` whose (key, version) pair is not in ``ledger``.

    Versions are compared exactly; two null versions count as equal nowhere, so that a record of unknown version is
    always taken up again. Both inputs have one row per key or more; extra columns of ``current`` are kept.
    """
    seen = ledger.select(F.col(key).alias("_key"), F.col(version).alias("_version"))
    return current.join(seen, (F.col(key) == F.col("_key")) & (F.col(version) == F.col("_version")), "left_anti")


def settled_ledger(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, mtime) as last stored by a successful run: the row with the latest ``indexed_at`` within such a run."""
    rows = files.select("path", "mtime", instant(F.col("indexed_at")).alias("_at"))
    return latest_state(within_successful_run(rows, "_at", runs), "path", ["_at"], ["mtime"])


def disk_state(events: DataFrame) -> DataFrame:
    """(path, mtime) of the paths that exist according to a file event log; reads (``access``) never count."""
    log = events.filter(F.col("kind") != "access").select("path", "ts", "event_id", "kind", "mtime")
    return latest_state(log, "path", ["ts", "event_id"], ["kind", "mtime"]).filter(F.col("kind") != "remove").select("path", "mtime")


def files_to_process(files: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """Paths the next run must take up: images on disk whose (path, mtime) isn't settled.

    Defined results: no events gives no rows; no files or no successful run gives every image on disk; null paths and
    kinds are ignored; a null mtime on disk or in the ledger never equals anything, so the path is taken up; repeated
    rows count once.
    """
    current = disk_state(events.filter(is_image(F.col("path"))))
    settled = settled_ledger(files.filter(is_image(F.col("path"))), runs)
    return changed(current, settled, "path", "mtime").select("path")


class Ledger:
    """Processed (key, version) pairs on shared storage, committed once per run.

    ``begin`` notes where in the log of changes (by arrival) a run starts; ``reread_from`` gives the place from which the
    next run has to read: the earliest start among the runs that never ended, else that of the last committed run.
    ``pending`` drops from what was read the records whose latest committed version is the one at hand, so that rereading
    does nothing twice. ``commit`` adds the pairs of a run and ``removed`` keys. The data of a run lie in their own folder; a
    run counts only once its marker has been renamed into place, which file systems do atomically. Committing a run id again
    has no effect, so a retry after a lost reply is safe. ``compact`` brings all folders into one.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, version: str):
        self.spark, self.root, self.key, self.version = spark, root.rstrip("/"), key, version
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path(f"{self.root}/markers"))

    def _markers(self, kind: str) -> list[dict]:
        """Markers of a kind (ok, open, base) in order of time, read in the driver: a few bytes a run."""
        out = []
        for s in self._fs.listStatus(self._path(f"{self.root}/markers")):
            name = s.getPath().getName()
            if name.endswith(f".{kind}"):
                f = self._fs.open(s.getPath())
                out.append(json.loads(bytes(f.readAllBytes()).decode()) | {"run": name[: -len(kind) - 1]})
                f.close()
        return sorted(out, key=lambda m: (m["seq"], m["run"]))

    def _mark(self, run: str, kind: str, what: dict) -> bool:
        final = self._path(f"{self.root}/markers/{run}.{kind}")
        draft = self._path(f"{self.root}/markers/{run}-{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(what | {"seq": time.time_ns()}).encode()))
        out.close()
        return bool(self._fs.rename(draft, final))

    def runs(self) -> list[str]:
        """Committed runs, by name."""
        return sorted({m["run"] for m in self._markers("ok")} | {r for m in self._markers("base") for r in m["runs"]})

    def begin(self, run: str, position: int) -> None:
        """Notes that a run reads the log up to arrival ``position`` (the greatest that exists when it starts)."""
        if not self._fs.exists(self._path(f"{self.root}/markers/{run}.open")):
            self._mark(run, "open", {"position": int(position)})

    def reread_from(self) -> int | None:
        """Arrivals after this one have to be read again; None (read everything) before the first committed run."""
        done, begun = set(self.runs()), self._markers("open")
        last = [m for m in begun if m["run"] in done]
        if not last:
            return None
        first = [m for m in begun if m["run"] not in done]
        # the last committed run has processed what had arrived at its start; a run that never ended may have seen less
        return min([last[-1]["position"], *(m["position"] for m in first)])

    def pairs(self, schema_of: DataFrame) -> DataFrame:
        """The latest committed version of every key that isn't removed; empty, with the types of ``schema_of``, at first."""
        kinds = schema_of.select(self.key, self.version)
        base = self._markers("base")[-1:]
        taken = {r for m in base for r in m["runs"]}
        dirs = [m["data"] for m in base] + [m["data"] for m in self._markers("ok") if m["run"] not in taken]
        if not dirs:
            return kinds.limit(0)
        schema = T.StructType([*kinds.schema.fields, T.StructField("_seq", T.LongType()), T.StructField("_gone", T.BooleanType())])
        rows = self.spark.read.schema(schema).parquet(*dirs)
        return latest_state(rows, self.key, ["_seq"], ["_gone", self.version]).filter(~F.col("_gone")).select(self.key, self.version)

    def pending(self, current: DataFrame) -> DataFrame:
        return changed(current, self.pairs(current), self.key, self.version)

    def commit(self, processed: DataFrame, run: str, removed: DataFrame | None = None) -> bool:
        """Records the pairs of a finished run, and keys that are gone; False if the run was committed before."""
        if run in self.runs():
            return False
        rows = processed.select(self.key, self.version, F.lit(False).alias("_gone"))
        if removed is not None:
            kind = dict(processed.dtypes)[self.version]
            rows = rows.unionByName(removed.select(self.key, F.lit(None).cast(kind).alias(self.version), F.lit(True).alias("_gone")))
        data = f"{self.root}/data/{run}-{uuid.uuid4().hex}"
        rows.distinct().withColumn("_seq", F.lit(time.time_ns())).write.parquet(data)
        return self._mark(run, "ok", {"data": data})

    def compact(self, schema_of: DataFrame) -> None:
        """Writes the latest pairs into one folder that stands for all runs so far. Only folders of runs that were taken in by
        the compaction before this one are deleted, so that a reader that has begun can end."""
        runs, old = self._markers("ok"), self._markers("base")
        if not runs:
            return
        kind = schema_of.select(self.key, self.version)
        data = f"{self.root}/data/base-{uuid.uuid4().hex}"
        self.pairs(kind).withColumn("_seq", F.lit(0).cast("long")).withColumn("_gone", F.lit(False)).write.parquet(data)
        earlier = {r for m in old for r in m["runs"]}
        self._mark(f"all-{uuid.uuid4().hex}", "base", {"data": data, "runs": sorted(earlier | {m["run"] for m in runs})})
        for m in runs:
            if m["run"] in earlier:
                self._fs.delete(self._path(m["data"]), True)
                self._fs.delete(self._path(f"{self.root}/markers/{m['run']}.ok"), False)
        for m in old[:-1]:
            self._fs.delete(self._path(m["data"]), True)
            self._fs.delete(self._path(f"{self.root}/markers/{m['run']}.base"), False)


class DiskState:
    """The folded state of a log of file events, kept between runs so that a run reads what arrived since, not the whole log.

    ``advance(events, ledger)`` reads the events after ``ledger.reread_from()`` (the scan gets the condition on ``event_id``),
    folds them into the stored state and gives the state as of now. Folding is idempotent (the latest ``ts`` of a path
    counts, whenever it arrives), so that events read again change nothing and late ones find their place.
    """

    SCHEMA = "path string, ts timestamp_ntz, event_id long, kind string, mtime double"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _versions(self) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(self.root)) if (n := s.getPath().getName()).startswith("state-") and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def advance(self, events: DataFrame, position: int | None) -> DataFrame:
        """(path, mtime) of the images that exist, after taking in the events that arrived after ``position``."""
        have = self._versions()
        log = events.filter(F.col("kind") != "access").select("path", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "kind", "mtime").filter(is_image(F.col("path")))
        if have and position is not None:
            log = log.filter(F.col("event_id") > position).unionByName(self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/{have[-1]}"))
        to = f"{self.root}/state-{time.time_ns():020d}"
        top = F.max(F.struct("ts", "event_id", "kind", "mtime")).alias("_top")
        log.groupBy("path").agg(top).select("path", "_top.*").write.parquet(to)
        for old in have[:-1]:  # the one before stays for readers that have begun
            self._fs.delete(self._path(f"{self.root}/{old}"), True)
        return self.spark.read.schema(self.SCHEMA).parquet(to).filter(F.col("kind") != "remove").select("path", "mtime")
