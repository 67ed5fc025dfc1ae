"""Watching a folder: snapshots become events, events batches, batches changes of the index.

Events come from comparing snapshots of the folder, which works on every file system. A batch opens at an event, takes what
comes before the quiet period is over, and closes after ``CAP`` seconds at the latest. A batch is planned by joins (renames by
equal mtimes, deletes, images to read) and applied in that order, each as a new version of the index.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as I
from ..plans.runtime import cut
from ..sources.images import SidecarRecognizer, discover, recognized
from ..sources.store import IndexStore
from .batcher import CAP, QUIET, check_quiet


class WatchError(RuntimeError):
    """The folder can't be watched."""


def index_inside(root: str, index: str) -> bool:
    """True where the index lies under the watched folder, so that writing it would set off the watcher."""
    root, index = (os.path.realpath(p.removeprefix("file://")) for p in (root, index))
    return index == root or index.startswith(root.rstrip("/") + "/")


def default_workers() -> int:
    return max(1, (os.cpu_count() or 1) // 2)


def snapshot_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, kind, mtime): create, modify or remove, between two snapshots (path, mtime)."""
    a, b = before.select("path", F.col("mtime").alias("_a")), now.select("path", F.col("mtime").alias("_b"))
    kind = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "remove").otherwise("modify")
    return a.join(b, "path", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("path", kind.alias("kind"), F.col("_b").alias("mtime"))


def apply_batch(store: IndexStore, touched: DataFrame, disk: DataFrame, recognizer=None, lang: str = "eng") -> dict:
    """Applies a batch of touched paths: renames, then deletes, then reading. Returns the counts of each."""
    stored = store.read("files")
    plan = cut(I.watch_plan(touched, stored.select("path", "mtime"), disk))
    n = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    if n.get("rename") or n.get("delete"):
        files = I.rename(stored, plan.filter("action = 'rename'").select(F.col("path").alias("old"), F.col("new_path").alias("new")))
        store.replace_files(I.delete(files, plan.filter("action = 'delete'")))
    failed = 0
    if n.get("index"):
        results = cut(recognized(disk.join(plan.filter("action = 'index'").select("path"), "path", "left_semi"), recognizer or SidecarRecognizer(), lang))
        failed = results.filter("status = 'failed'").count()
        if failed < n["index"]:
            store.apply(results, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), lang)
    return {"renamed": n.get("rename", 0), "deleted": n.get("delete", 0), "indexed": n.get("index", 0) - failed, "failed": failed}


def watch(store: IndexStore, root: str, quiet: float = QUIET, recognizer=None, lang: str = "eng", poll: float = 0.5, report: Callable[[str], None] = print, rounds: int | None = None, clock=time) -> Iterator[dict]:
    """The counts of each batch as it is applied; ends after ``rounds`` snapshots if given. What goes wrong in a batch is
    reported and its paths stay touched for the next; the loop goes on."""
    check_quiet(quiet)
    if index_inside(root, store.root):
        raise WatchError(f"{store.root} lies inside {root}: choose another folder for the index")
    before, touched, opened, last, k = cut(discover(store.spark, root)), None, 0.0, 0.0, 0
    report("ready")
    while rounds is None or k < rounds:
        clock.sleep(poll)
        k += 1
        now_at = clock.time()
        try:
            now = cut(discover(store.spark, root))
            new = cut(I.touched_paths(snapshot_events(before, now)))
            before = now
            if not new.isEmpty():
                touched = new if touched is None else cut(touched.union(new).distinct())
                opened = opened or now_at
                last = now_at
            if touched is not None and (now_at - last >= quiet or now_at - opened >= CAP):
                counts = apply_batch(store, touched, now, recognizer, lang)
                touched, opened = None, 0.0
                yield counts
        except Exception as e:  # noqa: BLE001
            report(f"warning: {e}")
