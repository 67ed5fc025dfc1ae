"""Commands: index, watch, search, serve, compact, status, doctor, lang. Exit codes: 0, 1 (nothing to open), 2 (usage or index)."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import subprocess
import sys
from dataclasses import replace
from datetime import UTC, datetime

from .operators import index as I
from .operators import search as S
from .operators.query import QuerySyntaxError
from .plans.runtime import cut, local_session
from .serve import State, find, serve
from .sources import engine
from .sources.config import Config, ConfigError, load, validate_languages
from .sources.images import SidecarRecognizer, discover, failures, recognized
from .sources.packs import catalogue as packs_table
from .sources.packs import matching, verify
from .sources.packs import with_status as packs_with_status
from .sources.store import IndexStore, IndexVersionError
from .streaming.batcher import QUIET
from .streaming.watch import WatchError, watch


def index_directory(store: IndexStore, root: str, recognizer=None, lang: str = "eng", full: bool = False, failed_log: str | None = None) -> dict:
    """One indexing run: prune, read what is new or changed, merge. Returns the counters."""
    disk = cut(discover(store.spark, root))
    files = store.read("files")
    gone = I.stale(disk, files, root)
    deleted = gone.count()
    if deleted:
        store.replace_files(I.delete(files, gone))
        files = store.read("files")
    state = I.difference(disk, files, full)
    results = cut(recognized(state.filter("state <> 'skipped'"), recognizer or SidecarRecognizer(), lang))
    counts = I.run_counters(files, results, state.filter("state = 'skipped'").count(), deleted).first().asDict()
    if failed_log:
        failures(results).write.mode("overwrite").text(failed_log)
    if not results.filter("status <> 'failed'").isEmpty():
        store.apply(results, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), lang)
    return counts


def preflight(lang: str, min_conf: float | None, packs: list[str] | None) -> None:
    """Refuses what a run can't use: a confidence out of range, a language that can't be read or isn't installed."""
    if min_conf is not None and not 0 <= min_conf <= 100:
        raise ConfigError(f"min-conf = {min_conf}: 0 to 100")
    validate_languages(lang)
    gap = engine.first_missing(lang, packs) if packs is not None else None
    if gap:
        raise ConfigError(f"language {gap} isn't installed")


def doctor(store: IndexStore | None, cfg: Config, problem: str | None = None) -> dict:
    """What a run would find on this machine."""
    tries, folder = engine.attempts(), engine.pack_folder()
    return {
        "engine": next((t.candidate for t in tries if t.outcome == "Loaded"), None), "attempts": [vars(t) for t in tries], "packs": folder, "languages": engine.codes_in(folder) if folder else [],
        "wanted": cfg.languages, "missing": engine.first_missing(cfg.languages, engine.codes_in(folder) if folder else []), "offline": engine.is_offline(), "index": store.stats() if store else None, "problem": problem,
    }


def languages(a, spark) -> int:
    """The commands about language packs; ``available`` reads the catalogue, a table of packs."""
    folder = engine.pack_folder()
    here = engine.codes_in(folder) if folder else []
    if a.what == "path":
        print(folder or "none")
    elif a.what == "list":
        print("\n".join(here) or "none installed")
    elif a.what == "available":
        packs = packs_table(spark, a.catalogue)
        rows = packs_with_status(matching(packs, a.filter), spark.createDataFrame([(c,) for c in here], "code string")).orderBy("code").collect()
        print("\n".join(f"{r['code']}\t{r['name']}\t{r['status']}" + ("\tdetector" if r["detector"] else "") for r in rows))
    elif a.what == "add":
        target = os.path.expanduser(engine.USER_PACKS)
        os.makedirs(target, exist_ok=True)
        bad = [r["code"] for r in verify(spark.createDataFrame([(c, open(os.path.join(a.source, c + engine.SUFFIX), "rb").read()) for c in a.codes], "code string, content binary"), packs_table(spark, a.catalogue)).filter("not ok").collect()]
        if bad:
            print(f"size or hash differs: {' '.join(sorted(bad))}", file=sys.stderr)
            return 2
        # what the active folder has would be hidden by the new one: it comes along
        for code, at in [*((c, folder) for c in engine.shadowed(target)), *((c, a.source) for c in a.codes)]:
            shutil.copyfile(os.path.join(at, code + engine.SUFFIX), os.path.join(target, code + engine.SUFFIX))
    else:
        gone = [c for c in a.codes if c in here]
        if not a.yes:
            print(f"would remove {' '.join(gone) or 'nothing'}; say --yes", file=sys.stderr)
            return 2
        for c in gone:
            os.remove(os.path.join(folder, c + engine.SUFFIX))
    return 0


HINTS = {"standard": "No results. --fuzzy also finds misspelt and misread words.", "fuzzy": "No results.", "substring": "No results. Strings of fewer than three characters are ignored."}


def _matcher(p: argparse.ArgumentParser) -> None:
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("--fuzzy", action="store_true")
    kind.add_argument("--fuzzy-distance", type=int, choices=range(S.MOST_DISTANCE + 1))
    kind.add_argument("--substring", action="store_true")
    p.add_argument("--limit", type=int)


def _state(a, cfg: Config, snippet: bool) -> State:
    fuzzy = a.fuzzy or a.fuzzy_distance is not None
    if a.limit is not None and a.limit < 1:
        raise ConfigError(f"limit = {a.limit}")
    return State(a.limit or cfg.default_limit, "substring" if a.substring else "fuzzy" if fuzzy else "standard", a.fuzzy_distance, snippet, getattr(a, "verbose", False))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pageloom")
    p.add_argument("--db")
    p.add_argument("--config", default="")
    p.add_argument("--offline", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "watch"):
        c = sub.add_parser(name)
        c.add_argument("directory")
        c.add_argument("--lang")
        c.add_argument("--min-conf", type=float)
        if name == "index":
            c.add_argument("--full-reindex", action="store_true")
            c.add_argument("--dry-run", action="store_true")
            c.add_argument("--failed-log")
        else:
            c.add_argument("--debounce", type=float, default=QUIET)
    c = sub.add_parser("search")
    c.add_argument("query")
    _matcher(c)
    for flag in ("--no-snippet", "--verbose", "--json", "--open"):
        c.add_argument(flag, action="store_true")
    c = sub.add_parser("serve")
    _matcher(c)
    c.add_argument("--snippet", action="store_true")
    for name in ("status", "doctor"):
        sub.add_parser(name).add_argument("--json", action="store_true")
    sub.add_parser("compact")
    c = sub.add_parser("lang")
    c.add_argument("what", choices=("list", "available", "add", "remove", "path"))
    c.add_argument("codes", nargs="*")
    c.add_argument("--filter")
    c.add_argument("--catalogue")
    c.add_argument("--source", default=".")
    c.add_argument("--yes", action="store_true")
    a = p.parse_args(argv)
    try:
        cfg = load(a.config)
        if a.command == "lang":
            return languages(a, local_session())
        try:
            store, problem = IndexStore.open(local_session(), a.db or cfg.default_db), None
        except IndexVersionError as e:
            if a.command != "doctor":
                raise
            store, problem = None, str(e)
        if a.command in ("index", "watch"):
            preflight(a.lang or cfg.languages, a.min_conf, None)
        if a.command == "index" and a.dry_run:
            print(json.dumps(I.dry_run(discover(store.spark, a.directory), store.read("files"), a.directory).first().asDict()))
        elif a.command == "index":
            print(json.dumps(index_directory(store, a.directory, lang=a.lang or cfg.languages, full=a.full_reindex, failed_log=a.failed_log)))
        elif a.command == "watch":
            for counts in watch(store, a.directory, a.debounce, lang=a.lang or cfg.languages):
                print(json.dumps(counts), flush=True)
        elif a.command == "search":
            state = _state(a, cfg, not a.no_snippet)
            hits = find(store, a.query, replace(state, limit=1) if a.open else state)
            lines = [r[0] for r in (S.as_json(hits) if a.json else S.as_tsv(hits, state.verbose)).collect()]
            if not lines:
                print(HINTS[state.matcher], file=sys.stderr if a.json else sys.stdout)
                return 1 if a.open else 0
            print("\n".join(lines))
            if a.open and shutil.which("xdg-open"):
                subprocess.run(["xdg-open", hits.first()["path"]], check=False)
        elif a.command == "serve":
            for line in serve(store, sys.stdin, _state(a, cfg, a.snippet)):
                print(line, flush=True)
        elif a.command in ("status", "doctor"):
            s = store.stats() if a.command == "status" else doctor(store, cfg, problem)
            print(json.dumps(s) if a.json else "\n".join(f"{k}: {v}" for k, v in s.items()))
        else:
            print(json.dumps(store.compact()))
    except (ConfigError, IndexVersionError, QuerySyntaxError, WatchError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
