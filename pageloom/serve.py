"""Line protocol over a warm session: one block of hits, ended by a blank line, for every line that isn't blank."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from .operators import search as S
from .operators.query import QuerySyntaxError
from .sources.store import IndexStore


@dataclass(frozen=True)
class State:
    limit: int = 20
    matcher: str = "standard"  # or fuzzy, substring
    distance: int | None = None
    snippet: bool = False
    verbose: bool = False


def directive(state: State, start: State, line: str) -> State | None:
    """The state after ``:name value``; None where it can't be read, which changes nothing."""
    name, _, arg = line[1:].partition(" ")
    arg = arg.strip()
    on = {"on": True, "off": False}.get(arg)
    if name == "limit":
        return replace(state, limit=int(arg)) if arg.isdigit() and int(arg) > 0 else None
    if name == "snippet":
        return None if on is None else replace(state, snippet=on)
    if name == "fuzzy":
        if arg.isdigit() and int(arg) <= S.MOST_DISTANCE:
            return replace(state, matcher="fuzzy", distance=int(arg))
        return None if on is None else replace(state, matcher="fuzzy" if on else "standard", distance=start.distance)
    if name == "substring":
        return None if on is None else replace(state, matcher="substring" if on else "standard")
    return None


def find(store: IndexStore, raw: str, state: State):
    """The hits of a query in order, as a DataFrame of at most ``limit`` rows."""
    if state.matcher == "substring":
        hits = S.search_substring(store.corpus(), raw, state.limit)
    elif state.matcher == "fuzzy":
        hits = store.search_fuzzy(raw, state.limit, state.distance)
    else:
        hits = store.search(raw, state.limit)
    if state.snippet:
        hits = (S.with_snippet_substring if state.matcher == "substring" else S.with_snippet)(store.texts_of(hits), hits, raw)
    return hits.orderBy(*(["tier", "score", "file_id"] if "tier" in hits.columns else ["score", "file_id"]))


def run_query(store: IndexStore, raw: str, state: State) -> list[str]:
    return [r[0] for r in S.as_tsv(find(store, raw, state), state.verbose).collect()]


def serve(store: IndexStore, lines: Iterable[str], start: State = State()) -> Iterator[str]:
    """Output lines for input lines; ``:quit`` ends. Errors are said on a line of their own and leave the state alone."""
    state = start
    for line in lines:
        line = line.strip()
        if not line:
            continue
        if line == ":quit":
            return
        if line.startswith(":"):
            new = directive(state, start, line)
            if new is None:
                yield f"error: {line}"
            state = new or state
        else:
            try:
                yield from run_query(store, line, state)
            except QuerySyntaxError as e:
                yield f"error: {e}"
        yield ""
