"""What recognition needs on a machine: the engine's library, the folder of language packs, and the languages in it."""

from __future__ import annotations

import ctypes.util
import os
from dataclasses import dataclass

LIBRARY = "tesseract"
USER_PACKS = "~/.pageloom/tessdata"
SUFFIX = ".traineddata"


@dataclass(frozen=True)
class Attempt:
    candidate: str
    outcome: str  # NotFound, OpenFailed or Loaded


def attempts(explicit: str | None = None) -> list[Attempt]:
    """The places where the engine's library was looked for, in order, up to the first that loads. An explicit path (or the
    variable PAGELOOM_ENGINE) replaces the search."""
    explicit = explicit or os.environ.get("PAGELOOM_ENGINE")
    found = ctypes.util.find_library(LIBRARY)
    out = []
    for c in [explicit] if explicit else [*([found] if found else []), f"lib{LIBRARY}.so.5", f"lib{LIBRARY}.so"]:
        if os.path.isabs(c) and not os.path.exists(c):
            out.append(Attempt(c, "NotFound"))
            continue
        try:
            ctypes.CDLL(c)
        except OSError as e:
            out.append(Attempt(c, "NotFound" if "No such file" in str(e) else "OpenFailed"))
        else:
            return [*out, Attempt(c, "Loaded")]
    return out


def codes_in(folder: str) -> list[str]:
    """Languages of a folder of packs, sorted; none where it can't be read."""
    try:
        return sorted(n[: -len(SUFFIX)] for n in os.listdir(folder) if n.endswith(SUFFIX))
    except OSError:
        return []


def pack_folder() -> str | None:
    """TESSDATA_PREFIX as it is, else the user's folder if it holds a pack, else that of the installed engine."""
    prefix = os.environ.get("TESSDATA_PREFIX")
    if prefix:
        return prefix
    user = os.path.expanduser(USER_PACKS)
    shared = ["/usr/share/tesseract-ocr/5/tessdata", "/usr/share/tesseract-ocr/4.00/tessdata", "/usr/share/tessdata", "/usr/local/share/tessdata"]
    return next((d for d in [user, *shared] if codes_in(d)), None)


def shadowed(install: str) -> list[str]:
    """Languages of the active folder that would no longer be seen once packs are installed into ``install``."""
    active = pack_folder()
    return [] if not active or os.path.realpath(active) == os.path.realpath(install) else sorted(set(codes_in(active)) - set(codes_in(install)))


def is_offline(flag: bool = False) -> bool:
    return flag or os.environ.get("PAGELOOM_OFFLINE", "") not in ("", "0")


def first_missing(spec: str, installed: list[str]) -> str | None:
    return next((p.strip() for p in spec.split("+") if p.strip() not in installed), None)
