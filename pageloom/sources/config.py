"""Settings from a TOML file with typed defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass


class ConfigError(ValueError):
    """The file can't be used; the message names it."""


@dataclass(frozen=True)
class Config:
    default_db: str = "~/.pageloom/index"
    languages: str = "eng"
    workers: int = 0
    engine: str = "auto"
    min_word_conf: float = 40.0
    thorough: bool = False
    thorough_trigger_words: int = 3
    default_limit: int = 20


ENGINES = ("auto", "dll", "cli")


def expanduser(path: str) -> str:
    """A leading ``~``, ``~/`` or ``~\\`` as the home folder; other names after the sign stay."""
    if path == "~" or path[:2] in ("~/", "~\\"):
        return os.path.join(os.path.expanduser("~"), path[2:]) if len(path) > 2 else os.path.expanduser("~")
    return path


def validate_languages(spec: str) -> None:
    for part in spec.split("+"):
        p = part.strip()
        if not p:
            raise ConfigError(f"{spec!r}: empty language code")
        if p.lower() == "osd":
            raise ConfigError(f"{spec!r}: {p} is a detector, not a language")
        if not all(c.isascii() and (c.isalnum() or c == "_") for c in p):
            raise ConfigError(f"{spec!r}: bad language code {p!r}")


def load(path: str) -> Config:
    """Defaults where the file or a key is missing; unknown keys are ignored; wrong types, ranges and names are errors."""
    base = Config()
    if not os.path.exists(path):
        return base
    try:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    index, search = raw.get("index", {}), raw.get("search", {})

    def get(section: dict, name: str, kinds: tuple, least=None):
        v = section.get(name, getattr(base, name))
        if type(v) not in kinds or (least is not None and v < least):
            raise ConfigError(f"{path}: {name} = {v!r}")
        return v

    out = Config(
        expanduser(get(index, "default_db", (str,))), get(index, "languages", (str,)), get(index, "workers", (int,), 0), get(index, "engine", (str,)),
        float(get(index, "min_word_conf", (int, float), 0)), get(index, "thorough", (bool,)), get(index, "thorough_trigger_words", (int,), 0), get(search, "default_limit", (int,), 1),
    )
    if out.engine not in ENGINES or out.min_word_conf > 100:
        raise ConfigError(f"{path}: engine or min_word_conf out of range")
    try:
        validate_languages(out.languages)
    except ConfigError as e:
        raise ConfigError(f"{path}: {e}") from e
    return out
