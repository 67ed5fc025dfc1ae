"""Text functions as Column expressions, each with the same thing for the driver in Python where the query side needs it.

Fixed behaviour: tokens are runs of letters, numbers, private-use characters and, within a run, Latin combining marks; folding lower-cases and strips single diacritics but keeps
letters that only look decorated (đ ø ł ı ß) and letters with two marks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token, in a form that Java and RE2 read alike.
TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{0300}-\x{036F}]*"


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Lower-case letters whose decomposition is one letter and exactly one mark, and those letters."""
    src, dst = [], []
    for c in range(0xC0, 0x2000):
        ch = chr(c)
        if ch != ch.lower():
            continue
        d = unicodedata.normalize("NFD", ch)
        if len(d) == 2 and unicodedata.category(d[0]) == "Ll" and unicodedata.combining(d[1]):
            src.append(ch)
            dst.append(d[0])
    return "".join(src), "".join(dst)


def fold(text: Column) -> Column:
    """Lower case without single diacritics."""
    src, dst = fold_table()
    return F.regexp_replace(F.translate(F.lower(text), src, dst), r"[\x{0300}-\x{036F}]", "")


def fold_sql(x: str) -> str:
    src, dst = fold_table()
    return rf"regexp_replace(translate(lower({x}), '{src}', '{dst}'), '[\x{{0300}}-\x{{036F}}]', '', 'g')"


def fold_py(text: str) -> str:
    src, dst = fold_table()
    return "".join(c for c in text.lower().translate(str.maketrans(src, dst)) if not "\u0300" <= c <= "\u036f")


def tokens(text: Column) -> Column:
    """Folded tokens in order; null gives null."""
    return F.regexp_extract_all(fold(text), F.lit(rf"({TOKEN})"), F.lit(1))


def tokens_py(text: str) -> list[str]:
    return [fold_py(text[a:b]) for a, b in phrase_starts(text)]


def collapse_whitespace(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(F.regexp_replace(text, r"(?U)\s+", " "), " "), lambda w: w != ""))


# ------------------------------------------------------------------- query text

_BAREWORD = r"^[\p{L}\p{M}\p{N}]+\*?$"


def is_bareword(token: str) -> bool:
    """Letters and numbers only, with one star at the end at most."""
    body = token[:-1] if token.endswith("*") else token
    if token.endswith("*") and not body:
        return False
    return all(c.isalnum() or unicodedata.category(c)[0] == "M" for c in body)


def sanitize(raw: str) -> str:
    """The query as the search engine reads it: balanced quotes pass as they are; else tokens that aren't bare words are quoted."""
    if '"' in raw and raw.count('"') % 2 == 0:
        return raw
    return " ".join(t if is_bareword(t) else f'"{t}"' for t in raw.replace('"', " ").split())


def sanitize_col(raw: Column) -> Column:
    """``sanitize`` over a column of queries."""
    quotes = F.length(raw) - F.length(F.regexp_replace(raw, '"', ""))
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(raw, '"', " "), r"(?U)\s+", " "), " "), lambda t: t != "")
    quoted = F.transform(parts, lambda t: F.when(t.rlike(_BAREWORD), t).otherwise(F.concat(F.lit('"'), t, F.lit('"'))))
    return F.when((quotes > 0) & (quotes % 2 == 0), raw).otherwise(F.array_join(quoted, " "))


# ------------------------------------------------------------------- fuzzy text

#: Letters that scanners confuse, as read to one shape each (fixed values); pairs first, in this order.
SHAPE_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"))
SHAPE_FROM, SHAPE_TO = "1i|05826", "lllosbzg"


def shape(text: Column) -> Column:
    """The text with letters of similar shape written alike."""
    out = F.lower(text)
    for a, b in SHAPE_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, SHAPE_FROM, SHAPE_TO)


def shape_sql(x: str) -> str:
    out = f"lower({x})"
    for a, b in SHAPE_PAIRS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, '{SHAPE_FROM}', '{SHAPE_TO}')"


def shape_py(text: str) -> str:
    out = text.lower()
    for a, b in SHAPE_PAIRS:
        out = out.replace(a, b)
    return out.translate(str.maketrans(SHAPE_FROM, SHAPE_TO))


def budget(length: Column) -> Column:
    """Edits allowed for a word of this length."""
    return F.when(length <= 3, 0).when(length <= 6, 1).otherwise(2)


def budget_py(length: int) -> int:
    return 0 if length <= 3 else 1 if length <= 6 else 2


def osa(a: str, b: str, most: int) -> int | None:
    """Optimal string alignment distance if at most ``most``, else None."""
    if abs(len(a) - len(b)) > most:
        return None
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most and (not two or min(one) > most):
            return None
        two, one = one, now
    return one[-1] if one[-1] <= most else None


def distance_within(query: str, candidate: str, most: int) -> int | None:
    return osa(shape_py(query), shape_py(candidate), most)


def stem_distance_within(query: str, stem: str, most: int) -> int | None:
    """The least distance of the stem to the query with up to two letters cut from its end."""
    q, s = shape_py(query), shape_py(stem)
    found = [d for k in (0, 1, 2) if k == 0 or len(q) > k for d in (osa(q[: len(q) - k], s, most),) if d is not None]
    return min(found, default=None)


def osa_col(a: Column, b: Column) -> Column:
    """Optimal string alignment distance as a fold over arrays: stays in the JVM, for short words."""
    chars = F.split(b, "")
    n = F.length(b)
    start = F.struct(F.transform(F.sequence(F.lit(0), n), lambda x: F.lit(0)).alias("two"), F.sequence(F.lit(0), n).alias("one"), F.lit(0).alias("i"), F.lit("").alias("prev"))

    def row(state: Column, x: Column) -> Column:
        i = state["i"] + 1
        init = F.array(i)

        def cell(now: Column, j: Column) -> Column:
            y = F.element_at(chars, j)
            swap = (j > 1) & (i > 1) & (x == F.element_at(chars, F.greatest(j - 1, F.lit(1)))) & (state["prev"] == y)
            d = F.least(F.element_at(state["one"], j + 1) + 1, F.element_at(now, j) + 1, F.element_at(state["one"], j) + F.when(x == y, 0).otherwise(1))
            d = F.when(swap, F.least(d, F.element_at(state["two"], F.greatest(j - 1, F.lit(1))) + 1)).otherwise(d)
            return F.concat(now, F.array(d))

        now = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), init, cell)).otherwise(init)
        return F.struct(state["one"].alias("two"), now.alias("one"), i.alias("i"), x.alias("prev"))

    return F.when(F.length(a) > 0, F.aggregate(F.split(a, ""), start, row, lambda s: F.element_at(s["one"], n + 1))).otherwise(n)


# ------------------------------------------------------- numbers, dates, reports


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma with weights in 65536ths, rounded."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def resize_target(width: Column, height: Column) -> Column:
    """Struct (w, h, filter) an image is scaled to, null where it stays: 1200 wide if under 1000, 2400 if over 2400."""

    def to(w: int, kind: str) -> Column:
        return F.struct(F.lit(w).cast("long").alias("w"), F.greatest(F.lit(1).cast("long"), F.expr("1") * F.floor(height.cast("long") * w / width)).cast("long").alias("h"), F.lit(kind).alias("filter"))

    return F.when(width < 1000, to(1200, "bicubic")).when(width > 2400, to(2400, "lanczos"))


def human_duration(seconds: Column) -> Column:
    """``45s``, ``10m``, ``1h 30m``, ``2h``."""
    s = F.round(seconds).cast("long")
    minutes = F.round(seconds / 60).cast("long")
    h, m = F.floor(minutes / 60), minutes % 60
    return (
        F.when(seconds < 89.5, F.concat(s.cast("string"), F.lit("s")))
        .when(seconds < 5399.5, F.concat(minutes.cast("string"), F.lit("m")))
        .when(m == 0, F.concat(h.cast("string"), F.lit("h")))
        .otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
    )


def human_bytes(n: Column) -> Column:
    """``1.5 MB`` from a mebibyte on, else ``12 kB``."""
    return F.when(n >= 1 << 20, F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.0f", n / 1024), F.lit(" kB")))


def parallel_speedup(workers: Column) -> Column:
    return F.pow(F.greatest(workers, F.lit(1)).cast("double"), F.lit(0.58))


def estimated_seconds(images: Column, per_image: Column, workers: Column) -> Column:
    return images * per_image / parallel_speedup(workers)


def estimate_band(measured: Column) -> Column:
    """Relative half-width of an estimate from so many measured images; 0.6 without any."""
    return F.when(measured.isNull() | (measured == 0), F.lit(0.6)).otherwise(F.lit(0.30) + F.lit(0.7) / F.sqrt(measured.cast("double")))


def unix_seconds(micros: Column) -> Column:
    """Fractional seconds from microseconds, 0 before the epoch."""
    return F.greatest(F.lit(0.0), micros / 1e6)


def iso8601(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of Unix seconds, independent of the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = seconds.cast("long") - F.floor(seconds / 86400) * 86400
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), part(rest / 3600), F.lit(":"), part(rest % 3600 / 60), F.lit(":"), part(rest % 60), F.lit("Z"))


def parse_toggle(arg: Column) -> Column:
    return F.when(arg == "on", True).when(arg == "off", False)


# --------------------------------------------------------------- recognised text


def union_words(primary: Column, fallback: Column) -> Column:
    """The words of ``primary`` and, after them, those of ``fallback`` whose lower-case form hasn't been seen yet."""
    split = lambda t: F.filter(F.split(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " "), " "), lambda w: w != "")
    first, more = split(primary), split(fallback)
    seen = F.transform(first, lambda w: F.lower(w))
    lower = F.transform(more, lambda w: F.lower(w))
    fresh = F.filter(more, lambda w, i: ~F.array_contains(seen, F.lower(w)) & (F.array_position(lower, F.lower(w)) == i + 1))
    return F.array_join(F.concat(first, fresh), " ")


def second_arm_wanted(primary: Column, thorough: bool = True, trigger: int = 3) -> Column:
    """True where a second recognition pass is worth it: few words found."""
    return F.lit(thorough) & (word_count(primary) <= trigger)


def lang_spec_error(spec: Column) -> Column:
    """The first error of a language specification, null if there is none."""
    parts = F.transform(F.split(spec, r"\+"), lambda p: F.trim(p))
    kinds = F.transform(
        parts, lambda p: F.when(p == "", "empty code").when(F.lower(p) == "osd", "detector, not a language").when(~p.rlike("^[A-Za-z0-9_]+$"), "bad code")
    )
    return F.element_at(F.concat(F.filter(kinds, lambda k: k.isNotNull()), F.array(F.lit(None).cast("string"))), 1)


def pack_url(source: Column, tag: Column, code: Column) -> Column:
    return F.concat(F.replace(source, F.lit("github.com"), F.lit("raw.githubusercontent.com")), F.lit("/"), tag, F.lit("/"), code, F.lit(".traineddata"))


def verified(content: Column, size: Column, sha256: Column) -> Column:
    """True where bytes have the size and the hash they should have."""
    return (F.octet_length(content) == size) & (F.sha2(content, 256) == F.lower(sha256))


def phrase_starts(text: str) -> list[tuple[int, int]]:
    """(start, end) of every token of a text, in characters."""
    out, at = [], None
    for i, c in enumerate(text):
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Co" or ("\u0300" <= c <= "\u036f" and at is not None):
            at = i if at is None else at
        elif at is not None:
            out.append((at, i))
            at = None
    return [*out, (at, len(text))] if at is not None else out
