"""Visually identical text with different characters.

``normal_form``  NFKC, full case folding, whitespace mapped, default-ignorable characters removed, look-alike letters
                 brought to one script per word: the form in which texts are compared as words.
``display_key``  the same, but everything that can be seen stays apart (case, accents, digits, punctuation, superscripts,
                 fractions, line breaks): two texts have equal keys iff they look the same when displayed.

Both work on Arrow batches, once per distinct value of a batch; pure ASCII values take a short cut.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import cut

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ё": "ë", "ї": "ï", "ѐ": "è", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ё": "Ë", "Ї": "Ï", "Ѐ": "È", "Ү": "Y",
    # Greek
    "ο": "o", "ν": "v", "ϳ": "j", "ι": "ı",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    # Latin letters and marks drawn alike
    "ɡ": "g", "ſ": "s", "ǃ": "!", "‐": "-", "‑": "-", "−": "-", "˗": "-", "ʹ": "'", "ʼ": "’", "׃": ":",
}

_IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


def _visible_compat(ch: str) -> bool:
    """True for characters whose compatibility form looks different: superscripts, fractions, circled forms, spacing
    accents, letter-like signs and the like. Width, ligature, Roman numeral and font variants look the same."""
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if kind in ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>"):
        return True
    if kind == "<compat>":
        full = unicodedata.normalize("NFKC", ch)
        return not (full.isalpha() and unicodedata.category(ch)[0] in "LN")
    return False


@lru_cache(None)
def _tables() -> tuple[dict, dict, dict, "re.Pattern", "re.Pattern"]:
    gone = {c: None for a, b in _IGNORABLE for c in range(a, b + 1)}
    spaces = {c: " " for c in (9, *(c for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs"))}
    base = gone | spaces
    alike = {ord(k): v for k, v in LOOKALIKES.items()}
    held, nxt = {}, 0xF0000  # private use stands in for what NFKC must not touch
    for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10800), *range(0x1D400, 0x1F300), *range(0x1FBF0, 0x1FC00)):
        if not unicodedata.decomposition(chr(c)).startswith("<") or c in spaces:
            continue
        if _visible_compat(chr(c)):
            held[c], nxt = chr(nxt), nxt + 1
    foreign = re.compile(f"[{''.join(k for k in LOOKALIKES if k.isalpha() and (ord(k) >= 0x370 or k == 'ɡ'))}]")
    latin = re.compile("[A-Za-zÀ-ɏ]")
    return base, alike, held, foreign, latin


@lru_cache(None)
def _finders() -> tuple["re.Pattern", "re.Pattern", "re.Pattern"]:
    """Searches that are far cheaper than a translation: characters to map or drop; characters NFKC must not touch or
    look-alikes; words in two scripts, Greek letters, or running Latin text next to which a look-alike may stand."""
    base, alike, held, _, _ = _tables()

    def one(keys) -> str:
        spans: list[list[int]] = []
        for c in sorted(keys):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        return "[" + "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in spans) + "]"

    mixed = re.compile("[A-Za-z\u00c0-\u024f][\u0400-\u052f]|[\u0400-\u052f][A-Za-z\u00c0-\u024f]|[\u0370-\u03ffɡſ]|[a-z]{2}")
    return re.compile(one(base)), re.compile(one(held)), mixed


@lru_cache(None)
def _punctuation() -> dict:
    return {ord(k): v for k, v in LOOKALIKES.items() if not k.isalpha()}


@lru_cache(None)
def _punctuation_finder() -> "re.Pattern":
    return re.compile("[" + "".join(re.escape(chr(k)) for k in _punctuation()) + "]")


def display_key(text: str | None) -> str | None:
    """Equal for texts that look the same. Null stays null, empty stays empty."""
    if text is None:
        return None
    base, alike, held, _, _ = _tables()
    if text.isascii():
        return text.replace("\t", " ")
    drop, visible, _ = _finders()
    out = text.translate(base) if drop.search(text) else text
    if not out.isascii():
        if not unicodedata.is_normalized("NFKC", out):
            out = unicodedata.normalize("NFKC", out.translate(held) if visible.search(out) else out)
            out = out.translate(base) if drop.search(out) else out
        out = unicodedata.normalize("NFC", out.translate(alike))
    return out


#: Covers every key of LOOKALIKES in a few ranges.
_MAY_DIFFER = re.compile("[\u01c3\u0261\u017f\u02b0-\u02ff\u0370-\u052f\u05c3\u2010-\u2012\u2212]")
_WORDISH = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
_CYRILLIC = re.compile("[\u0400-\u052f]")
_TO_CYRILLIC = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "y": "у", "x": "х", "A": "А", "B": "В", "E": "Е", "K": "К", "M": "М", "H": "Н", "O": "О", "P": "Р", "C": "С", "T": "Т", "X": "Х", "Y": "У", "ë": "ё", "Ë": "Ё"}


def one_script(text: str) -> str:
    """Look-alike letters resolved word by word: a word with letters that exist in one script only takes that script;
    a word of look-alikes alone takes the script of the word before it, or after it at the start."""
    if not _MAY_DIFFER.search(text):
        return text
    base, alike, _, foreign, latin = _tables()
    if not foreign.search(text) or not _finders()[2].search(text):
        return text if not _punctuation_finder().search(text) else text.translate(_punctuation())
    # letters of Cyrillic without a Latin twin decide for Cyrillic
    pieces, pending, last, at = [], [], None, 0
    to_cyr = str.maketrans(_TO_CYRILLIC)
    for m in _WORDISH.finditer(text):
        w = m.group()
        pieces.append(text[at : m.start()])
        at = m.end()
        if w.isascii():
            own = None if last == "c" and all(c in _TO_CYRILLIC for c in w) else "l"
        elif _CYRILLIC.search(plain := foreign.sub("", w)):
            own = "c"
        elif latin.search(plain) and not all(c in _TO_CYRILLIC for c in latin.findall(plain)):
            own = "l"
        else:
            own = None
        pieces.append(w)
        if own is None and last is None:
            pending.append(len(pieces) - 1)
            continue
        use = own or last
        for k in pending:
            pieces[k] = pieces[k].translate(to_cyr if use == "c" else alike)
        pending = []
        if not (w.isascii() and use == "l"):
            pieces[-1] = w.translate(to_cyr) if use == "c" else w.translate(alike)
        last = use
    for k in pending:
        pieces[k] = pieces[k].translate(alike)
    pieces.append(text[at:])
    return "".join(pieces)


def _mapped(text: str) -> str:
    """``text`` with characters mapped or dropped by the table of ``base``; they are few, and translating looks at all."""
    base, drop = _tables()[0], _finders()[0]
    found = set(drop.findall(text))
    if len(found) > 16:
        return text.translate(base)
    for c in found:
        text = text.replace(c, base[ord(c)] or "")
    return text


def readable_form(text: str | None) -> str | None:
    """The normal form before case folding."""
    if text is None:
        return None
    if text.isascii():
        return text.replace("\t", " ")
    out = _mapped(text)
    if not unicodedata.is_normalized("NFKC", out):
        out = _mapped(unicodedata.normalize("NFKC", out))
    return out if out.isascii() else unicodedata.normalize("NFC", one_script(out))


def normal_form(text: str | None) -> str | None:
    """NFKC, look-alikes, whitespace, default-ignorables and full case folding. Null stays null, empty stays empty."""
    out = readable_form(text)
    if out is None:
        return None
    return out.lower() if out.isascii() else unicodedata.normalize("NFC", out.casefold())


def _per_distinct(values: pd.Series, f) -> pd.Series:
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    out = pd.Series([f(v) for v in distinct], dtype=object)
    return pd.Series([None if c < 0 else out[c] for c in codes], dtype=object)


@F.pandas_udf(T.StringType())
def normal_form_col(values: pd.Series) -> pd.Series:
    return _per_distinct(values, normal_form)


@F.pandas_udf(T.BinaryType())
def display_key_digest(values: pd.Series) -> pd.Series:
    from hashlib import blake2b

    return _per_distinct(values, lambda v: blake2b(display_key(v).encode("utf-8", "surrogatepass"), digest_size=16).digest())


def normalized(docs: DataFrame, text: str = "content", to: str = "normal") -> DataFrame:
    """``docs`` with the normal form of column ``text`` added as ``to``."""
    return docs.withColumn(to, normal_form_col(F.col(text)))


def _looks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _look, _raw): digests of what is displayed and of the string, once for each different row; materialised, as it has
    several readers."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).filter(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    return cut(rows.select("_id", F.unhex(F.md5("_text")).alias("_raw"), display_key_digest("_text").alias("_look")).distinct())


def _classes(one: DataFrame) -> DataFrame:
    """(_look, _raw, _n): the different strings, with their number of keys, of every look that has several. Counted with
    map-side combine: a mass of copies is one row."""
    each = one.groupBy("_look", "_raw").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    several = one.groupBy("_look").agg(F.min("_raw").alias("_a"), F.max("_raw").alias("_b")).filter("_a <> _b").select("_look")
    return each.join(several, "_look", "left_semi")


def look_alike_pairs(docs: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """Pairs of keys whose texts look the same and aren't the same string, the smaller key first.

    Only (key, 16-byte digest of the display key, 16-byte digest of the text) is shuffled. Classes of equal strings are paired
    by their look, then each side is expanded to its keys: copies never meet each other, and n copies beside one
    differing text give n rows of work. Null texts never match; empty texts look like each other and like texts of invisible
    characters. Repeated rows count once.
    """
    one = _looks(docs, key, text)
    kinds = cut(_classes(one))
    other = kinds.select("_look", F.col("_raw").alias("_raw2"))
    pairs = kinds.select("_look", "_raw").join(other, "_look").filter("_raw < _raw2")
    members = one.join(kinds.select("_look", "_raw"), ["_look", "_raw"], "left_semi")
    left = pairs.join(members, ["_look", "_raw"]).select("_look", "_raw2", F.col("_id").alias("_x"))
    both = left.join(members.select("_look", F.col("_raw").alias("_raw2"), F.col("_id").alias("_y")), ["_look", "_raw2"]).filter("_x <> _y")
    return both.select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b")).distinct()


def look_alike_classes(docs: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, class_id, string_id, n_links): one row per key with a text.

    ``class_id`` is the least key whose text looks the same, ``string_id`` the least key with the same string, ``n_links`` the
    number of keys whose text looks the same and is another string. A key with several texts takes its first by string.
    """
    one = _looks(docs, key, text).groupBy("_id").agg(F.min(F.struct("_raw", "_look")).alias("_t")).select("_id", "_t._raw", "_t._look")
    one = cut(one)
    each = cut(one.groupBy("_look", "_raw").agg(F.count("*").alias("_n"), F.min("_id").alias("string_id")))
    look = each.groupBy("_look").agg(F.sum("_n").alias("_all"), F.min("string_id").alias("class_id"))
    told = each.join(look, "_look").select("_look", "_raw", "class_id", "string_id", (F.col("_all") - F.col("_n")).alias("n_links"))
    return one.join(told, ["_look", "_raw"]).select(F.col("_id").alias(key), "class_id", "string_id", "n_links")
