"""Per-document text quality statistics, and prose told from lists, tables and junk by them.

Every content gets a row of statistics (``STATS``). Per language, each statistic is kept in a mergeable quantile sketch: a
histogram over a fixed grid of ``GRID`` cells, exact to the width of a cell, whose counts simply add up over partitions.
Values become percentiles and robust z-scores against the median and the quartile distance of the language; contents in the
tails are flagged, and the kind follows from which statistics lie in a tail and on which side. ``Scale`` is the one
definition of prose: the other operators of this package that ask for prose use it with the sketches of the same texts.

To every sketch ``PRIOR_WEIGHT`` contents of plain prose (``PRIOR``) are added, and as many of all languages together, so that
a language of a few contents is judged by the others and an almost empty corpus by the prior, without a switch at any size.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .normalize import readable_form

#: Statistics and the upper end of their grids.
STATS = {
    "n_words": 4000.0, "mean_word_length": 16.0, "symbol_ratio": 1.0, "digit_ratio": 1.0, "line_end_punct": 1.0, "common_words": 1.0,
    "words_per_line": 40.0, "cell_lines": 1.0, "odd_words": 1.0, "marked_lines": 1.0, "title_lines": 1.0, "alpha_ratio": 1.0,
}
GRID = 512
NAMES = list(STATS)
#: Median and spread of each statistic over plain prose, and as how many contents they count.
PRIOR = {
    "n_words": (110, 60), "mean_word_length": (4.7, 0.3), "symbol_ratio": (0.0, 0.002), "digit_ratio": (0.025, 0.015), "line_end_punct": (0.65, 0.4), "common_words": (0.35, 0.06),
    "words_per_line": (22, 12), "cell_lines": (0.0, 0.002), "odd_words": (0.025, 0.025), "marked_lines": (0.0, 0.002), "title_lines": (0.7, 0.35), "alpha_ratio": (0.945, 0.02),
}
PRIOR_WEIGHT = 20
#: Robust z-score beyond which a value lies in a tail.
TAIL = 4.0
#: Fewest lines of a list, unless the whole content has fewer words than a sentence.
LIST_LINES, FEW_WORDS = 5, 5

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœаеёиоуыэюяАЕЁИОУЫЭЮЯ"
_VOWEL = re.compile(f"[{_VOWELS}]")
_CONSONANTS = re.compile(rf"[^{_VOWELS}\W\d_]{{4}}")
_ASCII = bytes(range(128))
#: ASCII characters as they are if letters or apostrophes, else as blanks; other characters that are no part of a word.
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() or chr(c) == "'" else 32 for c in range(256))
_NO_LETTER = re.compile(r"[^\x00-\x7f\w’]")
_MARK = re.compile(r"^\s*(?:[•·▪◦*–—-]\s|\d+\s*[x×]\s|\(?\d{1,3}[.)]\s|[a-z][.)]\s|\[[ xX]?\]\s|☐|□)")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
#: Numbers of cell borders of each sort in a table row; a comma counts where no space follows it.
_BORDERS = (
    lambda x: x.count("\t"), lambda x: x.count("|"), lambda x: x.count(";"),
    lambda x: len(_GAP.findall(x)) if "  " in x else 0, lambda x: x.count(",") - x.count(", "),
)
_END = tuple(".!?:…\"»”)")
#: Signs that prose hardly has, and lines that only draw.
_ODD_ASCII = b"#*+<=>@[\\]^_`{|}~"
_ODD_WIDE = re.compile(r"[^\x00-\x7f\w\s–—’“”„«»€£…•]")
_RULER = re.compile(r"^[\s\-+=|_*~#:]{3,}$")
_TICK = re.compile(r"^(?:\[[ xX]?\]|\*) ")
_LEADER = re.compile(r"\.{4,}")
#: Codes of goods, rooms and the like.
_CODE = re.compile(r"\b[A-Z]{1,4}-?\d[\d-]*\b")


def split_at(text: str, kept: bytes, other: re.Pattern, found: re.Pattern) -> list[str]:
    """What ``found`` finds, as runs of characters between others: ASCII ones that the table ``kept`` makes blanks, and those
    that ``other`` matches. A table and a split take a third of the time of a pattern."""
    raw = text.encode("utf-8", "surrogatepass")
    if not text.isascii():
        apart = set(other.findall(raw.translate(None, _ASCII).decode("utf-8", "surrogatepass")))
        if len(apart) > 32:  # replacing one after the other takes longer
            return found.findall(text)
        for c in apart:
            raw = raw.replace(c.encode("utf-8", "surrogatepass"), b" ")
    return raw.translate(kept).decode().split()


def words_of(text: str) -> list[str]:
    """What ``_WORD`` finds."""
    words = split_at(text, _LETTERS, _NO_LETTER, _WORD)
    if not "".join(words).isalpha():  # apostrophes, digits of other scripts
        words = [x for w in words for x in ((w,) if w.isalpha() else _WORD.findall(w))]
    return words


def _odd(word: str) -> bool:
    """True for a string of letters that no language here would write as a word: no vowel, four consonants in too short a
    word, a doubled consonant at the start, or capitals inside. One or two letters have to be a frequent word."""
    w = word.lower()
    if len(w) < 3:
        return w != "x"  # the sign of a count
    if not _VOWEL.search(w):
        return True
    if word[1:] != w[1:] and not word.isupper() and sum(c.isupper() for c in word[1:]) >= 2:
        return True
    return len(_CONSONANTS.findall(w)) * 8 >= len(w) or (w[0] == w[1] and w[0] not in _VOWELS)


class _Words(dict):
    """What is known of a word, kept per worker: the languages it is frequent in as bits, 0 for none, -1 for an odd one.
    Emptied when large."""

    def __init__(self, common: dict[str, frozenset]):
        self.codes = list(common)
        self.bits: dict[str, int] = {}
        for k, ws in enumerate(common.values()):
            for w in ws:
                if len(w) > 1:
                    self.bits[w] = self.bits.get(w, 0) | 1 << k

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        info = self[word] = self.bits.get(word.lower(), 0) or (-1 if _odd(word) else 0)
        return info


def _cells(lines: list[str]) -> float:
    """Share of the lines that have as many cells as most, three at least, with few words each."""
    best, all_lines = 0, "\n".join(lines)
    for borders in _BORDERS:
        if borders(all_lines) < 2:
            continue
        counts = Counter([n for x in lines if (n := borders(x)) >= 2 and x.count(" ") - x.count("  ") * 2 <= 3 * (n + 1) + 1])
        if counts:
            best = max(best, max(counts.values()))
    return best / max(1, len(lines))


def statistics(text: str, known: _Words, form: str | None = None) -> tuple[str, list[float]]:
    """Language by common words (``und`` without any) and the statistics, in the order of ``STATS``. ``form``: the readable
    form of the text, where the caller has it."""
    t = readable_form(text) if form is None else form
    # readable_form maps tabs to spaces; columns are told from the text as it is
    lines = [x for x in [y.strip(" \f\r") for y in text.split("\n")] if x and not x.isspace()]
    words = words_of(t)
    n = len(words)
    votes = Counter(map(known.__getitem__, words))
    plain, odd = votes.pop(0, 0), votes.pop(-1, 0)
    common = n - plain - odd
    if odd * 8 > n:
        odd = max(0, odd - len(_CODE.findall(t)))  # codes are no words, nor failed ones
    lang, best = "und", 0
    if votes:
        for k, code in enumerate(known.codes):
            have = sum([v for b, v in votes.items() if b >> k & 1])
            if have > best:
                lang, best = code, have
    raw = t.encode("utf-8", "replace")
    size = len(raw)
    solid = len(t) - (size - len(raw.translate(None, b" \n\t\r\f\v")))
    digits = size - len(raw.translate(None, b"0123456789"))
    signs = size - len(raw.translate(None, _ODD_ASCII)) + (0 if size == len(t) else len(_ODD_WIDE.findall(t)))
    if "...." in t:
        solid -= sum(map(len, _LEADER.findall(t)))  # dots that lead to a price or page
    letters = len("".join(words))
    ends = sum([x.endswith(_END) for x in lines])
    cells, marked = 0.0, 0
    rows = any([c in text for c in "\t|;"]) or text.count(",") > text.count(", ") or ("  " in text and _GAP.search(text))
    if signs or rows:
        drawn = [not x[0].isalnum() and _RULER.match(x) is not None for x in lines]
        body = lines
        if any(drawn):
            body = [x for x, d in zip(lines, drawn) if not d]
            signs -= sum([len(x) - x.count(" ") for x, d in zip(lines, drawn) if d])
        cells = _cells(body) if rows else 0.0
        signs -= sum([len(m.group()) - 1 for x in body if x[0] in "[*" and (m := _TICK.match(x))])
    m = max(1, len(lines))
    lower = [x for x in lines if not x[0].isupper()]
    title = len(lines) - len(lower)
    marked = sum([_MARK.match(x) is not None for x in lower])  # no mark begins with a capital
    return lang, [
        float(n), letters / max(1, n), max(0, signs) / max(1, solid), digits / max(1, solid), ends / m,
        common / max(1, n), n / m, cells, odd / max(1, n), marked / m, title / m, letters / max(1, solid),
    ]


def language_words(common_words: DataFrame) -> dict[str, frozenset]:
    """The list of frequent words by language. It is a reference list of fixed size, checked here."""
    rows = common_words.select("lang", "word").filter("lang is not null and word is not null").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the list of common words has more than 100,000 entries")
    out: dict[str, set] = {}
    for r in rows:
        out.setdefault(r[0], set()).add(r[1].lower())
    return {k: frozenset(v) for k, v in sorted(out.items())}


def with_statistics(docs: DataFrame, common_words: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, lang, stats array<float>) of every content that isn't null or blank; a key in several rows counts once."""
    common = language_words(common_words)

    def run(batches):
        known = _Words(common)
        for b in batches:
            ids, langs, stats = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None or i is None or not t.strip():
                    continue
                lang, s = statistics(t, known)
                ids.append(i)
                langs.append(lang)
                stats.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(langs, pa.string()), pa.array(stats, pa.list_(pa.float32()))], names=[key, "lang", "stats"])

    rows = docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, lang string, stats array<float>")
    return rows.dropDuplicates([key])


_TOPS = np.array(list(STATS.values()))


def _matrix(column) -> np.ndarray:
    """(rows, statistics) of an Arrow column of statistics."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(STATS))


def _cell(values: np.ndarray) -> np.ndarray:
    return np.minimum(GRID - 1, np.maximum(0, values / _TOPS * GRID)).astype(np.int64)


def sketches(stats: DataFrame) -> dict[str, np.ndarray]:
    """Per language, a (statistics, GRID) array of counts, from a table with columns lang and stats.

    Each task counts first; at most languages x statistics x GRID rows a task are shuffled and that many reach the driver.
    """

    def run(batches):
        own: dict[str, np.ndarray] = {}
        for b in batches:
            langs, cells = np.array(b.column(0).to_pylist(), dtype=object), _cell(_matrix(b.column(1)))
            for lang in set(langs):
                at = cells[langs == lang] + np.arange(len(STATS)) * GRID
                own[lang] = own.get(lang, 0) + np.bincount(at.ravel(), minlength=len(STATS) * GRID)
        for lang, counts in own.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "at", "n"])

    rows = stats.select("lang", "stats").mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(len(STATS) * GRID))[r["at"]] += r["n"]
    return {k: v.reshape(len(STATS), GRID) for k, v in out.items()}


def _prior() -> np.ndarray:
    """A sketch of ``PRIOR_WEIGHT`` contents of plain prose."""
    steps = np.linspace(-2.5, 2.5, 51)
    share = np.exp(-steps * steps / 2)
    out = np.zeros((len(STATS), GRID))
    for k, (mid, dev) in enumerate(PRIOR.values()):
        np.add.at(out[k], _cell(np.clip(np.repeat((mid + steps * dev)[:, None], len(STATS), 1), 0, None))[:, k], share / share.sum() * PRIOR_WEIGHT)
    return out


def quantile(sketch: np.ndarray, q: float) -> np.ndarray:
    """The q-quantile of each statistic of a sketch, as the middle of a cell."""
    c = np.cumsum(sketch, axis=1)
    at = (c < q * c[:, -1:]).sum(axis=1)
    return (np.minimum(at, GRID - 1) + 0.5) / GRID * _TOPS


class Scale:
    """Percentiles, robust z-scores and kinds of contents against the sketches of their languages."""

    def __init__(self, sk: dict[str, np.ndarray]):
        spoken = [v for k, v in sk.items() if k != "und"]
        pooled = _prior() + (sum(spoken) if spoken else 0)
        share = pooled / pooled[0].sum() * PRIOR_WEIGHT
        least = np.maximum(_TOPS / GRID * 2, np.array([dev for _, dev in PRIOR.values()]) / 2)
        self.below, self.middle, self.dev = {}, {}, {}
        # contents without a language are held against all languages together
        for k, v in [*((k, share + v) for k, v in sk.items() if k != "und"), ("*", pooled)]:
            self.below[k] = (np.cumsum(v, axis=1) - v / 2) / v.sum(axis=1, keepdims=True)
            self.middle[k] = quantile(v, 0.5)
            self.dev[k] = np.maximum((quantile(v, 0.75) - quantile(v, 0.25)) / 1.349, least)

    def _rows(self, table: dict, langs) -> np.ndarray:
        return np.stack([table.get(x, table["*"]) for x in langs]) if len(langs) else np.zeros((0, len(STATS)))

    def z(self, langs, stats: np.ndarray) -> np.ndarray:
        return (stats - self._rows(self.middle, langs)) / self._rows(self.dev, langs)

    def percentiles(self, langs, stats: np.ndarray) -> np.ndarray:
        """Share of the language's contents below each value, by the grid."""
        cells, at = _cell(stats), np.arange(len(STATS))
        return np.stack([self.below.get(x, self.below["*"])[at, c] for x, c in zip(langs, cells)]) if len(langs) else np.zeros((0, len(STATS)))

    def kinds(self, langs, stats: np.ndarray) -> np.ndarray:
        """prose, list, table or junk of each content.

        Frequent words in the lower tail say that a content isn't running text. Then rows of cells in the upper tail make a
        table; odd words or signs far in the upper tail, or letters far in the lower one, make junk; lines that are short for
        the language and end without a sign make a list, also where frequent words are only near the tail if the lines are
        marked or begin with capitals.
        """
        z = dict(zip(NAMES, self.z(langs, stats).T))
        pct = dict(zip(NAMES, self.percentiles(langs, stats).T))
        s = dict(zip(NAMES, stats.T))
        short = (pct["words_per_line"] < 0.35) & (pct["line_end_punct"] < 0.2)
        lines, scrap = s["n_words"] >= LIST_LINES * s["words_per_line"], s["n_words"] < FEW_WORDS
        rare, few, fewer = (z["common_words"] < -x for x in (1.5 * TAIL, 3, 2))
        table = (z["cell_lines"] > 25 * TAIL) & (z["symbol_ratio"] < 20 * TAIL)
        unread = (z["odd_words"] > 3.5 * TAIL) | (z["symbol_ratio"] > 8 * TAIL) | (z["alpha_ratio"] < -9 * TAIL)
        marked = (z["marked_lines"] > 25 * TAIL) | (z["title_lines"] > 0)
        out = np.full(len(stats), "prose", dtype=object)
        out[short & (lines & (rare | (fewer & marked)) | scrap & few)] = "list"
        out[fewer & unread] = "junk"
        out[few & table] = "table"
        return out


def with_kinds(stats: DataFrame, scale: Scale, extra: bool = False) -> DataFrame:
    """``stats`` with column kind, and with ``extra`` also z and percentiles (array<double>)."""
    more = [("kind", pa.string(), "string")] + [(n, pa.list_(pa.float64()), "array<double>") for n in ("z", "percentiles") if extra]
    fields = ", ".join([*(f"`{n}` {k}" for n, k in stats.dtypes), *(f"{n} {k}" for n, _, k in more)])
    names = [*stats.columns, *(n for n, _, _ in more)]

    def run(batches):
        for b in batches:
            langs, s = b.column(b.schema.get_field_index("lang")).to_pylist(), _matrix(b.column(b.schema.get_field_index("stats")))
            add = [pa.array(scale.kinds(langs, s), pa.string())]
            if extra:
                add += [pa.array(list(x), pa.list_(pa.float64())) for x in (scale.z(langs, s), scale.percentiles(langs, s))]
            yield pa.RecordBatch.from_arrays([*b.columns, *add], names=names)

    return stats.mapInArrow(run, fields)


def not_prose(docs: DataFrame, common_words: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, kind) of every content that is a list, a table or junk. Null, empty and blank contents have no row."""
    stats = cut(with_statistics(docs, common_words, key, text))
    return with_kinds(stats, Scale(sketches(stats))).filter("kind <> 'prose'").select(key, "kind")


def statistics_table(docs: DataFrame, common_words: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """One row per content: language, kind, every statistic with its z-score and percentile in the language, and the flag of
    a tail (any |z| above ``TAIL``)."""
    stats = cut(with_statistics(docs, common_words, key, text))
    k = with_kinds(stats, Scale(sketches(stats)), extra=True)
    cols = [F.col(c)[i].cast("double").alias(p + n) for c, p in (("stats", ""), ("z", "z_"), ("percentiles", "pct_")) for i, n in enumerate(NAMES)]
    return k.select(key, "lang", *cols, "kind", F.exists("z", lambda x: F.abs(x) > TAIL).alias("tail"))
