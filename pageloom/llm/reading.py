"""Reading level of each document: regularised ordinal regression over features of its words and sentences.

Features: lexical diversity in windows, word rarity against the whole corpus (exact counts of the words that at least one text
in a thousand has; all others are equally rare), connectives, a proxy of clause depth, and lengths of words and sentences. A proportional-odds model with ridge penalty is fitted to the
documents graded by hand; annotators who err or disagree enter as they graded, each with an equal share of the document.
Documents that aren't running English text have no level.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .normalize import readable_form
from .quality import Scale, _Words, language_words, sketches, statistics, with_kinds
from .sketch import Counts, frequent, signed_key, word_counts

LEVELS = ("easy", "middle", "hard")
#: Graded documents the model is fitted to, at most; which, is decided by a hash of the key.
GRADED = 4000
FEATURES = ("diversity", "rarity", "rare_share", "connectives", "clause_depth", "word_length", "long_words", "sentence_length", "syllables", "nominal")
#: Fewest words of a document with a level.
LEAST_WORDS = 12
#: Share of the texts from which on a word's rarity is told apart; it bounds the table of words at any size of the corpus.
RAREST = 0.001

_WORD = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)")
_VOWELS = re.compile(r"[aeiouy]+")
# Words that join clauses.
CONNECTIVES = frozenset(
    "although because unless whereas while whilst since though therefore however moreover furthermore nevertheless nonetheless consequently hence thus notwithstanding provided "
    "insofar inasmuch irrespective albeit whereby wherein thereby which whose whom that if when where until before after so but or and then".split()
)
_DEEP = frozenset("although because unless whereas while whilst since though which whose whom that whereby wherein notwithstanding irrespective insofar inasmuch albeit if when where until".split())
_NOMINAL = re.compile(r"(?:tion|sion|ment|ness|ity|ance|ence|ism|isation|ization|ology|ivity|ability)s?$")


def _tokens(text: str) -> set[str]:
    """The words of a text, and the empty word, whose count is that of the texts."""
    return {w.lower() for w in _WORD.findall(text)} | {""}


class Features:
    """Feature row of one text, by the number of documents a frequent word is in."""

    def __init__(self, counts: Counts, total: int):
        self.counts, self.total = counts, max(1, total)
        self.kept: dict[str, tuple] = {}

    def word(self, w: str) -> tuple:
        x = self.kept.get(w)
        if x is None:
            if len(self.kept) > 500_000:
                self.kept.clear()
            low = w.lower()
            r = min(-np.log10(RAREST), -np.log10((self.counts.get(low) + 0.5) / self.total))
            x = self.kept[w] = (low, r, low in CONNECTIVES, low in _DEEP, len(w), len(_VOWELS.findall(low)), _NOMINAL.search(low) is not None and len(low) > 6)
        return x

    def of(self, text: str) -> list[float]:
        words = [self.word(w) for w in _WORD.findall(text)]
        n = len(words)
        low = [w[0] for w in words]
        step = 50
        windows = [low[i : i + step] for i in range(0, max(1, n - step + 1), step)]
        div = sum(len(set(w)) / (len(w) ** 0.9) for w in windows) / len(windows)
        sentences = max(1, len(_SENTENCE.findall(text)))
        deep = sum([w[3] for w in words]) + text.count(",") * 0.5 + text.count(";")
        lengths = [w[4] for w in words]
        return [
            div, sum([w[1] for w in words]) / n, sum([w[1] > 2.0 for w in words]) / n, sum([w[2] for w in words]) / n, deep / sentences,
            sum(lengths) / n, sum([x >= 9 for x in lengths]) / n, min(80.0, n / sentences), sum([w[5] for w in words]) / n, sum([w[6] for w in words]) / n,
        ]


def english(text: str, lang: str, n: float, known: _Words) -> bool:
    """True for a text whose frequent words are English, by its language and number of words; not yet whether it is prose."""
    if lang != "eng" or n < LEAST_WORDS:
        return False
    at = known.codes.index("eng")
    bits = [known[w] for w in _WORD.findall(text)]
    if len(bits) < 0.85 * n or not text.isascii() and sum([c > "\u024f" and c.isalpha() for c in text]) > 0.05 * len(text):
        return False  # other scripts between
    own, other = sum([b > 0 and b >> at & 1 for b in bits]), sum([b > 0 and not b >> at & 1 for b in bits])
    # code, logs and screens have signs where prose has words
    signs = sum(text.count(c) for c in "{}[]|=$#<>_\\") / max(1, len(text))
    return own >= 0.15 * len(bits) and other <= 0.25 * own and signs < 0.01


class Ordinal:
    """Proportional-odds regression: P(level <= k) = sigmoid(cut_k - w x), ridge on w."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 3000):
        self.mean, self.dev = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - self.mean) / self.dev
        k = len(LEVELS) - 1
        w, first, gaps = np.zeros(z.shape[1]), -1.0, np.zeros(k - 1)
        m = [np.zeros(len(w) + k), np.zeros(len(w) + k)]
        weight = weight / weight.sum()
        for t in range(1, rounds + 1):
            cuts = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
            s = z @ w
            p = 1 / (1 + np.exp(-(np.concatenate([cuts, [np.inf]])[y] - s)))
            q = np.where(y > 0, 1 / (1 + np.exp(-(cuts[np.maximum(y - 1, 0)] - s))), 0.0)
            like = np.maximum(p - q, 1e-9)
            dp, dq = p * (1 - p), q * (1 - q)
            ds = weight * (dp - dq) / like  # d loss / d s
            gw = z.T @ ds + ridge * w
            gc = np.array([-(weight * dp / like)[y == j].sum() + (weight * dq / like)[y == j + 1].sum() for j in range(k)])
            g = np.concatenate([gw, [gc.sum()], [gc[j + 1 :].sum() * np.exp(gaps[j]) for j in range(k - 1)]])
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            d = 0.02 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-9)
            w, first, gaps = w - d[: len(w)], first - d[len(w)], gaps - d[len(w) + 1 :]
        self.w, self.cuts = w, np.concatenate([[first], first + np.cumsum(np.exp(gaps))])

    def proba(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.dev) @ self.w
        upto = np.stack([1 / (1 + np.exp(-(c - s))) for c in self.cuts] + [np.ones(len(s))], 1)
        return np.diff(np.concatenate([np.zeros((len(s), 1)), upto], 1), axis=1)


def feature_table(docs: DataFrame, common_words: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, x array<double>) of every document of running English. Null and empty texts have no row.

    Running means prose by the quality statistics, with the sketches of these very documents.
    """
    common = language_words(common_words)
    words = cut(word_counts(docs, text, _tokens))
    total = (words.filter(F.col("key") == signed_key("")).select("n0").first() or [0])[0]
    shared = docs.sparkSession.sparkContext.broadcast(frequent(words, "n0", total, RAREST))

    def run(batches):
        known, f = _Words(common), Features(shared.value, total)
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not t or t.isspace():
                    continue
                form = readable_form(t)
                lang, s = statistics(t, known, form)
                out.append((i, lang, s, f.of(form) if english(form, lang, s[0], known) else None))
            cols = list(zip(*out)) if out else [[]] * 4
            types = [b.schema.field(0).type, pa.string(), pa.list_(pa.float32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=[key, "lang", "stats", "x"])

    rows = cut(docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, lang string, stats array<float>, x array<double>").dropDuplicates([key]))
    return with_kinds(rows, Scale(sketches(rows))).filter("kind = 'prose' and x is not null").select(key, "x")


def levels(docs: DataFrame, graded: DataFrame, common_words: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, level, p_easy, p_middle, p_hard, score) of every document of running English.

    Without any graded document of running English there are no rows. ``score`` is the place on the scale of difficulty.
    """
    x = feature_table(docs, common_words, text, key)
    grades = graded.filter(F.col("level").isin(*LEVELS)).select(key, "level").join(x, key)
    few = grades.withColumn("_h", F.xxhash64(key)).orderBy("_h", key, "level").limit(GRADED).select(key, "level", "x").collect()
    schema = f"{key} {dict(docs.dtypes)[key]}, level string, p_easy double, p_middle double, p_hard double, score double"
    if not few:
        return docs.sparkSession.createDataFrame([], schema)
    y = np.array([LEVELS.index(r["level"]) for r in few])
    each = pd.Series([r[0] for r in few])
    model = Ordinal(np.array([r["x"] for r in few]), y, (1 / each.map(each.value_counts())).to_numpy())

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            m = np.stack(f["x"].to_list())
            p = model.proba(m)
            yield pd.DataFrame({key: f[key], "level": np.array(LEVELS)[p.argmax(1)], "p_easy": p[:, 0], "p_middle": p[:, 1], "p_hard": p[:, 2], "score": ((m - model.mean) / model.dev) @ model.w})

    return x.mapInPandas(run, schema)
