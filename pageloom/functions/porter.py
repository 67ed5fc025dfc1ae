"""The Porter stemmer as one table of rules with three readings: Python, Spark SQL and DuckDB SQL.

A consonant y is written Y while the rules run, so that the classes of vowels and consonants are plain character classes
and every condition on the stem is a regular expression that all three engines understand.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

V, C = "[aeiouy]", "[^aeiouy]"
#: Conditions on the part before the suffix.
M0, M1 = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}+{C}"
VOWEL = V
ION = f"^{C}*{V}+{C}+{V}+{C}.*[st]$|^{C}*{V}+{C}+{V}+[st]$|^{C}*{V}+{C}+{V}+{C}*[st]$"
ANY = "."

# The published rules, (suffix, condition, replacement), the longest suffix of a step decides.
STEP1A = (("sses", ANY, "ss"), ("ies", ANY, "i"), ("ss", ANY, "ss"), ("s", ANY, ""))
STEP2 = (
    ("ational", M0, "ate"), ("ization", M0, "ize"), ("fulness", M0, "ful"), ("iveness", M0, "ive"), ("ousness", M0, "ous"), ("tional", M0, "tion"), ("biliti", M0, "ble"),
    ("entli", M0, "ent"), ("ousli", M0, "ous"), ("ation", M0, "ate"), ("alism", M0, "al"), ("aliti", M0, "al"), ("iviti", M0, "ive"), ("enci", M0, "ence"), ("anci", M0, "ance"),
    ("izer", M0, "ize"), ("alli", M0, "al"), ("ator", M0, "ate"), ("logi", M0, "log"), ("bli", M0, "ble"), ("eli", M0, "e"),
)
STEP3 = (("icate", M0, "ic"), ("ative", M0, ""), ("alize", M0, "al"), ("iciti", M0, "ic"), ("ical", M0, "ic"), ("ness", M0, ""), ("ful", M0, ""))
STEP4 = (
    ("ement", M1, ""), ("ance", M1, ""), ("ence", M1, ""), ("able", M1, ""), ("ible", M1, ""), ("ment", M1, ""), ("ant", M1, ""), ("ent", M1, ""), ("ion", ION, ""), ("ism", M1, ""),
    ("ate", M1, ""), ("iti", M1, ""), ("ous", M1, ""), ("ive", M1, ""), ("ize", M1, ""), ("al", M1, ""), ("er", M1, ""), ("ic", M1, ""), ("ou", M1, ""),
)
DOUBLE = "([bcdfghjkmnpqrtvwxY])\\1$"
CVC = f"^{C}+{V}[^aeiouywxY]$"


def _case(rules, w: str, like: str) -> str:
    """A CASE over the suffixes; ``like`` is the engine's name for a regular-expression test."""
    out = []
    for suffix, cond, new in rules:
        k = len(suffix)
        stem = f"left({w}, length({w}) - {k})"
        done = f"concat({stem}, '{new}')"
        then = done if cond == ANY else f"CASE WHEN {like}({stem}, '{cond}') THEN {done} ELSE {w} END"
        out.append(f"WHEN length({w}) > {k} AND right({w}, {k}) = '{suffix}' THEN {then}")
    return f"CASE {' '.join(out)} ELSE {w} END"


def sql_steps(word: str, like: str) -> list[tuple[str, str]]:
    """(column, expression) in order; each reads the columns before it, the last is the stem."""
    sub = "regexp_replace({0}, '{1}', '{2}'{3})"
    g = ", 'g'" if like == "regexp_matches" else ""
    b = "$1" if like == "rlike" else "\\1"
    steps = [("w0", sub.format(sub.format(word, "^y", "Y", ""), "([aeiou])y", b + "Y", g))]
    steps.append(("w1", _case(STEP1A, "w0", like)))
    eed = f"length(w1) > 3 AND right(w1, 3) = 'eed'"
    ed = f"right(w1, 2) = 'ed' AND length(w1) > 2 AND {like}(left(w1, length(w1) - 2), '{VOWEL}')"
    ing = f"right(w1, 3) = 'ing' AND length(w1) > 3 AND {like}(left(w1, length(w1) - 3), '{VOWEL}')"
    steps.append(("cut", f"CASE WHEN {eed} THEN NULL WHEN {ed} THEN left(w1, length(w1) - 2) WHEN {ing} THEN left(w1, length(w1) - 3) END"))
    dbl = " OR ".join(f"right(cut, 2) = '{c}{c}'" for c in "bcdfghjkmnpqrtvwxY")
    m1_only = f"{like}(cut, '^{C}*{V}+{C}+$') AND {like}(cut, '{C}{V}[^aeiouywxY]$')"
    steps.append(
        (
            "w2",
            f"CASE WHEN {eed} THEN CASE WHEN {like}(left(w1, length(w1) - 3), '{M0}') THEN left(w1, length(w1) - 1) ELSE w1 END"
            f" WHEN cut IS NULL THEN w1"
            f" WHEN right(cut, 2) IN ('at', 'bl', 'iz') THEN concat(cut, 'e')"
            f" WHEN {dbl} THEN left(cut, length(cut) - 1)"
            f" WHEN {m1_only} THEN concat(cut, 'e') ELSE cut END",
        )
    )
    steps.append(("w3", f"CASE WHEN lower(right(w2, 1)) = 'y' AND length(w2) > 1 AND {like}(left(w2, length(w2) - 1), '{VOWEL}') THEN concat(left(w2, length(w2) - 1), 'i') ELSE w2 END"))
    steps.append(("w4", _case(STEP2, "w3", like)))
    steps.append(("w5", _case(STEP3, "w4", like)))
    steps.append(("w6", _case(STEP4, "w5", like)))
    stem = "left(w6, length(w6) - 1)"
    e = f"right(w6, 1) = 'e' AND length(w6) > 1 AND ({like}({stem}, '{M1}') OR ({like}({stem}, '{M0}') AND NOT ({like}({stem}, '^{C}*{V}+{C}+$') AND {like}({stem}, '{C}{V}[^aeiouywxY]$'))))"
    steps.append(("w7", f"CASE WHEN {e} THEN {stem} ELSE w6 END"))
    steps.append(("w8", f"CASE WHEN right(w7, 2) = 'll' AND {like}(left(w7, length(w7) - 1), '{M1}') THEN left(w7, length(w7) - 1) ELSE w7 END"))
    short = f"octet_length({word}) < 3" if like == "rlike" else f"strlen({word}) < 3"
    steps.append(("stem", f"CASE WHEN {short} THEN {word} ELSE lower(w8) END"))
    return steps


def stem_col(word: str):
    """The stem of a lower-case word column as one Column; null gives null.

    The steps are nested lambdas over a one-element array: each value is bound once, so that the expression stays small
    wherever the optimizer moves it (as plain columns, a pushed-down filter would copy every step into the next).
    """
    steps = sql_steps(f"`{word}`", "rlike")
    e, var = f"array({steps[0][1]})", "w0"
    for name, expr in steps[1:]:
        if name == "cut":
            e, var = f"transform({e}, w1 -> named_struct('w1', w1, 'cut', {expr}))", "s"
        elif name == "w2":
            e, var = f"transform({e}, s -> {re.sub(r'(?<![\w.])(w1|cut)(?!\w)', r's.\1', expr)})", "w2"
        else:
            e, var = f"transform({e}, {var} -> {expr})", name
    return F.expr(f"element_at({e}, 1)")


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    """Stems of a batch of words, each distinct word once."""
    codes, distinct = pd.factorize(words)
    stems = pd.Series([stem(w) for w in distinct] + [None], dtype=object)
    return pd.Series(stems.to_numpy()[codes], dtype=object)


def with_stem(words: DataFrame, word: str, to: str = "stem") -> DataFrame:
    """Adds the stem of a lower-case word column. Meant for distinct words, or the few that a query leaves.

    The batch form of the same rules: as one native expression (``stem_col``) they take the optimizer seconds a query.
    """
    return words.withColumn(to, stem_words(F.col(word)))


def duckdb_ctes(source: str, word: str, keep: str = "") -> str:
    """CTE text ``stemmed(word, stem)`` over the distinct words of CTE ``source``."""
    prev, out = source, []
    for k, (name, expr) in enumerate(sql_steps(word, "regexp_matches")):
        out.append(f"st{k} AS (SELECT *, {expr} AS {name} FROM {prev})")
        prev = f"st{k}"
    return ",\n".join(out) + f",\nstemmed AS (SELECT {word}, stem FROM {prev})"


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word.encode()) < 3:
        return word
    w = re.sub(r"([aeiou])y", r"\1Y", re.sub("^y", "Y", word))

    def rules(w, table):
        for suffix, cond, new in table:
            if len(w) > len(suffix) and w.endswith(suffix):
                s = w[: -len(suffix)]
                return s + new if re.search(cond, s) else w
        return w

    def measure_one_cvc(s):
        return re.search(f"^{C}*{V}+{C}+$", s) and re.search(f"{C}{V}[^aeiouywxY]$", s)

    w = rules(w, STEP1A)
    if len(w) > 3 and w.endswith("eed"):
        w = w[:-1] if re.search(M0, w[:-3]) else w
    else:
        cut = None
        if len(w) > 2 and w.endswith("ed") and re.search(V, w[:-2]):
            cut = w[:-2]
        elif len(w) > 3 and w.endswith("ing") and re.search(V, w[:-3]):
            cut = w[:-3]
        if cut is not None:
            if cut[-2:] in ("at", "bl", "iz"):
                w = cut + "e"
            elif re.search(DOUBLE, cut):
                w = cut[:-1]
            elif measure_one_cvc(cut):
                w = cut + "e"
            else:
                w = cut
    if len(w) > 1 and w[-1] in "yY" and re.search(V, w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3, STEP4):
        w = rules(w, table)
    s = w[:-1]
    if len(w) > 1 and w[-1] == "e" and (re.search(M1, s) or (re.search(M0, s) and not measure_one_cvc(s))):
        w = s
    if w.endswith("ll") and re.search(M1, w[:-1]):
        w = w[:-1]
    return w.lower()
