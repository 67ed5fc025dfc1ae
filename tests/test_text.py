import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import porter
from pageloom.functions import text as X

SANITIZED = [
    ('"exact phrase"', '"exact phrase"'), ("C++ code", '"C++" code'), ("1*2 foo", '"1*2" foo'), ("foo (bar)", 'foo "(bar)"'), ("hello world", "hello world"), ('foo"bar', "foo bar"),
    ('"dangling phrase', "dangling phrase"), ("hello.world", '"hello.world"'), ("a=b", '"a=b"'), ("50% off", '"50%" off'), ("dana*", "dana*"), ("sviđ*", "sviđ*"), ("foo bar*", "foo bar*"),
    ("da*na*", '"da*na*"'), ("*", '"*"'), ("a.b*", '"a.b*"'),
]
DISTANCES = [
    ("invoice", "invoige", 2, 1), ("invoice", "invice", 2, 1), ("invoice", "invoicce", 2, 1), ("invoice", "invocie", 1, 1), ("invoice", "invoke", 1, None), ("invoice", "invoke", 2, 2), ("cat", "car", 0, None),
    ("a", "abcdefgh", 2, None), ("1nvo1ce", "invoice", 0, 0), ("INVOICE", "invoice", 0, 0), ("modem", "modern", 0, 0), ("dear", "clear", 0, 0), ("8alance", "balance", 0, 0), ("1nvo1re", "invoice", 1, 1), ("naslov", "nasloč", 1, 1),
]


@pytest.mark.parametrize(("raw", "want"), SANITIZED)
def test_sanitize(raw, want):
    assert X.sanitize(raw) == want


def test_sanitize_column(spark):
    df = spark.createDataFrame([(r,) for r, _ in SANITIZED], "q string").select("q", X.sanitize_col(F.col("q")).alias("s"))
    assert {r.q: r.s for r in df.collect()} == dict(SANITIZED)


@pytest.mark.parametrize(("a", "b", "most", "want"), DISTANCES)
def test_distance(a, b, most, want):
    assert X.distance_within(a, b, most) == want


def test_stem_distance():
    cases = [("invoice", "invoic", 0, 0), ("invoce", "invoic", 1, 1), ("invoices", "invoic", 0, 0), ("invoicing", "invoic", 0, None), ("invoicing", "invoic", 1, 1), ("invoice", "inv", 2, 2), ("invoice", "bal", 2, None)]
    assert all(X.stem_distance_within(q, s, m) == w for q, s, m, w in cases)
    assert [X.budget_py(n) for n in (0, 3, 4, 6, 7, 40)] == [0, 0, 1, 1, 2, 2]


def plain_osa(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 3))
def test_osa_against_plain(a, b, most):
    d = plain_osa(a, b)
    assert X.osa(a, b, most) == (d if d <= most else None)


def test_osa_column(spark):
    pairs = [("ca", "abc"), ("", "ab"), ("ab", ""), ("invoice", "invocie"), ("abcd", "badc"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.osa_col(F.col("a"), F.col("b")).alias("d"))
    assert all(r.d == plain_osa(r.a, r.b) for r in df.collect())


def test_stemmer_agrees_with_fts5(spark):
    words = sorted(set(re.findall("[a-z]+", "relational conditional valenci digitizer conformabli vileli analogousli operator feudalism hopefulness formaliti sensibiliti triplicate formalize electrical goodness "
        "revival allowance adjustable replacement adoption homologou angulariti effective bowdlerize probate rate cease controll roll ies eed sky caresses ponies ties cats feed agreed plastered bled motoring sing "
        "conflated troubled sized hopping tanned falling hissing fizzed failing filing happy oed ing ed invoices running is a")))  # fmt: skip
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, x) values(?, ?)", list(enumerate(words)))
    want = dict((words[d], t) for t, d in con.execute("select term, doc from v"))
    assert {w: porter.stem(w) for w in words} == want
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", porter.stem_col("w").alias("s"), porter.stem_words("w").alias("u")).collect()
    assert all(r.s == want[r.w] == r.u for r in got)


def test_folding_and_tokens(spark):
    text = "Čaša é İ đ ø ß ế foo_bar 1629.50 C++ é"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(X.tokens(F.col("t")).alias("k")).collect()
    assert got[0].k[:2] == ["casa", "e"] and got[0].k[3:] == ["đ", "ø", "ß", "ế", "foo", "bar", "1629", "50", "c", "e"]
    assert got[1].k is None and got[2].k == []
    assert X.tokens_py(text)[3:] == got[0].k[3:]


def test_small_functions(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first()[0]
    assert [v(X.luma(*[F.lit(x) for x in p])) for p in ((255, 255, 255), (0, 0, 0), (128, 128, 128), (255, 0, 0))] == [255, 0, 128, 76]
    assert [v(X.human_duration(F.lit(float(s)))) for s in (0, 45.4, 89, 90, 600, 3600, 5400, 7199)] == ["0s", "45s", "89s", "2m", "10m", "60m", "1h 30m", "2h"]
    assert v(X.union_words(F.lit("a B b"), F.lit("b C c d"))) == "a B b C d"
    assert v(X.iso8601(F.lit(0))) == "1970-01-01T00:00:00Z" and v(X.iso8601(F.lit(1778925600))) == "2026-05-16T10:00:00Z"
    assert [v(X.lang_spec_error(F.lit(s))) for s in ("eng", "eng+", "osd", "eng hrv")] == [None, "empty code", "detector, not a language", "bad code"]
    assert tuple(v(X.resize_target(F.lit(500), F.lit(300)))) == (1200, 720, "bicubic") and v(X.resize_target(F.lit(1500), F.lit(3))) is None
    assert v(X.second_arm_wanted(F.lit("one two three"))) and not v(X.second_arm_wanted(F.lit("one two three four")))
    assert v(X.estimate_band(F.lit(None).cast("int"))) == 0.6
    assert v(X.verified(F.lit(b"x"), F.lit(1), F.sha2(F.lit(b"x"), 256))) and not v(X.verified(F.lit(b"x"), F.lit(2), F.sha2(F.lit(b"x"), 256)))
