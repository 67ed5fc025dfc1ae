import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from pageloom.functions.text import sanitize
from pageloom.operators import search as S
from pageloom.operators.query import Op, Phrase, QuerySyntaxError, plan

WORDS = "invoice invoices total draft paid harbour harbors storm storms price prices bread running runs zagreb zagorje photo photos the of and".split()


@pytest.fixture(scope="module")
def texts():
    random.seed(4)
    out = [(k, " ".join(random.choice(WORDS) + random.choice(["", "", ".", ","]) for _ in range(random.randint(0, 40)))) for k in range(1, 60)]
    return [*out, (60, ""), (61, "Čaša vina, the İnvoice"), (62, "x" * 5000 + " invoice")]


@pytest.fixture(scope="module")
def fts(texts):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(file_id unindexed, content, tokenize='porter unicode61')")
    con.execute("create virtual table g using fts5(file_id unindexed, content, tokenize='trigram')")
    for k, t in texts:
        con.execute("insert into t(rowid, file_id, content) values(?, ?, ?)", (k, k, t))
        con.execute("insert into g(rowid, file_id, content) values(?, ?, ?)", (k, k, t))
    return con


@pytest.fixture(scope="module")
def rows(spark, texts):
    df = spark.createDataFrame([(k, t, "score", 7) for k, t in texts], "doc_id long, text string, term string, pos int")
    return S.corpus(df).cache()


QUERIES = ["invoice", "invoice total", "storm OR bread", "price NOT paid", '"price of"', "zag*", "zag", "(invoice OR storm) price", "price storm NOT bread total", 'x OR "invoice" NEAR(price storm, 3)', '^"the"', "invoice invoice",
           "invoice %", "casa", "hello.world OR price"]


@pytest.mark.parametrize("q", QUERIES)
def test_search_agrees_with_fts5(rows, fts, q):
    want = dict(fts.execute("select rowid, rank from t where t match ?", (sanitize(q),)).fetchall())
    got = {r.file_id: r.score for r in S.search_tree(rows, plan(q)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("q", ["nvo", "ce OF", "ill storm", "price", "ab"])
def test_substring_agrees_with_fts5(rows, fts, q):
    want = dict(fts.execute("select rowid, rank from g where g match ?", (sanitize(q),)).fetchall())
    got = {r.file_id: r.score for r in S.substring_tree(rows, q).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_snippets_agree_with_fts5(rows, fts):
    q = "price storm"
    hits = S.with_snippet(rows, S.search(rows, q, 10), q).collect()
    for h in hits:
        want = fts.execute("select snippet(t, 1, '[', ']', '...', 12) from t where t match ? and rowid = ?", (q, h.file_id)).fetchone()[0]
        assert h.snippet == " ".join(want.split())


def test_index_gives_the_same(rows):
    tree = plan('invoice "price of" OR zag*')
    a = {(r.file_id, round(r.score, 9)) for r in S.search_tree(rows, tree).collect()}
    b = {(r.file_id, round(r.score, 9)) for r in S.search_index(S.postings(rows), S.docstats(rows), tree).collect()}
    assert a == b and a


@pytest.mark.parametrize("q", ["", "  ", "invoice AND", "NOT invoice", '"x" OR (a'])
def test_syntax_errors(q):
    with pytest.raises(QuerySyntaxError):
        plan(q)


def test_precedence():
    a, b, c = (Phrase((x,)) for x in "abc")
    assert plan("a OR b AND c") == Op("or", (a, Op("and", (b, c))))
    assert plan("a NOT b c") == Op("not", (a, Op("and", (b, c))))
    assert plan("a NOT b AND c") == Op("and", (Op("not", (a, b)), c))


def test_fuzzy_tiers(spark):
    df = spark.createDataFrame([(1, "invoice total"), (2, "1nvo1ce"), (3, "grocery"), (4, None)], "doc_id long, text string")
    rows = S.corpus(df)
    assert [(r.tier, r.file_id) for r in S.search_fuzzy(rows, "invoice").orderBy("tier", "score").collect()] == [(0, 1), (1, 2)]
    assert [r.file_id for r in S.search_fuzzy(rows, "invoce").orderBy("tier", "file_id").collect()] == [1, 2]
    assert S.search_fuzzy(rows, '"invoce"').isEmpty() and S.search_fuzzy(rows, "invoce", most=0).isEmpty()


def test_empty_corpus(spark):
    rows = S.corpus(spark.createDataFrame([], "doc_id long, text string"))
    assert S.search(rows, "invoice").isEmpty() and S.search_substring(rows, "invoice").isEmpty()
    assert S.search_fuzzy(rows, "invoice").isEmpty() and S.vocabulary(rows).isEmpty()


def test_osa_distance_against_brute_force(spark):
    from pageloom.functions import text as X

    words = ["", "frame", "farme", "frmae", "ca", "abc", "1nvo1ce", "modern", "framework", "x" * 30]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = df.select("a", "b", X.osa_col(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == X.osa(r.a, r.b, 99) for r in got)
