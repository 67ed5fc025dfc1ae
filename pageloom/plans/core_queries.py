"""The core operators as registered queries: each over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import porter
from ..functions import text as X
from ..operators import index as I
from ..operators import search as S
from ..operators.incremental import instant, is_image
from ..streaming import batcher
from . import reference_sql as R
from .runtime import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus(spread(table(spark, d, "documents")))


def _hits(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- vocabulary

@query(f"WITH {R.TOK} SELECT token AS term, count(DISTINCT file_id) AS doc, count(*) AS cnt FROM tok GROUP BY 1")
def vocab_terms(spark, d):
    return S.vocabulary(_docs(spark, d))


@query(f"WITH {R.STEMS} SELECT term, count(DISTINCT file_id) AS doc, count(*) AS cnt FROM st GROUP BY 1")
def vocab_stemmed(spark, d):
    return S.vocabulary(_docs(spark, d), stemmed=True)


@query(f"WITH {R.TOK} SELECT token AS term, count(DISTINCT file_id) AS doc, count(*) AS cnt FROM tok WHERE length(token) BETWEEN 3 AND 9 GROUP BY 1")
def vocab_length_window(spark, d):
    return S.length_window(S.vocabulary(_docs(spark, d)), "invoice", 2)


@query(f"WITH {R.STEMS} SELECT term, file_id, list(pos ORDER BY pos) AS positions FROM st GROUP BY ALL")
def index_postings(spark, d):
    return S.postings(_docs(spark, d)).withColumn("positions", F.transform("positions", lambda x: x.cast("long")))


@query(f"WITH {R.TOK} SELECT file_id, len(l) AS dl FROM c")
def index_docstats(spark, d):
    return S.docstats(_docs(spark, d))


# -------------------------------------------------------------------- search

def _search(name: str, raw: str, sql: str) -> None:
    def run(spark, d):
        return _hits(S.search(_docs(spark, d), raw))

    run.__name__ = name
    query(sql)(run)


_search("search_term", "posters", R.ranked(R.STEMS, {"x": R.term("poster")}, "x.f > 0"))
_search("search_and", "price storm", R.ranked(R.STEMS, {"x": R.term("price"), "y": R.term("storm")}, "x.f > 0 AND y.f > 0"))
_search("search_or", "barcode OR heading", R.ranked(R.STEMS, {"x": R.term("barcod"), "y": R.term("head")}, "x.f > 0 OR y.f > 0"))
_search("search_not", "poster NOT banner", R.ranked(R.STEMS, {"x": R.term("poster"), "y": R.term("banner")}, "x.f > 0 AND y.f IS NULL", {"y": "never"}))
_search("search_prefix", "phot*", R.ranked(R.STEMS, {"x": R.prefix("phot")}, "x.f > 0"))
_search("search_phrase", '"price of bread"', R.ranked(R.STEMS, {"x": R.phrase("price", "of", "bread")}, "x.f > 0"))
_search(
    "search_grouped", "(label OR sticker) frame",
    R.ranked(R.STEMS, {"x": R.term("label"), "y": R.term("sticker"), "z": R.term("frame")}, "(x.f > 0 OR y.f > 0) AND z.f > 0"),
)
_search(
    "search_near", '"price" NEAR(bread storm, 12)',
    R.ranked(
        R.STEMS + ", nr AS (SELECT a.file_id, a.pos AS x, b.pos AS y FROM st a JOIN st b ON a.file_id = b.file_id AND b.term = 'storm' WHERE a.term = 'bread' AND abs(a.pos - b.pos) - 1 <= 12)",
        {"x": R.term("price"), "y": "SELECT DISTINCT file_id, x FROM nr", "z": "SELECT DISTINCT file_id, y FROM nr"}, "x.f > 0 AND y.f > 0",
    ).replace("yd AS (SELECT count(*) AS df FROM y)", "yd AS (SELECT count(DISTINCT file_id) AS df FROM st WHERE term = 'bread')").replace("zd AS (SELECT count(*) AS df FROM z)", "zd AS (SELECT count(DISTINCT file_id) AS df FROM st WHERE term = 'storm')"),
)


def _batch_terms(spark, d):
    w = table(spark, d, "common_words").filter("lang = 'eng'").select("word_rank", "word")
    return porter.with_stem(w.filter(w.word.rlike("^[a-z]+$")), "word", "term").groupBy("term").agg(F.min("word_rank").alias("query_id"))


@query(
    f"""WITH {R.STEMS},
q AS (SELECT e.stem AS term, min(w.word_rank) AS query_id FROM common_words w JOIN eng_stems e USING (word) WHERE w.lang = 'eng' GROUP BY 1),
p AS (SELECT term, file_id, count(*) AS f FROM st GROUP BY ALL), h AS (SELECT query_id, file_id, f FROM p JOIN q USING (term)),
dfs AS (SELECT query_id, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT query_id, h.file_id, -({R.bm25("f", "df", "len(c.l)")}) AS score FROM h JOIN dfs USING (query_id) JOIN c ON c.file_id = h.file_id CROSS JOIN total)
SELECT query_id, file_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, file_id) <= 20""".replace(
        "q AS (SELECT", "eng_words AS (SELECT DISTINCT word AS w_ FROM common_words WHERE lang = 'eng' AND regexp_matches(word, '^[a-z]+$')),\n" + R.english_ctes() + ",\neng_stems AS (SELECT w_ AS word, stem FROM eng_all),\nq AS (SELECT", 1
    )
)
def search_batch(spark, d):
    return _hits(S.search_batch(_docs(spark, d), _batch_terms(spark, d)))


@query(
    """SELECT '/doc/' || doc_id AS path, doc_id AS file_id, lang FROM documents
WHERE contains(lower(text), 'rice of') AND contains(lower(text), 'storm') ORDER BY doc_id"""
)
def substring_search(spark, d):
    rows = _docs(spark, d)
    found = S.substring_tree(rows, '"rice of" storm').select("file_id")
    return rows.join(found, "file_id", "left_semi").select("path", "file_id", "lang")


@query(
    f"""WITH c AS (SELECT doc_id AS file_id, lower(coalesce(text, '')) AS t, lang FROM documents),
x AS (SELECT *, greatest(0, length(t) - 2) AS dl, (length(t) - length(replace(t, 'oster', ''))) // 5 AS f FROM c),
total AS (SELECT count(*) AS n, sum(dl) / count(*) AS a FROM x), xd AS (SELECT count(*) AS df FROM x WHERE f > 0)
SELECT '/doc/' || file_id AS path, round(-({R.bm25("f", "df", "dl")}), 6) AS score, CAST(0.0 AS DOUBLE) AS mtime, lang, file_id FROM x, total, xd WHERE f > 0
ORDER BY -({R.bm25("f", "df", "dl")}), file_id LIMIT 20"""
)
def substring_bm25(spark, d):
    return _hits(S.search_substring(_docs(spark, d), "oster"))


@query(
    f"""WITH {R.STEMS}, v AS (SELECT term, count(*) AS cnt FROM st GROUP BY 1),
q AS (SELECT * FROM (VALUES (1, 'barcdoe', 7, 2), (1, 'barcdo', 7, 2), (1, 'barcd', 7, 2), (2, 'fraem', 5, 1), (2, 'frae', 5, 1), (2, 'fra', 5, 1)) t(g, q, n, most)),
near AS (SELECT g, term, cnt, min(damerau_levenshtein({R.shape('q.q')}, {R.shape('term')})) AS dist FROM v, q
 WHERE length(term) BETWEEN n - most - 2 AND n + most AND term NOT IN ('barcdoe', 'fraem') AND damerau_levenshtein({R.shape('q.q')}, {R.shape('term')}) <= most GROUP BY ALL),
leaf AS (SELECT g, term FROM near QUALIFY row_number() OVER (PARTITION BY g ORDER BY dist, cnt DESC, term) <= 16),
p AS (SELECT term, file_id, count(*) AS f FROM st GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT p.file_id, count(DISTINCT g) AS groups, -sum({R.bm25("f", "df", "len(c.l)")}) AS score FROM leaf JOIN p USING (term) JOIN dfs USING (term) JOIN c ON c.file_id = p.file_id CROSS JOIN total GROUP BY 1)
SELECT 1 AS tier, '/doc/' || s.file_id AS path, round(score, 6) AS score, CAST(0.0 AS DOUBLE) AS mtime, lang, s.file_id FROM s JOIN documents ON doc_id = s.file_id WHERE groups = 2 ORDER BY s.score, s.file_id LIMIT 20"""
)
def fuzzy_search_two_tier(spark, d):
    return _hits(S.search_fuzzy(_docs(spark, d), "barcdoe fraem"))


@query()
def snippet_topk(spark, d):
    rows = _docs(spark, d)
    return _hits(S.with_snippet(rows, S.search(rows, "price storm"), "price storm"))


@query()
def snippet_substring(spark, d):
    rows = _docs(spark, d)
    return _hits(S.with_snippet_substring(rows, S.search_substring(rows, "rice of"), "rice of"))


@query(
    "SELECT printf('%.4f', score) || chr(9) || path AS value FROM ("
    + R.ranked(R.STEMS, {"x": R.term("poster")}, "x.f > 0")
    + ")"
)
def result_tsv(spark, d):
    return S.as_tsv(_hits(S.search(_docs(spark, d), "poster")), verbose=True)


@query(
    """SELECT '{"path":"' || path || '","score":' || CAST(score AS VARCHAR) || ',"mtime":0.0,"lang":' || coalesce('"' || lang || '"', 'null') || '}' AS value FROM ("""
    + R.ranked(R.STEMS, {"x": R.term("poster")}, "x.f > 0")
    + ")"
)
def result_json(spark, d):
    return S.as_json(_hits(S.search(_docs(spark, d), "poster")))


# --------------------------------------------------------------------- fuzzy

@query(f"WITH {R.TOK} SELECT DISTINCT token AS term, {R.shape('token')} AS shape FROM tok")
def fuzzy_fold(spark, d):
    return S.vocabulary(_docs(spark, d)).select("term", X.shape(F.col("term")).alias("shape"))


@query(f"WITH {R.TOK} SELECT DISTINCT token AS term, CASE WHEN length(token) <= 3 THEN 0 WHEN length(token) <= 6 THEN 1 ELSE 2 END AS budget FROM tok")
def fuzzy_budget(spark, d):
    return S.vocabulary(_docs(spark, d)).select("term", X.budget(F.length("term")).alias("budget"))


@query(
    f"""WITH {R.TOK}, v AS (SELECT token AS term, count(*) AS cnt FROM tok GROUP BY 1),
q AS (SELECT 'postr' AS q UNION ALL SELECT 'post' UNION ALL SELECT 'pos')
SELECT term, min(damerau_levenshtein({R.shape('q.q')}, {R.shape('term')}))::INT AS distance, cnt FROM v, q
WHERE length(term) BETWEEN 2 AND 6 AND term <> 'postr' AND damerau_levenshtein({R.shape('q.q')}, {R.shape('term')}) <= 1
GROUP BY term, cnt ORDER BY distance, cnt DESC, term LIMIT 16"""
)
def fuzzy_expand_d1(spark, d):
    return S.expand_term(S.vocabulary(_docs(spark, d)), "postr", 1)


@query(
    f"""WITH {R.TOK}, v AS (SELECT token AS term, count(*) AS cnt FROM tok GROUP BY 1),
q AS (SELECT 'photgraph' AS q UNION ALL SELECT 'photgrap' UNION ALL SELECT 'photgra')
SELECT term, min(damerau_levenshtein({R.shape('q.q')}, {R.shape('term')}))::INT AS distance, cnt FROM v, q
WHERE length(term) BETWEEN 5 AND 11 AND term <> 'photgraph' AND damerau_levenshtein({R.shape('q.q')}, {R.shape('term')}) <= 2
GROUP BY term, cnt ORDER BY distance, cnt DESC, term LIMIT 16"""
)
def fuzzy_expand_d2(spark, d):
    return S.expand_term(S.vocabulary(_docs(spark, d)), "photgraph", 2)


@query()
def osa_distance(spark, d):
    """Distances of all words to one, whole. SQL has the unrestricted distance only; tests compare with brute force."""
    v = S.vocabulary(_docs(spark, d)).select("term")
    return v.select("term", X.osa_col(X.shape(F.col("term")), F.lit(X.shape_py("frame"))).cast("int").alias("distance"))


# ---------------------------------------------------------------- text values

_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WS_SQL = _WS.replace(r"\x0b", r"\x{0b}").replace(r"\x0c", r"\x{0c}").replace(r"\x1c-\x1f", "").replace(r"\x85", r"\x{85}").replace(r"\xa0", r"\x{a0}")


@query(f"SELECT DISTINCT file_id, trim(regexp_replace(content, '{_WS_SQL}', ' ', 'g')) AS content FROM ocr_text")
def collapse_ws(spark, d):
    t = table(spark, d, "ocr_text")
    return t.select("file_id", X.collapse_whitespace(F.col("content")).alias("content")).distinct()


@query(f"SELECT DISTINCT file_id, len(list_filter(string_split(regexp_replace(content, '{_WS_SQL}', ' ', 'g'), ' '), lambda w: w <> '')) AS words FROM ocr_text")
def word_count(spark, d):
    return table(spark, d, "ocr_text").select("file_id", F.when(F.col("content").isNotNull(), X.word_count(F.col("content"))).cast("long").alias("words")).distinct()


@query(
    """SELECT DISTINCT path, array_to_string(list_transform(list_filter(string_split(path, ' '), lambda t: t <> ''),
  lambda t: CASE WHEN regexp_matches(t, '^[\\p{L}\\p{M}\\p{N}]+\\*?$') THEN t ELSE '"' || t || '"' END), ' ') AS query FROM files"""
)
def sanitize_queries(spark, d):
    return table(spark, d, "files").select("path", X.sanitize_col(F.col("path")).alias("query")).distinct()


@query("SELECT DISTINCT path, regexp_matches(path, '(?i)[^/\\\\]\\.(jpg|jpeg|png|webp|gif|bmp|tiff|tif)$') AS supported FROM watch_events")
def supported_extension(spark, d):
    return table(spark, d, "watch_events").select("path", is_image(F.col("path")).alias("supported")).distinct()


@query(
    """SELECT DISTINCT lang, CASE WHEN lang IS NULL THEN NULL ELSE (SELECT e FROM (SELECT list_filter(list_transform(string_split(lang, '+'), lambda p: CASE WHEN trim(p) = '' THEN 'empty code'
 WHEN lower(trim(p)) = 'osd' THEN 'detector, not a language' WHEN NOT regexp_matches(trim(p), '^[A-Za-z0-9_]+$') THEN 'bad code' END), lambda k: k IS NOT NULL)[1] AS e)) END AS error FROM files"""
)
def lang_spec_errors(spark, d):
    return table(spark, d, "files").select("lang", X.lang_spec_error(F.col("lang")).alias("error")).distinct()


@query("SELECT vec_id, round(greatest(0.0, (label * 1000003 - 3000000) / 1e6), 6) AS seconds FROM embeddings")
def mtime_seconds(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(X.unix_seconds((F.col("label").cast("long") * 1000003 - 3000000).cast("double")), 6).alias("seconds"))


@query("SELECT event_id, strftime(make_timestamp(CAST(floor(mtime) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM watch_events")
def iso_timestamps(spark, d):
    return table(spark, d, "watch_events").select("event_id", X.iso8601(F.floor("mtime")).alias("at"))


@query(
    """SELECT event_id, CASE WHEN s < 89.5 THEN CAST(CAST(round(s) AS BIGINT) AS VARCHAR) || 's' WHEN s < 5399.5 THEN CAST(m AS VARCHAR) || 'm'
 WHEN m % 60 = 0 THEN CAST(m // 60 AS VARCHAR) || 'h' ELSE CAST(m // 60 AS VARCHAR) || 'h ' || CAST(m % 60 AS VARCHAR) || 'm' END AS text
FROM (SELECT event_id, value * 40 AS s, CAST(round(value * 40 / 60) AS BIGINT) AS m FROM events)"""
)
def human_durations(spark, d):
    return table(spark, d, "events").select("event_id", X.human_duration(F.col("value") * 40).alias("text"))


@query("SELECT code, CASE WHEN size >= 1048576 THEN printf('%.1f', size / 1048576.0) || ' MB' ELSE printf('%.0f', size / 1024.0) || ' kB' END AS text FROM lang_packs")
def human_sizes(spark, d):
    return table(spark, d, "lang_packs").select("code", X.human_bytes(F.col("size")).alias("text"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN 0.6 ELSE 0.3 + 0.7 / sqrt(p_size) END, 9) AS band FROM part")
def estimate_band(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(X.estimate_band(F.when(F.col("p_size") % 7 != 0, F.col("p_size"))), 9).alias("band"))


@query("SELECT p_partkey, round(p_partkey * p_retailprice / 1000 / pow(greatest(p_size, 1), 0.58), 6) AS seconds FROM part")
def estimate_seconds(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(X.estimated_seconds(F.col("p_partkey"), F.col("p_retailprice") / 1000, F.col("p_size")), 6).alias("seconds"))


@query(
    """SELECT l_orderkey, l_linenumber, ((l_partkey % 256) * 19595 + (l_suppkey % 256) * 38470 + CAST(l_quantity AS BIGINT) * 7471 + 32768) >> 16 AS luma FROM lineitem"""
)
def luma(spark, d):
    c = lambda x: F.col(x).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.luma(c("l_partkey") % 256, c("l_suppkey") % 256, c("l_quantity")).alias("luma"))


@query(
    """SELECT p_partkey, CASE WHEN w < 1000 THEN 1200 WHEN w > 2400 THEN 2400 END AS width, CASE WHEN w < 1000 THEN greatest(1, h * 1200 // w) WHEN w > 2400 THEN greatest(1, h * 2400 // w) END AS height,
 CASE WHEN w < 1000 THEN 'bicubic' WHEN w > 2400 THEN 'lanczos' END AS filter FROM (SELECT p_partkey, (p_partkey * 37) % 4000 + 1 AS w, CAST(p_size AS BIGINT) * 53 AS h FROM part)"""
)
def resize_target(spark, d):
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 4000 + 1).alias("w"), (F.col("p_size").cast("long") * 53).alias("h"))
    r = p.select("p_partkey", X.resize_target(F.col("w"), F.col("h")).alias("r"))
    return r.select("p_partkey", F.col("r.w").alias("width"), F.col("r.h").alias("height"), F.col("r.filter").alias("filter"))


# ------------------------------------------------------------ recognised text

_WORDS = "(SELECT l_orderkey AS k, l_linenumber AS o, ' w' || l_partkey || ' ' AS w, l_discount * 1000 AS conf FROM lineitem)"


@query(f"SELECT k AS l_orderkey, coalesce(string_agg(trim(w), ' ' ORDER BY o, trim(w)) FILTER (WHERE conf >= 40 AND trim(w) <> ''), '') AS text FROM {_WORDS} GROUP BY 1")
def confidence_filter(spark, d):
    w = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("o"), F.concat(F.lit(" w"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("w"), (F.col("l_discount") * 1000).alias("conf"))
    return I.confident_text(w, "l_orderkey", "o", "w", "conf", 40)


@query(
    """WITH s AS (SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus AS a, lower(o_orderpriority) || ' X ' || o_orderstatus || ' x' AS b FROM orders),
p AS (SELECT o_orderkey, list_filter(string_split(a, ' '), lambda w: w <> '') AS x, list_filter(string_split(b, ' '), lambda w: w <> '') AS y FROM s),
u AS (SELECT o_orderkey, x, unnest(y) AS w, generate_subscripts(y, 1) AS i FROM p),
f AS (SELECT o_orderkey, string_agg(w, ' ' ORDER BY i) AS t FROM (SELECT *, min(i) OVER (PARTITION BY o_orderkey, lower(w)) AS first FROM u) WHERE i = first AND NOT list_contains(list_transform(x, lambda z: lower(z)), lower(w)) GROUP BY 1)
SELECT p.o_orderkey, array_to_string(x, ' ') || coalesce(' ' || t, '') AS text FROM p LEFT JOIN f USING (o_orderkey)"""
)
def union_words(spark, d):
    o = table(spark, d, "orders")
    a = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
    b = F.concat(F.lower("o_orderpriority"), F.lit(" X "), F.col("o_orderstatus"), F.lit(" x"))
    return o.select("o_orderkey", X.union_words(a, b).alias("text"))


@query(f"SELECT DISTINCT file_id, len(list_filter(string_split(regexp_replace(coalesce(content, ''), '{_WS_SQL}', ' ', 'g'), ' '), lambda w: w <> '')) <= 3 AS wanted FROM ocr_text")
def thorough_gate(spark, d):
    return table(spark, d, "ocr_text").select("file_id", X.second_arm_wanted(F.coalesce("content", F.lit(""))).alias("wanted")).distinct()


# ----------------------------------------------------------------- maintenance

_DISK = "disk AS (SELECT '/img/' || (o_custkey % 10) || '/' || o_orderkey || '.jpg' AS path, o_totalprice AS mtime FROM orders WHERE o_orderkey % 11 <> 0)"
_STORED = "stored AS (SELECT o_orderkey AS id, '/img/' || (o_custkey % 10) || '/' || o_orderkey || '.jpg' AS path, o_totalprice - CASE WHEN o_orderkey % 5 = 0 THEN 500 ELSE 0 END AS mtime FROM orders WHERE o_orderkey % 7 <> 0)"


def _disk(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 11 <> 0")
    return o.selectExpr("concat('/img/', o_custkey % 10, '/', o_orderkey, '.jpg') as path", "o_totalprice as mtime")


def _stored(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 7 <> 0")
    return o.selectExpr("o_orderkey as id", "concat('/img/', o_custkey % 10, '/', o_orderkey, '.jpg') as path", "o_totalprice - case when o_orderkey % 5 = 0 then 500 else 0 end as mtime", "'2026-01-01T00:00:00Z' as indexed_at", "'eng' as lang")


@query(f"WITH {_DISK}, {_STORED} SELECT d.path, d.mtime, CASE WHEN s.path IS NULL THEN 'new' WHEN s.mtime = d.mtime THEN 'skipped' ELSE 'changed' END AS state FROM disk d LEFT JOIN stored s USING (path)")
def index_difference(spark, d):
    return I.difference(_disk(spark, d), _stored(spark, d))


@query(f"WITH {_DISK}, {_STORED} SELECT id, path FROM stored s WHERE (path = '/img/1' OR starts_with(path, '/img/1/')) AND NOT EXISTS (SELECT 1 FROM disk d WHERE d.path = s.path)")
def index_stale(spark, d):
    return I.stale(_disk(spark, d), _stored(spark, d), "/img/1/").select("id", "path")


@query(
    f"""WITH {_DISK}, {_STORED}, x AS (SELECT CASE WHEN s.path IS NULL THEN 'new' WHEN s.mtime = d.mtime THEN 'skipped' ELSE 'changed' END AS state FROM disk d LEFT JOIN stored s USING (path))
SELECT count(*) FILTER (WHERE state <> 'skipped') AS to_process, count(*) FILTER (WHERE state = 'new') AS new_files, count(*) FILTER (WHERE state = 'changed') AS changed, count(*) FILTER (WHERE state = 'skipped') AS skipped,
 (SELECT count(*) FROM stored s WHERE NOT EXISTS (SELECT 1 FROM disk d WHERE d.path = s.path)) AS stale FROM x"""
)
def dry_run_counts(spark, d):
    return I.dry_run(_disk(spark, d), _stored(spark, d), "/img")


@query(
    f"""WITH {_DISK}, n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS k, greatest(1, count(*) OVER () // 33) AS s FROM disk) SELECT path FROM n WHERE k % s = 0 AND k // s < 33"""
)
def strided_sample(spark, d):
    return I.strided_sample(_disk(spark, d).select("path"))


@query(f"WITH {_DISK} SELECT path, (row_number() OVER (ORDER BY path) - 1) // 16 AS batch FROM disk")
def batch_chunks(spark, d):
    return I.batches(_disk(spark, d).select("path"))


_RESULTS = "results AS (SELECT d.path, d.mtime, CASE WHEN o % 13 = 0 THEN 'failed' WHEN o % 17 = 0 THEN 'empty' ELSE 'text' END AS status FROM (SELECT *, CAST(regexp_extract(path, '([0-9]+)\\.jpg', 1) AS BIGINT) AS o FROM disk) d)"


def _results(spark, d):
    o = F.regexp_extract("path", r"([0-9]+)\.jpg", 1).cast("long")
    status = F.when(o % 13 == 0, "failed").when(o % 17 == 0, "empty").otherwise("text")
    return _disk(spark, d).select("path", "mtime", status.alias("status"), F.when(status == "text", F.col("path")).alias("text"))


@query(
    f"""WITH {_DISK}, {_STORED}, {_RESULTS}, ok AS (SELECT * FROM results WHERE status <> 'failed'),
fresh AS (SELECT path, mtime, status, (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY path) AS id FROM ok WHERE path NOT IN (SELECT path FROM stored))
SELECT s.id, s.path, coalesce(o.mtime, s.mtime) AS mtime, CASE WHEN o.path IS NULL THEN '2026-01-01T00:00:00Z' ELSE '2026-02-02T00:00:00Z' END AS indexed_at, CASE WHEN o.path IS NULL THEN 'eng' ELSE 'deu' END AS lang,
 CASE WHEN o.status = 'text' THEN s.path WHEN o.path IS NOT NULL THEN '' END AS text, o.path IS NOT NULL AS written FROM stored s LEFT JOIN ok o USING (path)
UNION ALL SELECT id, path, mtime, '2026-02-02T00:00:00Z', 'deu', CASE WHEN status = 'text' THEN path ELSE '' END, true FROM fresh"""
)
def index_upsert(spark, d):
    return I.upsert(_stored(spark, d), _results(spark, d), "2026-02-02T00:00:00Z", "deu").select("id", "path", "mtime", "indexed_at", "lang", "text", "written")


@query(
    f"""WITH {_DISK}, {_STORED}, {_RESULTS} SELECT count(*) FILTER (WHERE status <> 'failed' AND s.path IS NULL) AS indexed, count(*) FILTER (WHERE status <> 'failed' AND s.path IS NOT NULL) AS updated,
 count(*) FILTER (WHERE status = 'failed') AS failed, 0 AS skipped, 0 AS deleted FROM results r LEFT JOIN stored s USING (path)"""
)
def run_counters(spark, d):
    return I.run_counters(_stored(spark, d), _results(spark, d))


@query(f"WITH {_STORED} SELECT id, path FROM stored WHERE id % 3 <> 0")
def index_delete(spark, d):
    s = _stored(spark, d)
    return I.delete(s, s.filter("id % 3 = 0").select("path")).select("id", "path")


@query(f"WITH {_STORED} SELECT id, CASE WHEN id % 20 = 1 THEN path || '.moved.jpg' ELSE path END AS path FROM stored")
def index_rename(spark, d):
    s = _stored(spark, d)
    moves = s.filter("id % 20 = 1").select(F.col("path").alias("old"), F.concat("path", F.lit(".moved.jpg")).alias("new"))
    return I.rename(s, moves).select("id", "path")


@query(
    """WITH e AS (SELECT DISTINCT path FROM watch_events WHERE kind <> 'access' AND path IS NOT NULL AND regexp_matches(path, '(?i)[^/\\\\]\\.(jpg|jpeg|png|webp|gif|bmp|tiff|tif)$')),
f AS (SELECT path, min(mtime) AS mtime FROM files GROUP BY 1),
k AS (SELECT path, arg_max(kind, ts) AS kind, max(mtime) AS mtime FROM watch_events WHERE kind <> 'access' AND path IS NOT NULL GROUP BY 1),
s AS (SELECT e.path, f.mtime AS stored, CASE WHEN k.kind <> 'remove' THEN k.mtime END AS disk FROM e LEFT JOIN f USING (path) LEFT JOIN k USING (path)),
gone AS (SELECT path, stored AS m, row_number() OVER (PARTITION BY stored ORDER BY path) AS n FROM s WHERE disk IS NULL AND stored IS NOT NULL),
fresh AS (SELECT path, disk AS m, row_number() OVER (PARTITION BY disk ORDER BY path) AS n FROM s WHERE stored IS NULL AND disk IS NOT NULL),
r AS (SELECT g.path AS old, h.path AS new FROM gone g JOIN fresh h USING (m, n))
SELECT 'rename' AS action, old AS path, new AS new_path FROM r UNION ALL SELECT 'delete', path, NULL FROM gone WHERE path NOT IN (SELECT old FROM r)
UNION ALL SELECT 'index', path, NULL FROM s WHERE disk IS NOT NULL AND path NOT IN (SELECT new FROM r)"""
)
def rename_plan(spark, d):
    e = table(spark, d, "watch_events")
    stored = table(spark, d, "files").groupBy("path").agg(F.min("mtime").alias("mtime"))
    k = e.filter("kind <> 'access' and path is not null").groupBy("path").agg(F.max_by("kind", "ts").alias("kind"), F.max("mtime").alias("mtime"))
    return I.watch_plan(I.touched_paths(e), stored, k.filter("kind <> 'remove'").select("path", "mtime"))


@query("SELECT count(*) AS file_count, max(indexed_at) AS last_indexed_at FROM files")
def index_stats(spark, d):
    return I.stats(table(spark, d, "files"))


@query("SELECT DISTINCT indexed_at, CAST(indexed_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS at FROM files")
def indexed_instants(spark, d):
    return table(spark, d, "files").select("indexed_at", instant(F.col("indexed_at")).cast("timestamp_ntz").alias("at")).distinct()


# ----------------------------------------------------------------------- watch

@query("SELECT DISTINCT path FROM watch_events WHERE kind <> 'access' AND regexp_matches(path, '(?i)[^/\\\\]\\.(jpg|jpeg|png|webp|gif|bmp|tiff|tif)$')")
def watch_filter(spark, d):
    return I.touched_paths(table(spark, d, "watch_events"))


def _events(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 50).alias("root"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


@query(
    """WITH e AS (SELECT user_id % 50 AS root, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY root ORDER BY t) < 600 THEN 0 ELSE 1 END AS new FROM e),
b AS (SELECT *, sum(new) OVER (PARTITION BY root ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT root, min(t) AS started, max(t) AS ended, count(*) AS n FROM b GROUP BY root, k"""
)
def watch_sessions(spark, d):
    return batcher.sessions(_events(spark, d), gap=600)


@query(
    """WITH RECURSIVE e AS (SELECT root, t, row_number() OVER (PARTITION BY root ORDER BY t) AS i FROM (SELECT user_id % 50 AS root, epoch_us(ts) / 1e6 AS t FROM events)),
w AS (SELECT root, i, t, t AS started, 0 AS k, false AS closed FROM e WHERE i = 1 UNION ALL
 SELECT e.root, e.i, e.t, CASE WHEN w.closed OR e.t - w.t >= 7200 THEN e.t ELSE w.started END, CASE WHEN w.closed OR e.t - w.t >= 7200 THEN w.k + 1 ELSE w.k END,
  CASE WHEN w.closed OR e.t - w.t >= 7200 THEN false ELSE e.t - w.started >= 20000 END FROM w JOIN e ON e.root = w.root AND e.i = w.i + 1)
SELECT root, min(started) AS started, max(t) AS ended, count(*) AS n FROM w GROUP BY root, k"""
)
def watch_sessions_capped(spark, d):
    return batcher.capped_batches(_events(spark, d), gap=7200, cap=20000)


# --------------------------------------------------------------- profile, packs

@query(
    """WITH s AS (SELECT l_orderkey AS image, CASE l_linenumber % 3 WHEN 0 THEN 'decode' WHEN 1 THEN 'preprocess' ELSE 'recognize' END AS stage, l_quantity AS ms FROM lineitem),
b AS (SELECT image, stage, min(ms) AS ms FROM s GROUP BY ALL) SELECT stage, avg(ms) AS mean_ms, median(ms) AS median_ms, sum(ms) / (SELECT sum(ms) FROM b) AS share FROM b GROUP BY 1"""
)
def stage_profile(spark, d):
    stage = F.expr("case l_linenumber % 3 when 0 then 'decode' when 1 then 'preprocess' else 'recognize' end")
    return I.stage_profile(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), stage.alias("stage"), F.col("l_quantity").alias("ms")))


@query("SELECT code, name, kind FROM lang_packs WHERE contains(lower(code), 'an') OR contains(lower(name), 'an')")
def packs_available(spark, d):
    from ..sources.packs import matching

    return matching(table(spark, d, "lang_packs"), "AN").select("code", "name", "kind")


@query("SELECT code, 'https://raw.githubusercontent.com/owner/packs/4.1.0/' || code || '.traineddata' AS url FROM lang_packs")
def pack_urls(spark, d):
    return table(spark, d, "lang_packs").select("code", X.pack_url(F.lit("https://github.com/owner/packs"), F.lit("4.1.0"), F.col("code")).alias("url"))


@query("SELECT DISTINCT p AS code FROM (SELECT unnest(string_split(lang, '+')) AS p FROM files WHERE lang IS NOT NULL) WHERE p NOT IN (SELECT code FROM lang_packs)")
def packs_missing(spark, d):
    from ..sources.packs import missing

    wanted = table(spark, d, "files").select(F.explode(F.split("lang", r"\+")).alias("code"))
    return missing(wanted, table(spark, d, "lang_packs"))


@query("SELECT f.id, f.lang, coalesce(a.code, b.code, lower(string_split(replace(f.lang, '-', '_'), '_')[1])) AS code FROM (SELECT DISTINCT id, lang FROM files WHERE lang IS NOT NULL AND lang <> '') f LEFT JOIN lang_packs a ON a.iso1 = lower(string_split(replace(f.lang, '-', '_'), '_')[1]) LEFT JOIN lang_packs b ON b.code = lower(string_split(replace(f.lang, '-', '_'), '_')[1])")
def locale_packs(spark, d):
    from ..sources.packs import from_locale

    f = table(spark, d, "files").filter("lang is not null and lang <> ''").select("id", "lang").distinct()
    return from_locale(f, table(spark, d, "lang_packs"))

