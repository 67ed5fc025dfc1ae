"""Ranked search: words, phrases, prefixes and Boolean queries with BM25; substrings; typo-tolerant search; excerpts.

A search reads a corpus (file_id, path, mtime, lang, content) or an index (``postings`` and ``docstats``) made from it.
Everything is expressions over position arrays: candidates are the rows of the query's terms only, one shuffle groups them by
document, and scores are arithmetic over counts. What comes to the driver is one row of statistics; the hits end in a
top-k, and texts and excerpts are looked up for those few rows only.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import porter
from ..functions.text import budget_py, collapse_whitespace, distance_within, fold_py, is_bareword, phrase_starts, sanitize, stem_distance_within, tokens
from ..plans.runtime import cut
from .query import Near, Op, Phrase, leaves, plan

K1, B = 1.2, 0.75
#: Candidates a misspelt word may be widened by, and the greatest distance.
EXPANSIONS, MOST_DISTANCE = 16, 3


# ----------------------------------------------------------------------- index


def corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(file_id, path, mtime, lang, content) from a table of documents."""
    has = set(docs.columns)
    return docs.select(
        F.col(key).alias("file_id"),
        (F.col("path") if "path" in has else F.concat(F.lit("/doc/"), F.col(key).cast("string"))).alias("path"),
        (F.col("mtime") if "mtime" in has else F.lit(0.0)).cast("double").alias("mtime"),
        (F.col("lang") if "lang" in has else F.lit(None)).cast("string").alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )


def token_rows(rows: DataFrame) -> DataFrame:
    """(file_id, pos, token) of every token."""
    return rows.select("file_id", F.posexplode(tokens(F.col("content"))).alias("pos", "token"))


def postings(rows: DataFrame, stemmed: bool = True) -> DataFrame:
    """(term, file_id, positions): the inverted index. Words are stemmed once each, not once per occurrence."""
    t = token_rows(rows)
    if stemmed:
        words = porter.with_stem(t.select("token").distinct(), "token", "term")
        t = t.join(words, "token").select("file_id", "term", "pos")
    else:
        t = t.withColumnRenamed("token", "term")
    return t.groupBy("term", "file_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def docstats(rows: DataFrame) -> DataFrame:
    """(file_id, dl): tokens of each document, empty ones included."""
    return rows.select("file_id", F.size(tokens(F.col("content"))).cast("long").alias("dl"))


def vocabulary(rows: DataFrame, stemmed: bool = False) -> DataFrame:
    """(term, doc, cnt): documents and occurrences of each term."""
    t = token_rows(rows)
    if stemmed:
        t = t.join(porter.with_stem(t.select("token").distinct(), "token", "term"), "token")
    else:
        t = t.withColumnRenamed("token", "term")
    return t.groupBy("term", "file_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("doc"), F.sum("n").alias("cnt"))


def length_window(words: DataFrame, query: str, most: int) -> DataFrame:
    """The words whose length lets them be within ``most`` edits of a word (two more letters may be cut from it)."""
    n = len(query)
    return words.filter(F.length("term").between(max(0, n - most - 2), n + most))


# ------------------------------------------------------------------- word search


def _is(term: str, prefix: bool) -> Column:
    return F.col("term").startswith(term) if prefix else F.col("term") == term


def _runs(positions: list[Column], phrase: Phrase) -> Column:
    """Start positions of a phrase from the positions of its terms."""

    def followed(starts: Column, other: Column, k: int) -> Column:
        return F.filter(starts, lambda x: F.array_contains(other, x + k))

    first = positions[0]
    for k, p in enumerate(positions[1:], 1):
        first = followed(first, p, k)
    return F.filter(first, lambda x: x == 0) if phrase.first else first


def _near_starts(node: Near, starts: dict, which: int) -> Column:
    """The places of one phrase of a NEAR that have every other phrase of it within the distance."""
    phrases = [(starts[id(p)], len(p.terms)) for p in node.phrases]
    mine, size = phrases[which]
    others = phrases[:which] + phrases[which + 1 :]

    def fits(chosen: list, rest: list) -> Column:
        if not rest:
            if len(chosen) == 1:
                return F.lit(True)
            ends = F.greatest(*[c + n for c, n in chosen])
            return (ends - F.least(*[c for c, _ in chosen]) - sum(n for _, n in chosen)) <= node.distance
        (pos, n), *more = rest
        return F.exists(pos, lambda x: fits([*chosen, (x, n)], more))

    return F.filter(mine, lambda x: fits([(x, size)], others))


def _near(starts: dict, node: Near) -> Column:
    return F.size(_near_starts(node, starts, 0)) > 0


def _matches(node, starts: dict) -> Column:
    if isinstance(node, Phrase):
        return F.size(starts[id(node)]) > 0
    if isinstance(node, Near):
        return _near(starts, node)
    if node.kind == "none":
        return F.lit(False)
    if node.kind == "not":
        return _matches(node.args[0], starts) & ~_matches(node.args[1], starts)
    out = _matches(node.args[0], starts)
    for a in node.args[1:]:
        out = (out & _matches(a, starts)) if node.kind == "and" else (out | _matches(a, starts))
    return out


def _scored(node, starts: dict, gate: Column | None, idf: dict, part) -> list[Column]:
    """One addend per phrase, counted only where every expression around it matches; what NOT excludes never scores."""
    if isinstance(node, (Phrase, Near)):
        ok = _matches(node, starts) if gate is None else gate & _matches(node, starts)
        if isinstance(node, Phrase):
            found = [(node, starts[id(node)])]
        else:  # only places that take part in the nearness count
            found = [(p, _near_starts(node, starts, k)) for k, p in enumerate(node.phrases)]
        return [F.when(ok, part(F.size(s).cast("double"), idf[id(p)])).otherwise(0.0) for p, s in found]
    if node.kind == "none":
        return []
    ok = _matches(node, starts) if gate is None else gate & _matches(node, starts)
    args = node.args[:1] if node.kind == "not" else node.args
    return [c for a in args for c in _scored(a, starts, ok, idf, part)]


def _same_leaves(node):
    """Every leaf as an object of its own, so that repeats keep their own places."""
    if isinstance(node, Phrase):
        return Phrase(tuple(node.terms), node.prefix, node.first)
    if isinstance(node, Near):
        return Near(tuple(_same_leaves(p) for p in node.phrases), node.distance)
    return Op(node.kind, tuple(_same_leaves(a) for a in node.args))


def idf(n: int, df: int) -> float:
    """Inverse document frequency, never below a millionth."""
    return max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))


def _wanted(found: list[Phrase]) -> list[tuple[str, bool]]:
    return sorted({(t, p.prefix and k == len(p.terms) - 1) for p in found for k, t in enumerate(p.terms)})


def _any(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def _from_texts(rows: DataFrame, wanted: list[tuple[str, bool]], stemmed: bool) -> DataFrame:
    """(file_id, p0, p1, ...): sorted positions of each wanted term, from the texts themselves."""
    toks = token_rows(rows)
    # a stem shares all but its last letter with its words: others never reach the stemmer
    toks = toks.filter(_any([F.col("token").startswith(t[: max(1, len(t) - 1)] if stemmed else t) for t, _ in wanted]))
    toks = porter.with_stem(toks, "token", "term") if stemmed else toks.withColumnRenamed("token", "term")
    cols = [F.array_sort(F.collect_list(F.when(_is(t, pre), F.col("pos")))).alias(f"p{k}") for k, (t, pre) in enumerate(wanted)]
    return toks.filter(_any([_is(t, pre) for t, pre in wanted])).groupBy("file_id").agg(*cols)


def _from_postings(posts: DataFrame, wanted: list[tuple[str, bool]]) -> DataFrame:
    """The same from an inverted index; the conditions on the term reach the scan, which is sorted by term."""
    cols = [F.array_sort(F.flatten(F.collect_list(F.when(_is(t, pre), F.col("positions"))))).alias(f"p{k}") for k, (t, pre) in enumerate(wanted)]
    return posts.filter(_any([_is(t, pre) for t, pre in wanted])).groupBy("file_id").agg(*cols)


def search_tree(rows: DataFrame, tree, stemmed: bool = True) -> DataFrame:
    """(file_id, score) of every match of a query tree; the lower the score, the better."""
    return _ranked(tree, lambda wanted: _from_texts(rows, wanted, stemmed), docstats(rows))


def search_index(posts: DataFrame, stats: DataFrame, tree) -> DataFrame:
    """``search_tree`` over an index: (term, file_id, positions) and (file_id, dl)."""
    return _ranked(tree, lambda wanted: _from_postings(posts, wanted), stats)


def search_postings(posts: DataFrame, tree, n: int, tokens: int, df_of=None) -> DataFrame:
    """``search_index`` over postings that hold the length of their document (dl), with the number of documents and tokens known.

    ``df_of`` gives the document frequencies of terms, from a stored vocabulary; with it a query of plain words is one scan of
    their postings and nothing else is read.
    """
    found = leaves(tree)
    plain = df_of is not None and all(len(p.terms) == 1 and not p.prefix and not p.first for p in found)
    df = df_of(sorted({p.terms[0] for p in found})) if plain and found else None

    def hits(wanted):
        cols = [F.array_sort(F.flatten(F.collect_list(F.when(_is(t, pre), F.col("positions"))))).alias(f"p{k}") for k, (t, pre) in enumerate(wanted)]
        return posts.filter(_any([_is(t, pre) for t, pre in wanted])).groupBy("file_id").agg(F.max("dl").alias("dl"), *cols)

    return _ranked(tree, hits, None, (n, tokens), df)


def _ranked(tree, hits_of, stats: DataFrame | None, totals: tuple[int, int] | None = None, df: dict[str, int] | None = None) -> DataFrame:
    tree = _same_leaves(tree)
    found = leaves(tree)
    if not found:
        return (stats if stats is not None else hits_of([("", False)])).select("file_id", F.lit(0.0).alias("score")).limit(0)
    wanted = _wanted(found)
    hits, at = hits_of(wanted), {w: F.col(f"p{k}") for k, w in enumerate(wanted)}
    starts = {}
    # phrase starts become columns, so that counts, matches and scores read them once
    for k, p in enumerate(found):
        hits = hits.withColumn(f"s{k}", _runs([at[(t, p.prefix and i == len(p.terms) - 1)] for i, t in enumerate(p.terms)], p))
        starts[id(p)] = F.col(f"s{k}")
    own = ["dl"] if stats is None else []
    hits = hits.select("file_id", *own, *[f"s{k}" for k in range(len(found))])
    n, tokens_ = totals or stats.agg(F.count("*").alias("n"), F.sum("dl").alias("t")).first()
    avg = (tokens_ or 0) / max(1, n) or 1.0
    if df is None:
        seen = hits.agg(*[F.count_if(F.size(f"s{k}") > 0).alias(f"d{k}") for k in range(len(found))]).first()
        idfs = {id(p): idf(n, seen[f"d{k}"]) for k, p in enumerate(found)}
    else:
        idfs = {id(p): idf(n, df.get(p.terms[0], 0)) for p in found}
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(avg))

    def part(f: Column, w: float) -> Column:
        return F.lit(w) * f * F.lit(K1 + 1) / (f + norm)

    matched = hits.filter(_matches(tree, starts))
    matched = matched if stats is None else matched.join(stats, "file_id")
    parts = _scored(tree, starts, None, idfs, part)
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return matched.select("file_id", (-score).alias("score"))


def search(rows: DataFrame, raw: str, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """(path, score, mtime, lang, file_id): the best hits; equal scores are ordered by file_id."""
    return top(rows, search_tree(rows, plan(raw, stemmed), stemmed), limit)


def top(rows: DataFrame, scored: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best, then their other columns: the corpus is joined with ``limit`` rows."""
    best = scored.orderBy("score", "file_id").limit(limit)
    return F.broadcast(best).join(rows, "file_id").select("path", "score", "mtime", "lang", "file_id")


def search_batch(rows: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, file_id, score) of the best hits of many one-word queries (query_id, term) in one plan.

    ``term`` is a stem. One pass over the corpus serves all queries: postings are joined with the queries on the term.
    Scores are ranked per query; hits of one query are spread over file_id before they meet, so that a frequent term is
    first cut to ``limit`` rows in every part.
    """
    t = token_rows(rows).select("file_id", "token")
    words = porter.with_stem(t.select("token").distinct(), "token", "term").join(queries.select("term").distinct(), "term", "left_semi")
    posts = t.join(words, "token").groupBy("term", "file_id").agg(F.count("*").alias("f"))
    stats = docstats(rows)
    total = stats.agg(F.count("*").alias("n"), F.sum("dl").alias("t")).first()
    n, avg = total["n"], (total["t"] or 0) / max(1, total["n"]) or 1.0
    hit = posts.join(queries, "term")
    df = hit.groupBy("query_id").agg(F.count("*").alias("df"))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(avg))
    w = F.greatest(F.lit(1e-6), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    scored = hit.join(df, "query_id").join(stats, "file_id").select("query_id", "file_id", (-(w * F.col("f") * (K1 + 1) / (F.col("f") + norm))).alias("score"))
    part = F.pmod(F.xxhash64("file_id"), F.lit(32))
    from pyspark.sql import Window as W

    local = scored.withColumn("_r", F.row_number().over(W.partitionBy("query_id", part).orderBy("score", "file_id"))).filter(F.col("_r") <= limit)
    best = local.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("score", "file_id"))).filter(F.col("_r") <= limit)
    return best.select("query_id", "file_id", "score")


# -------------------------------------------------------------- substring search


def _needles(raw: str) -> list[str]:
    """The case-folded strings a substring query asks for; shorter ones than three characters are ignored."""
    text = sanitize(raw)
    out, at = [], 0
    while at < len(text):
        if text[at] == '"':
            end = text.find('"', at + 1)
            end = len(text) if end < 0 else end
            out.append(text[at + 1 : end])
            at = end + 1
        elif text[at].isspace():
            at += 1
        else:
            end = at
            while end < len(text) and not text[end].isspace() and text[end] != '"':
                end += 1
            out.append(text[at:end].rstrip("*"))
            at = end
    return [w.lower() for w in out if len(w) >= 3]


def substring_tree(rows: DataFrame, raw: str) -> DataFrame:
    """(file_id, score): documents that hold every string of the query, in any case; diacritics count.

    The score is BM25 over overlapping occurrences with the number of trigrams as length.
    """
    needles = _needles(raw)
    if not needles:
        return rows.select("file_id", F.lit(0.0).alias("score")).limit(0)
    low = F.lower("content")
    f = [F.when(low.contains(x), F.regexp_count(low, F.lit("(?=\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E)"))).otherwise(0) for x in needles]
    base = rows.select("file_id", F.greatest(F.lit(0), F.length("content") - 2).alias("dl"), *[c.alias(f"f{k}") for k, c in enumerate(f)])
    one = base.agg(F.count("*").alias("n"), F.sum("dl").alias("t"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(f))]).first()
    n, avg = one["n"], (one["t"] or 0) / max(1, one["n"]) or 1.0
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(avg))
    score, ok = F.lit(0.0), F.lit(True)
    for k in range(len(f)):
        c = F.col(f"f{k}").cast("double")
        score = score + F.lit(idf(n, one[f"d{k}"])) * c * (K1 + 1) / (c + norm)
        ok = ok & (c > 0)
    return base.filter(ok).select("file_id", (-score).alias("score"))


def search_substring(rows: DataFrame, raw: str, limit: int = 20) -> DataFrame:
    return top(rows, substring_tree(rows, raw), limit)


# ------------------------------------------------------------------ fuzzy search


@F.pandas_udf(T.IntegerType())
def stem_distance(query: pd.Series, term: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([stem_distance_within(q, t, int(m)) for q, t, m in zip(query, term, most)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def word_distance(query: pd.Series, term: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([distance_within(q, t, int(m)) for q, t, m in zip(query, term, most)], dtype="Int32")


def expand_term(words: DataFrame, term: str, most: int | None = None) -> DataFrame:
    """(term, distance, cnt): up to EXPANSIONS dictionary terms near a word, the nearest and most frequent first.

    The dictionary is cut by length first and the word compared with what is left; the budget of a short word is nothing.
    """
    limit = min(budget_py(len(term)) if most is None else most, MOST_DISTANCE)
    if limit <= 0:
        return words.select("term", F.lit(0).alias("distance"), "cnt").limit(0)
    near = length_window(words, term, limit).filter((F.lower("term") != term.lower()) & F.col("term").rlike(r"^[\p{L}\p{N}\p{M}]+$"))
    d = stem_distance(F.lit(term), F.col("term"), F.lit(limit))
    return near.select("term", d.alias("distance"), "cnt").filter("distance is not null").orderBy("distance", F.desc("cnt"), "term").limit(EXPANSIONS)


def widen(words: DataFrame, tree, most: int | None, typed: dict[str, str]):
    """The tree with every single bare term replaced by itself or its near terms; None if nothing grew."""
    grew = False

    def walk(node):
        nonlocal grew
        if isinstance(node, Phrase):
            if len(node.terms) != 1 or node.prefix or node.first:
                return node
            near = [r["term"] for r in expand_term(words, typed.get(node.terms[0], node.terms[0]), most).collect()]
            if not near:
                return node
            grew = True
            return Op("or", (node, *[Phrase((t,)) for t in near if t != node.terms[0]])) if any(t != node.terms[0] for t in near) else node
        if isinstance(node, Near):
            return node
        return Op(node.kind, tuple(walk(a) for a in node.args))

    out = walk(tree)
    return out if grew else None


def search_fuzzy(rows: DataFrame, raw: str, limit: int = 20, most: int | None = None) -> DataFrame:
    """(tier, path, score, mtime, lang, file_id): exact hits first, then hits of the widened query, up to ``limit``.

    A query with anything quoted is never widened; neither are prefixes. Scores of the two tiers can't be compared.
    Widening works on the tree and on stored stems, so that operators beside a widened word stay what they are.
    """
    best = fuzzy_best(plan(raw), raw, limit, most, lambda tree: search_tree(rows, tree), lambda: vocabulary(rows, stemmed=True))
    return F.broadcast(best).join(rows, "file_id").select("tier", "path", "score", "mtime", "lang", "file_id")


def fuzzy_best(tree, raw: str, limit: int, most: int | None, run, words_of) -> DataFrame:
    """(file_id, score, tier) of ``search_fuzzy``: ``run`` searches a tree, ``words_of`` gives the vocabulary (term, cnt)."""
    exact = run(tree)
    first = exact.withColumn("tier", F.lit(0))
    text = sanitize(raw)
    wide = None
    if '"' not in text and exact.limit(limit).count() < limit:
        typed = {porter.stem(fold_py(w)): fold_py(w) for w in text.split() if is_bareword(w) and not w.endswith("*")}
        wide = widen(cut(words_of()), tree, most, typed)
    if wide is not None:
        more = run(wide).join(exact.select("file_id"), "file_id", "left_anti")
        first = first.unionByName(more.withColumn("tier", F.lit(1)))
    return first.orderBy("tier", "score", "file_id").limit(limit)


# ----------------------------------------------------------------------- excerpt


def excerpt(text: str, instances: list[tuple[int, int, int]], spans: list[tuple[int, int]], window: int) -> str:
    """``text`` around its best window of ``window`` tokens, matches in brackets.

    ``instances``: (phrase, first token, tokens) in order of the token. A window scores a thousand for each phrase it shows and
    one for each repeat; one that starts a sentence gets a bonus. White space comes out collapsed.
    """
    n = len(spans)
    if not n:
        return ""
    inst = sorted(instances, key=lambda x: (x[1], x[0]))

    def worth(start: int) -> tuple[int, int]:
        seen, score, first, last = set(), 0, -1, start
        for p, o, size in inst:
            if start <= o < start + window:
                score += 1 if p in seen else 1000
                seen.add(p)
                first = o if first < 0 else first
                last = max(last, o + size) if first != o or len(seen) > 1 else o + size
        centred = first - (window - (last - first)) // 2
        return score, max(0, min(centred, n - window))

    def sentence_starts() -> list[int]:
        out = [0]
        for k in range(1, n):
            gap = text[spans[k - 1][1] : spans[k][0]]
            at = max(gap.rfind("."), gap.rfind(":"))
            if at >= 0 and at + 1 < len(gap) and gap[at + 1].isspace():
                out.append(k)
        return out

    best, start = -1, 0
    heads = sentence_starts() if n > window else [0]
    for _, o, _ in inst:
        score, centred = worth(o)
        if score > best:
            best, start = score, centred
        if n > window:
            s = max(h for h in heads if h <= o)
            if s < o:
                score = worth(s)[0] + (120 if s == 0 else 100)
                if score > best:
                    best, start = score, s
    end = min(n, start + window)
    marks: list[list[int]] = []
    for _, o, size in inst:
        if o < start or o >= end:
            continue
        if marks and o < marks[-1][1]:
            marks[-1][1] = max(marks[-1][1], o + size)
        else:
            marks.append([o, o + size])
    out, at = ["..."] if start > 0 else [], spans[start][0] if start > 0 else 0
    for a, b in marks:
        b = min(b, n)
        out += [text[at : spans[a][0]], "[", text[spans[a][0] : spans[b - 1][1]], "]"]
        at = spans[b - 1][1]
    stop = len(text) if end >= n else max(at, spans[end - 1][1])
    out.append(text[at:stop])
    if end < n:
        out.append("...")
    return " ".join("".join(out).split())


def with_snippet(rows: DataFrame, hits: DataFrame, raw: str, window: int = 12) -> DataFrame:
    """Adds ``snippet`` to hits. Texts are looked up for the hits only, and only they reach Python."""
    phrases = leaves(plan(raw))

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            spans = phrase_starts(t)
            terms = [porter.stem(fold_py(t[a:b])) for a, b in spans]
            inst = []
            for k, p in enumerate(phrases):
                m = len(p.terms)
                for i in range(len(terms) - m + 1):
                    if all(terms[i + j] == x or (p.prefix and j == m - 1 and terms[i + j].startswith(x)) for j, x in enumerate(p.terms)):
                        inst.append((k, i, m))
            return excerpt(t, inst, spans, window)

        return pd.Series([one(t) for t in texts], dtype=object)

    best = F.broadcast(hits)
    return best.join(rows.select("file_id", F.col("content").alias("_content")), "file_id").withColumn("snippet", cut("_content")).drop("_content")


def with_snippet_substring(rows: DataFrame, hits: DataFrame, raw: str, window: int = 64) -> DataFrame:
    """Adds ``snippet`` in characters: matches of the strings in brackets within a window of ``window`` characters."""
    needles = _needles(raw)

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            low = t.lower()
            if len(low) != len(t):
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
            inst = []
            for k, x in enumerate(needles):
                at = low.find(x)
                while at >= 0:
                    inst.append((k, at, len(x)))
                    at = low.find(x, at + 1)
            return excerpt(t, inst, [(i, i + 1) for i in range(len(t))], window)

        return pd.Series([one(t) for t in texts], dtype=object)

    return F.broadcast(hits).join(rows.select("file_id", F.col("content").alias("_content")), "file_id").withColumn("snippet", cut("_content")).drop("_content")


# ------------------------------------------------------------------------- sinks


def as_json(hits: DataFrame) -> DataFrame:
    """One JSON object a hit: path, score, mtime, lang (null kept) and snippet only where it was asked for."""
    cols = ["path", "score", "mtime", "lang", *(["snippet"] if "snippet" in hits.columns else [])]
    return hits.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def as_tsv(hits: DataFrame, verbose: bool = False) -> DataFrame:
    """``[score<TAB>]path[<TAB>snippet]``."""
    cols = [F.format_string("%.4f", F.col("score"))] if verbose else []
    cols += [F.col("path")] + ([collapse_whitespace(F.col("snippet"))] if "snippet" in hits.columns else [])
    return hits.select(F.concat_ws("\t", *cols).alias("value"))
