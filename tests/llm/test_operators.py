"""Each operator on its own: right results on small cases, and defined results for awkward tables."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import language, neardup, normalize, packing, pii, quality, reading, scans, tokenizer

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
COMMON = [("eng", k, w) for k, w in enumerate("the of and to in is was for that on with as it at by from this are be or an not have which but all one".split())] + [("deu", 1, "der"), ("deu", 2, "die"), ("deu", 3, "und"), ("deu", 4, "das"), ("deu", 5, "ist"), ("deu", 6, "nicht"), (None, 1, "x"), ("eng", 9, None)]
SUBJECTS = "librarian gardener beekeeper surveyor caretaker apprentice electrician bookkeeper".split()
THINGS = "postcard envelope calendar drawing notebook sticker receipt photograph certificate logo".split()
PLACES = "museum library garden workshop cellar kitchen school archive harbour market".split()


def prose(seed, n=12):
    r = random.Random(seed)
    return " ".join(f"The {r.choice(SUBJECTS)} put the {r.choice(THINGS)} {r.randint(1, 99)} in the {r.choice(PLACES)} and it was not for the {r.choice(SUBJECTS)}." for _ in range(n))


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame(COMMON, "lang string, word_rank long, word string").cache()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeats, and columns with names used inside."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, prose(1)), (4, prose(1)), (5, prose(1)), (6, prose(2, 3000)), (None, prose(3)), (7, "x"), (8, "﻿​"), (9, "a" * 200_000), (10, "\n" * 5000)]
    return spark.createDataFrame([(k, t, "k", 1.0, "z") for k, t in rows], "file_id long, content string, kind string, _id double, lang string").cache()


# ------------------------------------------------------------------ normalising


def test_display_key():
    k = normalize.display_key
    same = [("ﬁsh", "fish"), ("ＡＢ１", "AB1"), ("café", "café"), ("a​b", "ab"), ("a b", "a b"), ("раураl", "paypal"), ("ⅼⅾ", "ld"), ("a b", "a b"), ("Τhe", "The"), ("ё", "ë")]
    differ = [("a", "A"), ("e", "é"), ("x²", "x2"), ("½", "1/2"), ("a\nb", "a b"), ("a-b", "a—b"), ("1", "l"), ("…", "...")]
    assert all(k(a) == k(b) for a, b in same) and all(k(a) != k(b) for a, b in differ)
    assert k(None) is None and k("") == ""


def test_normal_form():
    f = normalize.normal_form
    assert f("Ｓtraße") == "strasse" and f("İ") == f("i̇") and f(None) is None
    assert f("Τhe photogrаph а оf") == "the photograph a of"
    assert f("Мы нашли лампы") == "мы нашли лампы"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_display_key_is_stable(t):
    once = normalize.display_key(t)
    assert normalize.display_key(once) == normalize.display_key(normalize.display_key(once))


def test_look_alike_pairs(spark, awkward):
    rows = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "A b"), (5, None), (2, "a b"), (6, "а b")]
    got = normalize.look_alike_pairs(spark.createDataFrame(rows, "file_id long, content string"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 6), (2, 3), (2, 6), (3, 6)]
    assert [tuple(r) for r in normalize.look_alike_pairs(awkward).collect()] == [(2, 8)]
    assert normalize.look_alike_pairs(awkward.limit(0)).isEmpty()
    assert normalize.normalized(awkward).count() == awkward.count()


# -------------------------------------------------------------------- languages


def test_look_alikes_beside_many_copies(spark):
    rows = [(k, "") for k in range(20_000)] + [(50_000, "\u200b"), (50_001, "\u200b"), (50_002, "x"), (None, ""), (50_003, None)]
    df = spark.createDataFrame(rows, "file_id long, content string").repartition(4)
    assert normalize.look_alike_pairs(df).count() == 40_000
    got = {r.file_id: (r.class_id, r.string_id, r.n_links) for r in normalize.look_alike_classes(df).collect()}
    assert len(got) == 20_003 and got[3] == (0, 0, 2) and got[50_001] == (0, 50_000, 20_000) and got[50_002] == (50_002, 50_002, 0)


def test_languages(spark, common, awkward):
    de = "Der Brief ist nicht in der Mappe und das Bild ist die Skizze der Schule. Die Katze und das Haus sind nicht alt."
    docs = spark.createDataFrame([(k, prose(k, 6), "eng") for k in range(40)] + [(100 + k, f"{de} Das Blatt {k} und die Feder sind in der Lade.", "deu") for k in range(40)] + [(200, None, "eng"), (201, prose(1), None)], "doc_id long, text string, lang string")
    packs = spark.createDataFrame([("eng", "English", "en", "language"), ("deu", "German", "de", "language"), ("osd", "x", None, "detector")], "code string, name string, iso1 string, kind string")
    en = prose(900, 5)
    texts = spark.createDataFrame([(1, en), (2, en), (3, f"{en} {de} {en}"), (4, None), (5, ""), (6, de), (1, en), (7, en)], "file_id long, content string")
    files = spark.createDataFrame([(1, "eng"), (2, "de"), (3, "eng+deu"), (6, "ger"), (7, None)], "id long, lang string")
    got = language.segments(texts, files, packs, common, docs, wrong_only=True).collect()
    assert sorted((r.file_id, r.seg_no, r.lang) for r in got) == [(2, 1, "eng"), (3, 1, "eng"), (3, 2, "deu"), (3, 3, "eng"), (7, 1, "eng")]
    assert all(0 <= r.confidence <= 1 for r in got)
    # every content gets a language, and every prose text its segments, with a margin as confidence
    every = {r.file_id: r for r in language.languages(texts, files, packs, common, docs).collect()}
    assert {k: (r.lang, r.label_fits) for k, r in every.items()} == {1: ("eng", True), 2: ("eng", False), 3: ("eng+deu", True), 6: ("deu", True), 7: ("eng", None)}
    assert all(r.confidence >= language.MARGIN for r in every.values())
    assert language.segments(texts, files, packs, common, docs).select("file_id").distinct().count() == 5
    language.segments(awkward, files, packs, common, docs).collect()
    assert language.segments(texts, files, packs, common, docs.limit(0)).isEmpty() and language.segments(texts.limit(0), files, packs, common, docs).isEmpty()


def test_labels():
    names = {"eng": "eng", "en": "eng", "english": "eng", "deu": "deu", "de": "deu", "ger": "deu"}
    f = lambda x: language.languages_of_label(x, names)
    assert f("de_AT") == f("GER") == {"deu"} and f("deu+ENG") == {"deu", "eng"} and f("xyz") == {"xyz"}
    assert f(None) is f("") is f("und") is f("osd") is None


# -------------------------------------------------------------- near duplicates


def brute_pairs(rows, least=0.5):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", normalize.readable_form(t).lower()) if t else []
        if len(w) >= 30:
            sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def edited(text, seed, share):
    r = random.Random(seed)
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_similar_pairs_against_all_pairs(spark, monkeypatch):
    rows = [(1000 * g + k, edited(prose(g, 10), 1000 * g + k, 0.02 * k)) for g in range(1, 31) for k in range(8)]
    rows += [(99_001, prose(1, 10)), (99_002, prose(1, 10).upper()), (99_003, "short text"), (99_004, None), (99_001, prose(1, 10))]
    df = spark.createDataFrame(rows, "file_id long, content string").repartition(4)
    want = brute_pairs(dict(rows).items())
    got = {tuple(r) for r in neardup.similar_pairs(df).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 300
    groups, links = neardup.linked(df)
    g = {r.file_id: r for r in groups.collect()}
    assert all(g[a].group_id == g[b].group_id for a, b in got) and g[99_001].class_id == g[99_002].class_id and 99_003 not in g
    apart = {(r.class_id_a, r.class_id_b) for r in links.collect()}
    told = {(a, b) for a, b in itertools.combinations(sorted(g), 2) if g[a].class_id == g[b].class_id or set(g[a].balls) & set(g[b].balls) or tuple(sorted((g[a].class_id, g[b].class_id))) in apart}
    assert told == got
    assert neardup.similar_pairs(df.limit(0)).isEmpty()


def test_many_variants_of_one_text(spark):
    """A mass of variants costs a few rows a member, and loses no link."""
    body = prose(7, 14).split()
    rows = []
    for k in range(6000):
        r = random.Random(k)
        words = list(body)
        for _ in range(r.randint(1, 3)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    sig = list(neardup._signatures([pa.RecordBatch.from_pylist([{"i": k, "t": t} for k, t in rows])]))
    table = pa.Table.from_batches(list(neardup._roots([b.select(["_id", "_sig"]) for b in sig]))).sort_by([("_node", "ascending"), ("_id", "ascending")])
    out = pa.Table.from_batches(list(neardup._nodes(table.to_batches(max_chunksize=1000))))
    assert out.num_rows < 60 * len(rows)
    df = spark.createDataFrame(rows, "file_id long, content string").repartition(4)
    groups, links = neardup.linked(df)
    g = {r.file_id: set(r.balls) for r in groups.collect()}
    assert len(g) == len(rows)
    apart = {tuple(r)[:2] for r in links.collect()}
    assert len(apart) < 20 * len(rows)
    sets = {k: set(neardup.run_hashes(neardup.word_hashes(t)).tolist()) for k, t in rows}
    for a, b in (sorted(random.Random(n).sample(range(len(rows)), 2)) for n in range(3000)):
        near = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5
        assert near == (bool(g[a] & g[b]) or (a, b) in apart)


def test_wide_nodes_branch_over_rounds(spark):
    """Branching passed on between rounds gives the pairs of branching in memory."""
    rows = [(k, edited(prose(5 + k // 30, 10), k, 0.05)) for k in range(120)]
    sets = {k: set(neardup.run_hashes(neardup.word_hashes(t)).tolist()) for k, t in rows}
    sig = list(neardup._signatures([pa.RecordBatch.from_pylist([{"i": k, "t": t} for k, t in rows])]))
    one = list(neardup._roots([b.select(["_id", "_sig"]) for b in sig]))
    table = pa.Table.from_batches(one).sort_by([("_node", "ascending"), ("_id", "ascending")])

    def run(wide):
        neardup.WIDE, pairs, todo = wide, set(), table
        for _ in range(12):
            out = pa.Table.from_batches(list(neardup._nodes(todo.to_batches(max_chunksize=37)))) if todo.num_rows else None
            if out is None:
                break
            d = out.to_pylist()
            pairs |= {(r["_id"], r["_b"]) for r in d if r["_node"] is None and not r["_ball"]}
            balls: dict = {}
            for r in d:
                if r["_ball"]:
                    balls.setdefault(r["_id"], []).append(r["_b"])
            pairs |= {x for m in balls.values() for x in itertools.combinations(sorted(m), 2)}
            rest = [r for r in d if r["_node"] is not None]
            todo = out.filter(pyarrow.compute.is_valid(out["_node"])).sort_by([("_node", "ascending"), ("_id", "ascending")]) if rest else table.slice(0, 0)
        return {(a, b) for a, b in pairs if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}

    old = neardup.WIDE
    try:
        a, b = run(10**6), run(40)
    finally:
        neardup.WIDE = old
    assert len(a & b) >= 0.97 * len(a | b) > 100


def test_similar_pairs_awkward(awkward):
    assert {tuple(r) for r in neardup.similar_pairs(awkward).collect()} == {(4, 5)}


# ---------------------------------------------------------- personal information


def test_personal_information(spark, awkward):
    names = [(100 + k, f"Signed by Ivy Vantrupp in ink. Dear Ms Vantrupp, thanks. Write to Hugo Marnholt now. Ask Hugo Vantrupp about it. {prose(k, 1)}") for k in range(5)]
    text = "Ask Ivy\nMarnholt or call +44 20 7946 0114. Mail ivy.m [at] post[dot]example or h_m @ fern.test please. Order 2024-8331-0850 covers tea. Passport ZE8297891 was shown. Deliver to 56B Willowbank Street, 10940 Ellory. Die Lieferung geht an Hopfenstraße 201 in Au. Marnholt, Hugo came."
    disguised = "Ａｓｋ ​Іvy Vantruрp or mail i​vy@post.example."
    df = spark.createDataFrame([(1, text), (2, disguised), (1, text), *names], "file_id long, content string")
    got = {(r.file_id, r.kind, r.start_pos) for r in pii.found(df).filter("file_id < 100").collect()}
    at = text.index
    want = {("person_name", at("Ivy\n")), ("phone", at("+44")), ("email", at("ivy.m")), ("email", at("h_m")), ("id_number", at("ZE8")), ("street_address", at("56B")), ("street_address", at("Hopfen")), ("person_name", at("Marnholt, Hugo"))}
    assert {(k, s) for i, k, s in got if i == 1} == want
    assert ("email", disguised.index("i​vy")) in {(k, s) for i, k, s in got if i == 2}
    red = {r.file_id: r.redacted for r in pii.redacted(df.filter("file_id >= 1")).collect()}
    assert "[EMAIL]" in red[1] and "7946" not in red[1] and red[1].endswith("came.")
    assert pii.found(awkward).isEmpty() and pii.found(awkward.limit(0)).isEmpty()
    assert {r.redacted for r in pii.redacted(awkward).filter("file_id in (1, 2)").collect()} == {None, ""}


@pytest.fixture(scope="module")
def many_words(spark):
    """Two million words that stand once, more than a sketch of 3 x 2^20 cells keeps apart."""
    letters = [a + b for a in "bcdfghjklmnprstvwz" for b in "aeiou"]
    words = itertools.islice(map("".join, itertools.product(letters, repeat=4)), 2_000_000)
    texts = [(k, " ".join(itertools.islice(words, 5000))) for k in range(1000, 1400)]
    return spark.createDataFrame(texts, "file_id long, content string").repartition(4).cache()


def test_said_as_signs():
    f = pii.said_as_signs
    for text, want in (("mail ivy at home dot org", "mail ivy@home.org"), ("jo (at) x [dot] y.com", "jo@x.y.com"), ("a @ b.org", "a@b.org"), ("look at the dot", "look at the dot"), ("call zero double seven 0 nine one two three", "call 077091 2 3".replace(" 2 3", "23")), ("one two cats", "one two cats"), ("0 7 7 0 9 1 2 x", "0770912 x")):
        out, source = f(text)
        assert out == want
        assert source is None or len(source) == len(out) and source == sorted(source) and all(text[p] == c for p, c in zip(source, out) if c.isalpha())


def test_spelled_numbers_are_found(spark):
    texts = ["", "Call me on zero seven seven zero nine one two three four five six.", "+44 seven seven zero nine 123456", "phone 0 7 7 0 9 1 2 3 4 5 6", "rufen Sie null drei null zwei zwei null acht neun eins", "We saw one, two and three cats."]
    got = sorted((r.file_id, r.kind, r.start_pos) for r in pii.found(spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")).collect())
    assert got == [(1, "phone", 11), (2, "phone", 0), (3, "phone", 6), (4, "phone", 10)]


def test_names_among_many_words(spark, many_words):
    names = spark.createDataFrame([(k, "Signed by Ivy Vantrupp in ink.") for k in range(5)], "file_id long, content string")
    df = many_words.unionByName(names)
    got = sorted((r.file_id, r.kind, r.start_pos) for r in pii.found(df).collect())
    assert got == [(k, "person_name", 10) for k in range(5)]
    assert pii.redacted(df).join(many_words.withColumnRenamed("content", "c"), "file_id").filter("redacted != c").isEmpty()


# ------------------------------------------------------------------------ scans


def test_vocabulary_of_many_words(spark, many_words, common):
    more = [(k, "Box lamp lamp, old-fashioned") for k in range(3)] + [(9, "box Box")]
    df = many_words.unionByName(spark.createDataFrame(more, "file_id long, content string"))
    counts = {r.low: r.df for r in scans.Corpus(df, common, "file_id", "content").words.collect()}
    assert [counts.get(w, 0) for w in ("lamp", "box", "old-fashioned", "old", "oldfashioned")] == [3, 4, 3, 3, 0]
    assert {counts[w] for w in many_words.filter("file_id = 1000").first().content.split()} == {1}


def test_readings():
    cost = scans.reading_cost
    assert [cost(*x) for x in (("gr4ph", "graph"), ("rnuseum", "museum"), ("ficatc", "ficate"), ("clrawing", "drawing"), ("bencli", "bench"), ("5urveyor", "surveyor"), ("l0cI", "loci"))] == [(1, 0), (0, 1), (0, 1), (0, 1), (0, 1), (1, 0), (1, 0)]
    assert cost("graph", "graph") is None and cost("eeee", "cccc") is None and cost("cat", "dog") is None and cost("mm", "rnrn") == (0, 2)
    assert cost("0" * 30 + "x", "o" * 30 + "x") == (30, 0)  # any length, any number of digits
    assert all(scans._strokes(a) == scans._strokes(b) for a, b in (("gr4ph", "graph"), ("rnuseum", "museum"), ("clrawing", "drawing"), ("bencli", "bench"), ("8all", "ball"), ("6ox", "Gox")))
    assert [scans.may_be_misread(w) for w in ("12b", "LI8", "1987", "lamp", "ABC", "x", "l4mp")] == [False, False, False, True, False, False, True]


def test_scan_noise(spark, common, awkward):
    body = [(k, prose(k, 8) + " an old-fashioned drawing") for k in range(60)]
    page = "Storage Handbook      12\nThe librarian put the photo-\ngraph in the museum and it was not for the old-\nfashioned surveyor in the libr4ry of the\n— 12 —\n\x0cSt0rage Handbook      13\nschool and the apprentice put the postcard in the archive and\nit was not for the caretaker.\n13"
    df = spark.createDataFrame([*body, (100, page), (101, "a\nb\n1\n2"), (100, page)], "file_id long, content string")
    got = sorted((r.line_no, r.kind) for r in scans.noise(df, common).filter("file_id = 100").collect())
    assert got == [(1, "running_header"), (2, "hyphen_break"), (4, "misread"), (5, "page_number"), (6, "running_header"), (9, "page_number")]
    fixed = {r.file_id: r.repaired for r in scans.repaired(df, common).filter("file_id = 100").collect()}[100]
    assert "photograph" in fixed and "old-fashioned" in fixed and "Handbook" not in fixed and "\n" not in fixed
    assert scans.noise(awkward, common).isEmpty() and scans.noise(awkward.limit(0), common).isEmpty()
    assert scans.repaired(awkward, common).filter("file_id = 1").first().repaired is None


def test_misread_words_are_repaired(spark, common):
    body = [(k, prose(k, 8) + " We saw a photograph and an old-fashioned drawing.") for k in range(60)]
    page = "7he librarian put the photo-\ngr4ph in the rnuseum, and the 5urveyor put the LI8-12 and the certi-\nficatc in\nroom 12b in 1987. 5he put the clrawing in the gardcn."
    rows = [*body, (100, page), (101, "It was in the garden and the harbour-\nmuseum was not for the librarian.")]
    df = spark.createDataFrame(rows, "file_id long, content string")
    fixed = {r.file_id: r.repaired for r in scans.repaired(df, common).filter("file_id >= 100").collect()}
    assert fixed[100] == "The librarian put the photograph in the museum, and the surveyor put the LI8-12 and the certificate in room 12b in 1987. 5he put the drawing in the garden."
    # a break that noise() takes for a compound's own hyphen stays
    assert "harbour-museum" in fixed[101] and "hyphen_break" not in {r.kind for r in scans.noise(df, common).filter("file_id = 101").collect()}


# ---------------------------------------------------------------------- quality


def test_kinds(spark, common, awkward):
    rows = [(k, prose(k)) for k in range(80)]
    rows += [(100, "Menu\n" + "\n".join(f"{k} x {w}" for k, w in enumerate(THINGS))), (101, "\n".join(f"{w}\t{k}\tpaid\t{k * 3}.50" for k, w in enumerate(THINGS))), (102, "xq zzrk vvb| ~~ qwrtp ll' mnbv\n}} kjhg [| trwq pplk xx zz\n%% bvcx"), (103, prose(1).replace(". ", ".\n"))]
    df = spark.createDataFrame(rows, "file_id long, content string")
    assert {(r.file_id, r.kind) for r in quality.not_prose(df, common).collect()} == {(100, "list"), (101, "table"), (102, "junk")}
    assert quality.not_prose(awkward.limit(0), common).isEmpty()
    assert quality.statistics_table(awkward, common).filter("file_id in (1, 2, 3)").isEmpty()


def test_sketch_quantiles(spark):
    x = np.random.default_rng(1).random(5000)
    stats = spark.createDataFrame([("eng", [float(v)] * len(quality.STATS)) for v in x], "lang string, stats array<float>")
    s = quality.sketches(stats)["eng"]
    at = quality.NAMES.index("odd_words")
    for q in (0.25, 0.5, 0.9):
        assert abs(quality.quantile(s, q)[at] - np.quantile(x, q)) <= 1.5 / quality.GRID


# ------------------------------------------------------------------- tokenizing


def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokenizer.PRE_SPLIT, mergeable_ranks=tokenizer.read_ranks(VOCAB), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdeinrst '\n", max_size=80))
def test_ids_agree_with_the_library(t):
    enc = tokenizer.encoder(VOCAB)
    ids = enc.ids(t).tolist()
    assert ids == library().encode_ordinary(t)
    assert enc.decode(ids) == t and enc.count(t) == len(ids)


def test_token_tables(spark):
    long = "lorem 12 – été " * 20_000
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "<|endoftext|>", None), (4, long, "c"), (5, "a" * 30_000, "d"), (None, "x", "e")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenizer.token_ids(df).collect()}
    lib = library()
    assert got[1] is None and got[2] == [] and got[3] == lib.encode_ordinary("<|endoftext|>") and got[4] == lib.encode_ordinary(long) and got[5] == lib.encode_ordinary("a" * 30_000)
    back = {r.doc_id: r.text for r in tokenizer.decoded(tokenizer.token_ids(df)).collect()}
    assert back[4] == long and back[1] is None
    assert tokenizer.token_ids(df.limit(0)).isEmpty()


# ---------------------------------------------------------------------- packing


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 200), st.integers(1, 60), max_size=40), st.sampled_from([200, 512, 1000]))
def test_plan_places_every_item(counts, capacity):
    left = dict(counts)
    for want, m in packing.plan(counts, capacity):
        assert m > 0 and sum(s * q for s, q in want.items()) <= capacity
        for s, q in want.items():
            left[s] -= q * m
    assert not any(left.values())


def test_packed(spark):
    r = random.Random(2)
    sizes = [(k, r.randint(1, 400)) for k in range(3000)] + [(5000, 1300), (5001, 0), (5002, None), (None, 7), (5003, 512), (1, 3)]
    sizes += [(10_000 + k, 77) for k in range(2000)]  # one length holds two fifths of the rows
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes], "doc_id long, n_tokens long, container string")
    caps = spark.createDataFrame([(1, "s", 512), (2, "l", 2048), (3, "none", None), (4, "zero", 0)], "capacity_id long, name string, capacity long")
    got = packing.packed(df, caps).collect()
    want = {}
    for k, n in sizes:
        if k is not None and n:
            want[k] = max(want.get(k, 0), n)
    for cap_id, cap in ((1, 512), (2, 2048)):
        rows = [x for x in got if x.capacity_id == cap_id]
        load, total = {}, {}
        for x in rows:
            load[x.container] = load.get(x.container, 0) + x.n_tokens
            total[x.doc_id] = total.get(x.doc_id, 0) + x.n_tokens
            assert x.part == 0 or want[x.doc_id] > cap
        assert total == want and max(load.values()) <= cap
        # not worse than first fit decreasing, item by item
        room: list[int] = []
        for n in sorted((min(cap, n - i) for n in want.values() for i in range(0, n, cap)), reverse=True):
            k = next((k for k, x in enumerate(room) if x >= n), None)
            if k is None:
                room.append(cap - n)
            else:
                room[k] -= n
        assert len(load) <= len(room)
    assert {x.capacity_id for x in got} == {1, 2} and packing.packed(df.limit(0), caps).isEmpty() and packing.packed(df, caps.limit(0)).isEmpty()


# ---------------------------------------------------------------- reading level


def level_text(level, seed):
    r = random.Random(f"{level}{seed}")
    if level == "easy":
        return " ".join(f"The {r.choice(['cat', 'dog', 'girl'])} {r.choice(['is', 'was'])} in the {r.choice(['sun', 'mud', 'bed'])}." for _ in range(12))
    if level == "hard":
        return " ".join(f"Notwithstanding the {r.choice(['asymptotic', 'stochastic', 'hermeneutic'])} {r.choice(['regularisation', 'indeterminacy', 'heteroscedasticity'])} of the covariance, which is that of the parametrisation, the {r.choice(['attenuation', 'eigenstructure'])} is not invalidated by it." for _ in range(6))
    return prose(seed, 6)


def test_levels_on_held_out_documents(spark, common, awkward):
    docs = [(k, level_text(lv, k), lv) for k, lv in enumerate(["easy", "middle", "hard"] * 60)] + [(900, None, ""), (901, "", ""), (902, "Der Brief ist nicht in der Mappe und das Bild ist die Skizze. " * 5, ""), (903, "Menu\n4 x tea\n5 x milk\n6 x bread", "")]
    df = spark.createDataFrame([(k, t, 1.0) for k, t, _ in docs], "doc_id long, text string, level double")
    graded = spark.createDataFrame([(k, "a", lv) for k, _, lv in docs[:90]] + [(0, "b", "middle"), (1, "b", None), (None, "b", "hard"), (4000, "b", "easy")], "doc_id long, annotator string, level string")
    got = {r.doc_id: r.level for r in reading.levels(df, graded, common).collect()}
    held = [(got[k], lv) for k, _, lv in docs[90:180]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and not {900, 901, 902, 903} & set(got)
    assert reading.levels(df, graded.limit(0), common).isEmpty() and reading.levels(df.limit(0), graded, common).isEmpty()


def test_registry_names():
    from pageloom.llm import registry

    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6, 7, 10)} | {"p8_ids", "p9_packed"} <= set(registry.queries()) and registry.oracle_sql().keys() <= registry.queries().keys()
