"""Noise in text from scanned pages: found line by line, and repaired into paragraphs.

Running headers and footers are lines at page edges that come again, give or take a page number and misread letters.
Page numbers are lines with nothing else. A line that ends in a hyphen is joined to the next line of running text by the
corpus vocabulary: the two parts make a word that the corpus writes together, unless it writes them with a hyphen. A word is
misread if putting back letters of similar shape turns a string that the corpus hardly knows into a frequent word.

The vocabulary is a table, however large: the number of texts of each word, exact. Misread words are told by joining it with
itself on the strokes of a word (``_strokes``: all readings of a word have the same), so that no reading has to be guessed, and
line ends by joining their parts with it. Texts are read where they lie. A first pass gives the words and all that a text
tells alone; a second pass gives the places of words that may be misread, by a filter of fixed size, and a join says which are.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .normalize import readable_form
from ..plans.runtime import cut
from .quality import Scale, _matrix, _Words, language_words, sketches, split_at, statistics
from .sketch import Filter, filter_of, signed_key

_COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)+")
_RUN = re.compile(r"[^\W_]+")
#: ASCII characters as they are if letters or digits, else as blanks; other characters that are neither.
_ALNUM = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_ALNUM_HYPHEN = _ALNUM[:45] + b"-" + _ALNUM[46:]
_NO_ALNUM = re.compile(r"[^\x00-\x7f\w]")
_HYPHENED = re.compile(r"(?:[^\W_]|-)+")
_HYPHENS = "-‐¬­"
_BROKEN = re.compile(rf"[{_HYPHENS}][ \r\t]*\n")
_UNPLAIN = (" \n", "\r\n", "\t\n", *_HYPHENS[1:])
#: Letters and digits that stand for others of similar shape, as printed to what was meant (fixed values).
DIGIT_SHAPES = {"0": "oO", "1": "liI", "2": "zZ", "3": "e", "4": "aA", "5": "sS", "6": "bG", "7": "tT", "8": "bB", "9": "gq"}
LETTER_SHAPES = {"rn": "m", "cl": "d", "ii": "u", "vv": "w", "c": "e", "e": "c", "m": "rn", "d": "cl", "I": "l", "l": "I", "li": "h", "O": "0", "|": "l"}
#: Strokes of letters and digits: what can be taken for one another comes out equal.
_STROKE = str.maketrans({"0": "o", "1": "l", "2": "z", "3": "c", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "b", "g": "b", "q": "b", "e": "c", "i": "l", "|": "l", "m": "rn", "d": "cl", "u": "ll", "h": "ll", "w": "vv"})
#: Lines at the top and bottom of a page among which headers and footers are looked for.
TOP, BOTTOM = 2, 3
_NUM = r"(?:\d[\dlIOoSB|]{0,3}|[lI|][\dlIOoSB|]{1,3}|[lI])"
_ROMAN = r"(?:m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3}))"
_PAGE_MARKED = re.compile(
    rf"^(?:[-–—~*=]+ ?{_NUM} ?[-–—~*=]+|[\[(<]{_NUM}[\])>]|(?:p|pp|pg|s|str|pag|pág|стр)\. ?{_NUM}|{_NUM} ?/ ?{_NUM}"
    rf"|(?:[Pp]a[g9]e|[Ss]eite|[Pp][aá]gina|[Ss]tranica|[Сс]траница) {_NUM}(?: ?(?:of|0f|von|de|di|od|из|/) ?{_NUM})?)$"
)
_PAGE_BARE = re.compile(rf"^(?:{_NUM}|{_ROMAN})$", re.I)
_EDGE_NUMBER = re.compile(rf"^{_NUM}\s{{2,}}|\s{{2,}}{_NUM}$|^{_ROMAN}\s{{2,}}|\s{{2,}}{_ROMAN}$", re.I)
_FOLD = bytes.maketrans(b"1i|0579q68e243", b"lllostggbbczac")


def _strokes(word: str) -> str:
    return word.lower().translate(_STROKE)


@lru_cache(100_000)
def reading_cost(word: str, target: str) -> tuple[int, int] | None:
    """(digits, letters) put back to read ``word`` as ``target`` (lower case), letters at most two; None if it can't be.

    A digit may stand for one of its letters; a letter or pair for one of similar shape (``LETTER_SHAPES``)."""
    n, m = len(word), len(target)
    best: dict[tuple[int, int], tuple[int, int]] = {(0, 0): (0, 0)}  # places reached: fewest letters, then digits
    for i in range(n):
        for (a, j), (letters, digits) in [x for x in best.items() if x[0][0] == i]:
            steps = []
            if j < m and word[i].lower() == target[j]:
                steps.append((1, 1, 0, 0))
            if word[i] in DIGIT_SHAPES and j < m and target[j] in DIGIT_SHAPES[word[i]].lower():
                steps.append((1, 1, 0, 1))
            for k in (2, 1):
                to = LETTER_SHAPES.get(word[i : i + k])
                if to and i + k <= n and target.startswith(to.lower(), j):
                    steps.append((k, len(to), 1, 0))
            for di, dj, dl, dd in steps:
                key, cost = (i + di, j + dj), (letters + dl, digits + dd)
                if cost[0] <= 2 and cost < best.get(key, (9, 0)):
                    best[key] = cost
    end = best.get((n, m))
    return (end[1], end[0]) if end and sum(end) else None


def may_be_misread(word: str) -> bool:
    """False for codes, house numbers, ordinals and the like, by the form of the word alone."""
    if len(word) < 2 or word.isdigit():
        return False
    digits = 0 if word.isalpha() else sum([c.isdigit() for c in word])
    if not digits:
        return len(word) > 2 and not (word.isupper() and len(word) < 5)
    small = sum([c.islower() for c in word])
    return small > 0 and not (small < digits and len(word) > 3) and not (re.fullmatch(r"\d+[a-z]{1,2}", word) and small < 2)


def runs(form: str) -> list[str]:
    """What ``_RUN`` finds."""
    return split_at(form, _ALNUM, _NO_ALNUM, _RUN)


def counted_words(form: str) -> tuple[set[str], set[str]]:
    """(words that count the text, other spellings in it) of a readable form. Of the spellings of a word that differ in case
    one counts, the one in lower case where there is one; compounds count whole, in lower case, beside their parts."""
    count, other, seen = set(split_at(form, _ALNUM_HYPHEN, _NO_ALNUM, _HYPHENED)), set(), set()
    hyphened = [w for w in count if "-" in w] if "-" in form else ()
    count.difference_update(hyphened)
    for w in hyphened:
        count.update(_RUN.findall(w))
    for w in list(filterfalse(str.islower, count)):
        x = w.lower()
        if x != w:
            if x in count or x in seen:
                other.add(w)
            seen.add(x)
    count -= other
    for w in hyphened:
        count.update([x.lower() for x in _COMPOUND.findall(w)])
    return count, other


def _shapes(lines: list[str]) -> list[str]:
    """Each line in letters of one shape each, white space inside as one blank and none at the ends. No shape takes in the end
    of a line, so that all are read at once."""
    s = "\n".join(lines).lower().replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u").replace("li", "h")
    s = s.encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass")
    out = s.split("\n")
    # of white space, only the blank can be printed
    return [x.strip() for x in out] if "  " not in s and "".join(out).isprintable() else [" ".join(x.split()) for x in out]


def _near(a: str, b: str) -> bool:
    """Few letters differ: an eighth of them in place, or one short stretch."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 3 or not n or not m:
        return False
    if n == m:
        return sum(map(str.__ne__, a, b)) * 8 <= n
    k = 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    e = 0
    while e < min(n, m) - k and a[-1 - e] == b[-1 - e]:
        e += 1
    return (max(n, m) - k - e) * 5 <= max(n, m)


def may_break(text: str) -> bool:
    """True where ``_BROKEN`` finds a line that ends in a hyphen."""
    if "-\n" in text:
        return True
    # a blank before the end of a line, or a hyphen that isn't ASCII
    return any([x in text for x in _UNPLAIN]) and _BROKEN.search(text) is not None


class Reader:
    """What one text tells alone of its noise."""

    def broken(self, line: str, following: str) -> tuple[str, str, bool] | None:
        """(left part, right part, hard hyphen) of the word at the line end, where ``line`` ends in a hyphen inside a word;
        ``following`` is the next line of running text in readable form."""
        raw = line.rstrip(" \r\t")
        if raw[-1:] not in _HYPHENS or not raw[-2:-1].isalpha():
            return None
        left = re.search(r"[^\W_]+(?:-[^\W_]+)*$", readable_form(raw.rstrip(_HYPHENS)))
        right = re.match(r"\s*([^\W\d_][^\W_]*)", following.lstrip("\f"))
        if not left or not right or not right.group(1)[0].islower():
            return None
        return left.group(), right.group(1), raw[-1] == "-"

    def edges(self, lines: list[str]) -> tuple[set[int], set[int]]:
        """Line indexes of running headers or footers, and of page numbers."""
        bare = [x.strip(" \f\r\t") for x in lines]
        solid = [i for i, x in enumerate(bare) if x]
        if not solid:
            return set(), set()
        brief = [i for i in solid if len(bare[i]) <= 24]  # none of the patterns takes more
        numbers = {i for i in brief if _PAGE_MARKED.match(bare[i])}
        maybe = {i for i in brief if i not in numbers and _PAGE_BARE.match(bare[i])}
        headers: set[int] = set()
        at = dict(zip(solid, range(len(solid))))
        if len(solid) > 3:  # two lines of one header have two more between them
            # lines at page edges: next to a form feed, a page number or an end of the text
            edge = set(solid[:TOP]) | set(solid[-BOTTOM:])
            for i in [i for i in solid if "\f" in lines[i]]:
                edge.update(solid[max(0, at[i] - BOTTOM) : at[i] + TOP])
            for i in numbers | maybe:
                edge.update(solid[max(0, at[i] - TOP) : at[i] + BOTTOM])
            # lines that begin or end as an edge line does, but for the shapes of letters, are folded and compared
            # alike lines are about as long: an eighth apart, page numbers aside
            sizes: set[int] = set()
            for n in {len(bare[i]) for i in edge}:
                sizes.update(range(n - 8 - n // 8, n + 9 + n // 8))
            some = {i: x for i in solid if len(x := bare[i]) in sizes and i not in numbers}
            for i in [i for i, x in some.items() if "  " in x]:
                some[i] = _EDGE_NUMBER.sub("", some[i]).strip()  # page numbers aside
            tips = _shapes([x[:9] for x in some.values()] + [x[-9:] for x in some.values()])
            first, last = [x[:4] for x in tips[: len(some)]], [x[-4:] for x in tips[len(some) :]]
            own: dict[int, tuple[str, str]] = {}
            starts: dict[str, list[int]] = {}
            ends: dict[str, list[int]] = {}
            if len(set(first)) < len(first) or len(set(last)) < len(last):  # else no line is like another
                own = dict(zip(some, zip(first, last)))
                for i, (a, b) in own.items():
                    starts.setdefault(a, []).append(i)
                    ends.setdefault(b, []).append(i)
            folded: dict[int, str] = {}
            for i in edge:
                if i in headers or i not in own:
                    continue
                begun, ended = starts[own[i][0]], ends[own[i][1]]
                # lines by number; of those, some line has to be further away than the next two
                if max(at[begun[-1]], at[ended[-1]]) - at[i] < 3 and at[i] - min(at[begun[0]], at[ended[0]]) < 3:
                    continue
                near = {*begun, *ended}
                new = [j for j in near if j not in folded]
                if new:
                    folded.update(zip(new, _shapes([some[j] for j in new])))
                f = folded[i]
                if len(f) < 4 or not any(map(str.isalpha, f)):
                    continue
                same = [j for j in near if _near(f, folded[j])]
                # not two lines of one stretch of prose
                if len(same) > 1 and max(abs(at[j] - at[i]) for j in same) > 2 and sum(bare[j][-1] in ".,;" for j in same) * 2 < len(same):
                    headers.update(same)
        for i in maybe - headers:
            k = at[i]
            blank = (i > 0 and not bare[i - 1]) or (i + 1 < len(lines) and not bare[i + 1])
            by = (k > 0 and solid[k - 1] in headers) or (k + 1 < len(solid) and solid[k + 1] in headers)
            feed = "\f" in lines[i][:1] or (i + 1 < len(lines) and "\f" in lines[i + 1][:1])
            if k == 0 or k == len(solid) - 1 or blank or by or feed:
                numbers.add(i)
        return headers, numbers - headers

    def line_ends(self, text: str, form: str, lines: list[str], dropped: set[int]) -> dict[int, tuple[str, str, bool]]:
        """``broken`` of every line index where it holds, among the lines of running text."""
        if not may_break(text):
            return {}
        running = [i for i, x in enumerate(lines) if i not in dropped and x.strip(" \f\r\t")]
        clean = form.split("\n")  # nothing in it adds or removes a newline
        return {i: x for i, j in zip(running, running[1:]) if lines[i].rstrip(" \r\t")[-1:] in _HYPHENS and (x := self.broken(lines[i], clean[j]))}

    def words_by_line(self, form: str, dropped: set[int], ends: dict[int, tuple[str, str, bool]]):
        """(line index, words) of running text; halves of words at line ends stand as one word in the first of their lines."""
        half = False
        for i, x in enumerate(form.split("\n")):
            if i in dropped or not x.strip(" \f\r\t"):
                continue
            words = runs(x)
            bare = x.rstrip()
            if words and half:
                words.pop(0)
            half = bare[-1:] in _HYPHENS and bare[-2:-1].isalpha()
            if i in ends:
                if words:
                    words.pop()
                words.append(ends[i][0].split("-")[-1] + ends[i][1])
            yield i, words


_KIND = pa.struct([("line", pa.int32()), ("kind", pa.string())])
_END = pa.struct([("line", pa.int32()), ("head", pa.string()), ("tail", pa.string()), ("hard", pa.bool_())])


class Corpus:
    """What the texts of a table tell together: the vocabulary, the misread words and the texts that are prose.

    ``texts``  (_id, lang, stats, fixed array<(line, kind)>, ends array<(line, head, tail, hard)>): one row a content;
    ``words``  (low, df): number of texts by word in lower case;
    ``misread`` (word, meant, capital): what was meant by a spelling that is misread, and whether most texts write it with a
    capital only. All are tables, materialised; only ``scale`` and the filter of misread words are sent to tasks.
    """

    def __init__(self, docs: DataFrame, common_words: DataFrame, key: str, text: str):
        self.key, self.text, self.kind = key, text, dict(docs.dtypes)[key]
        common = language_words(common_words)
        schema = f"_id {self.kind}, lang string, stats array<float>, fixed array<struct<line:int,kind:string>>, ends array<struct<line:int,head:string,tail:string,hard:boolean>>, word string, low string, n bigint"
        names = ["_id", "lang", "stats", "fixed", "ends", "word", "low", "n"]
        shapes = [pa.string(), pa.list_(pa.float32()), pa.list_(_KIND), pa.list_(_END), pa.string(), pa.string(), pa.int64()]

        def run(batches):
            reader, known, counts = Reader(), _Words(common), Counter()
            first = None

            def batch(kind, rows, counted):
                n, m = len(rows), len(counted)
                cols = list(zip(*rows)) if rows else [[]] * 5
                more = list(counted), map(str.lower, counted), counted.values()
                arrays = [list(c) + [None] * m for c in cols] + [[None] * n + list(c) for c in more]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(arrays, [kind, *shapes])], names=names)

            for b in batches:
                out, first = [], b.schema.field(0).type
                for i, t in zip(*(c.to_pylist() for c in b.columns)):
                    if i is None or not t or t.isspace():
                        continue
                    form = readable_form(t)
                    lines = t.split("\n")
                    headers, numbers = reader.edges(lines)
                    ends = reader.line_ends(t, form, lines, headers | numbers)
                    lang, s = statistics(t, known, form)
                    fixed = [{"line": k, "kind": "running_header"} for k in sorted(headers)] + [{"line": k, "kind": "page_number"} for k in sorted(numbers)]
                    out.append((i, lang, s, fixed, [{"line": k, "head": h, "tail": x, "hard": y} for k, (h, x, y) in ends.items()]))
                    count, other = counted_words(form)
                    counts.update(count)
                    for w in other:
                        counts.setdefault(w, 0)
                    for h, x, _ in ends.values():
                        counts.setdefault(h.split("-")[-1] + x, 0)
                drain = len(counts) > 500_000
                yield batch(first, out, counts if drain else {})
                if drain:
                    counts.clear()
            if counts:
                yield batch(first, [], counts)

        both = cut(docs.select(key, text).mapInArrow(run, schema))
        self.texts = both.filter("_id is not null").select("_id", "lang", "stats", "fixed", "ends").dropDuplicates(["_id"])
        # a repeated row counts its words as often as it stands
        # one shuffle by ``low`` serves both counts
        spellings = both.filter("word is not null").repartition("low").groupBy("word", "low").agg(F.sum("n").alias("n"))
        of = Window.partitionBy("low").orderBy("word")
        df = F.sum("n").over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        spellings = cut(spellings.select("word", "low", "n", df.alias("df"), (F.row_number().over(of) == 1).alias("first")))
        self.words = spellings.filter("first").select("low", "df")
        self.scale = Scale(sketches(self.texts))
        self.misread = cut(self._misread(spellings))

    def _misread(self, spellings: DataFrame) -> DataFrame:
        def stroked(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_strokes(w) for w in b.column(0).to_pylist()], pa.string())], names=[*b.schema.names, "strokes"])

        form = lambda rows, fields: rows.mapInArrow(stroked, fields)
        targets = form(self.words.filter("df >= 3"), "low string, df bigint, strokes string").filter(~F.col("low").rlike("[0-9-]")).select(F.col("low").alias("target"), F.col("df").alias("have"), "strokes")

        def suspects(batches):
            for b in batches:
                words = b.column(0).to_pylist()
                keep = [i for i, w in enumerate(words) if "-" not in w and may_be_misread(w)]
                yield b.take(pa.array(keep, pa.int64()))

        own = spellings.select("word", "low", "df").mapInArrow(suspects, "word string, low string, df bigint")
        pairs = form(own, "word string, low string, df bigint, strokes string").join(targets, "strokes").filter("target <> low and have >= 5 * df")

        def judged(batches):
            for b in batches:
                words, own_df, target, have = (b.column(k).to_pylist() for k in range(4))
                keep, plain = [], []
                for i, (w, o, t, h) in enumerate(zip(words, own_df, target, have)):
                    cost = reading_cost(w, t)
                    if cost is None:
                        continue
                    digits, letters = cost
                    # digits alone are plain evidence; letters need a word that is far more frequent
                    if h >= (3 if not letters else 10) and h >= (5 if digits else 20) * o:
                        keep.append(i)
                        plain.append(int(digits > 0 and not letters))
                rows = b.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(plain, pa.int32())], names=["word", "target", "have", "plain"])

        found = pairs.select("word", "df", "target", "have").mapInArrow(judged, "word string, target string, have bigint, plain int")
        best = found.groupBy("word").agg(F.max(F.struct("plain", "have", "target")).alias("b")).select("word", F.col("b.target").alias("meant"), F.col("b.have").alias("have"))
        # spellings that begin with a capital stand for the texts that have the word in no other way
        capitals = spellings.filter("word = initcap(low) and word <> low").select(F.col("low").alias("meant"), F.col("n").alias("_n"))
        return best.join(capitals, "meant", "left").select("word", "meant", (F.coalesce("_n", F.lit(0)) * 2 > F.col("have")).alias("capital"))

    def filter(self) -> Filter:
        keys = self.misread.select("word").mapInArrow(_keys, "key long")
        return filter_of(keys)

    def prose(self) -> DataFrame:
        """``texts`` of prose."""
        scale = self.scale

        def run(batches):
            for b in batches:
                kinds = scale.kinds(b.column(1).to_pylist(), _matrix(b.column(2)))
                keep = b.filter(pa.array(kinds == "prose"))
                yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(3), keep.column(4)], names=["_id", "fixed", "ends"])

        return self.texts.mapInArrow(run, f"_id {self.kind}, fixed array<struct<line:int,kind:string>>, ends array<struct<line:int,head:string,tail:string,hard:boolean>>")

    def joints(self, prose: DataFrame) -> DataFrame:
        """(_id, line, joint): the line ends of prose, and whether the parts about them are one word.

        The word written together decides against the one with a hyphen; where the corpus has neither, two parts that are
        words themselves (in five texts each) keep a hyphen that is drawn as one.
        """
        e = prose.select("_id", F.explode("ends").alias("e")).select("_id", F.col("e.line").alias("line"), F.lower("e.head").alias("h"), F.lower("e.tail").alias("t"), F.col("e.hard").alias("hard"))
        asked = {"w": F.concat("h", "t"), "c": F.concat("h", F.lit("-"), "t"), "a": F.substring_index("h", "-", -1), "b": F.col("t")}
        rows = e.select("_id", "line", "hard", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), c.alias("low")) for k, c in asked.items()])).alias("q")).select("_id", "line", "hard", "q.*")
        df = {k: F.coalesce(F.max(F.when(F.col("role") == k, F.col("df"))), F.lit(0)) for k in asked}
        got = rows.join(self.words, "low", "left").groupBy("_id", "line", "hard").agg(*[c.alias(k) for k, c in df.items()])
        known = (F.col("w") > 0) | (F.col("c") > 0)
        return got.select("_id", "line", F.when(known, F.col("w") >= F.col("c")).otherwise(~((F.col("a") >= 5) & (F.col("b") >= 5) & F.col("hard"))).alias("joint"))


def _keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([signed_key(w) for w in b.column(0).to_pylist()], pa.int64())], names=["key"])


class _Suspects:
    """The words that may be misread by the filter; what is known is kept per worker and emptied when large."""

    def __init__(self, held: Filter):
        self.held, self.known, self.wrong = held, set(), set()

    def among(self, words: list[str]) -> set[str]:
        new = set(filterfalse(self.known.__contains__, words))
        if new:
            if len(self.known) > 500_000:
                self.known, self.wrong, new = set(), set(), set(words)
            self.known |= new
            self.wrong.update([w for w in new if may_be_misread(w) and self.held.may_hold(signed_key(w) & ((1 << 64) - 1))])
        return self.wrong.intersection(words)


def _places(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(_id, line, word): words of running text that the filter of misread words holds, once a line."""
    held = docs.sparkSession.sparkContext.broadcast(corpus.filter())  # of fixed size

    def run(batches):
        reader, suspect = Reader(), _Suspects(held.value)
        for b in batches:
            ids, at, words = [], [], []
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                if i is None or not t or t.isspace():
                    continue
                form = readable_form(t)
                wrong = suspect.among(runs(form))
                broken = may_break(t)
                if not wrong and not broken:
                    continue
                lines = t.split("\n")
                headers, numbers = reader.edges(lines)
                dropped = headers | numbers
                ends = reader.line_ends(t, form, lines, dropped) if broken else {}
                if broken:  # also of words that stand in two lines
                    wrong |= suspect.among([h.split("-")[-1] + x for h, x, _ in ends.values()])
                    if not wrong:
                        continue
                for k, ws in reader.words_by_line(form, dropped, ends):
                    for w in wrong.intersection(ws):
                        ids.append(i)
                        at.append(k)
                        words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(at, pa.int32()), pa.array(words, pa.string())], names=["_id", "line", "word"])

    return docs.select(corpus.key, corpus.text).mapInArrow(run, f"_id {corpus.kind}, line int, word string").distinct()


def noise(docs: DataFrame, common_words: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, line_no, kind): noise by line, of texts that are prose. Null, empty and blank texts have none; repeated rows
    count once; lines are split at newlines only."""
    corpus = Corpus(docs, common_words, key, text)
    prose = cut(corpus.prose())
    fixed = prose.select("_id", F.explode("fixed").alias("f")).select("_id", "f.line", "f.kind")
    breaks = corpus.joints(prose).filter("joint").select("_id", "line", F.lit("hyphen_break").alias("kind"))
    wrong = _places(docs, corpus).join(corpus.misread.select("word"), "word", "left_semi").select("_id", "line", F.lit("misread").alias("kind"))
    wrong = wrong.join(prose.select("_id"), "_id", "left_semi")
    return fixed.unionByName(breaks).unionByName(wrong).select(F.col("_id").alias(key), (F.col("line") + 1).cast("long").alias("line_no"), "kind").distinct()


_TAKE = pa.struct([("word", pa.string()), ("meant", pa.string()), ("capital", pa.bool_())])


def put_right(word: str, meant: str, capital: bool, first: bool) -> str:
    """``meant`` in the case of ``word``: letters put back follow those beside them; one at the start of the word is a capital at
    the start of a sentence (``first``) or where most texts write the word with one."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(map(str.isupper, letters)):
        return meant.upper()
    upper = word[0].isupper() and word[0] not in "I" or word[0] in "I0123456789|" and (first or capital) or word[0] == "I" and meant[:1] == "i"
    return meant[:1].upper() + meant[1:] if upper else meant


def repair(text: str, joints: dict[int, bool], wrong: dict[str, tuple[str, bool]]) -> str:
    """Continuous paragraphs: headers, footers and page numbers dropped, broken words joined, lines run on, misread words
    put right. ``joints``: line indexes to whether the hyphen at their end goes; ``wrong``: spelling to (meant, capital)."""
    lines = text.split("\n")
    headers, numbers = Reader().edges(lines)
    paragraphs: list[str] = []
    gap, before = True, -1
    for i, x in enumerate(lines):
        s = x.strip(" \f\r\t")
        if i in headers or i in numbers:
            continue
        if not s:
            # a blank line ends a paragraph only if the sentence has ended
            gap = gap or not paragraphs or paragraphs[-1].rstrip()[-1:] in ".!?:»”\""
            continue
        if gap or not paragraphs:
            paragraphs.append(s)
        else:
            last = paragraphs[-1]
            if last[-1] in _HYPHENS and last[-2:-1].isalpha() and s[0].islower():
                paragraphs[-1] = last.rstrip(_HYPHENS) + s if joints.get(before) else last[:-1] + "-" + s
            else:
                paragraphs[-1] = f"{last} {s}"
        gap, before = False, i
    if not wrong:
        return "\n\n".join(paragraphs)

    def corrected(paragraph: str) -> str:
        def put(m):
            word = m.group() if m.group().isascii() else readable_form(m.group())
            if word not in wrong:
                return m.group()
            ahead = paragraph[max(0, m.start() - 9) : m.start()].rstrip(" \"'«»„“”(")
            return put_right(word, *wrong[word], ahead[-1] in ".!?…" if ahead else m.start() < 9)

        return _RUN.sub(put, paragraph)

    return "\n\n".join(map(corrected, paragraphs))


def repaired(docs: DataFrame, common_words: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, repaired): prose as continuous paragraphs; other texts as they are. Null stays null."""
    corpus = Corpus(docs, common_words, key, text)
    prose = cut(corpus.prose())
    ends = corpus.joints(prose).groupBy("_id").agg(F.collect_list(F.struct("line", "joint")).alias("_ends"))
    wrong = _places(docs, corpus).join(corpus.misread, "word").groupBy("_id").agg(F.collect_set(F.struct("word", "meant", "capital")).alias("_wrong"))
    told = prose.select("_id").join(ends, "_id", "left").join(wrong, "_id", "left").withColumnRenamed("_id", "_of")
    both = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(told, F.col("_id") == F.col("_of"), "left").select("_id", "_text", "_of", "_ends", "_wrong")

    def run(batches):
        for b in batches:
            out = []
            for t, of, joints, words in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                if of is not None and t:
                    t = repair(t, {x["line"]: x["joint"] for x in joints or ()}, {x["word"]: (x["meant"], x["capital"]) for x in words or ()})
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "repaired"])

    return both.filter("_id is not null").mapInArrow(run, f"`{key}` {corpus.kind}, repaired string")
