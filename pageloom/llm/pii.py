"""Personal information inside free text: found with its place in the source, and replaced by typed placeholders.

Detection runs on a deobfuscated text. A chain of transducers rewrites it, each keeping, for every character it emits, the place
it came from: the first brings characters to one form (look-alikes, width, ligatures, invisible characters), the second turns
written-out signs (``at``, ``(dot)``, spaces around them) into the signs themselves, and spelled or spaced digits into numbers.
Patterns then read plain identifiers, and every span is mapped back to the source characters.

Names are told by exact counts over all texts. What a form of address, a salutation, a closing or a field like ``From:``
introduces gives the first given names and surnames; further ones follow from the runs of capitalised words in which they
stand beside known ones, as long as most occurrences of the word are of this kind and it isn't written in lower case. Counts,
evidence and the roles of words are tables that are joined, however large; a filter of fixed size tells each task which words
are worth asking for.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .normalize import _finders, one_script, readable_form
from .sketch import Filter, filter_of, signed_key

KINDS = ("person_name", "email", "phone", "id_number", "street_address")

# ------------------------------------------------------------------ transducer


def deobfuscated(text: str) -> tuple[str, list[int] | None]:
    """The readable form of ``text`` and, per character of it, the index in ``text``; None for the identity."""
    if text.isascii():
        return text, None
    form = readable_form(text)
    if len(form) == len(text) and unicodedata.is_normalized("NFKC", text) and not _finders()[0].search(text):
        return form, None  # one for one
    out: list[str] = []
    source: list[int] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        piece = _piece(text[i:j])
        out.append(piece)
        source += [i] * len(piece)
        i = j
    form = "".join(out)
    alike = one_script(form)
    return (alike if len(alike) == len(form) else form), source


_pieces: dict[str, str] = {}


def _piece(cluster: str) -> str:
    known = _pieces.get(cluster)
    if known is None:
        if len(_pieces) > 100_000:
            _pieces.clear()
        # alone, a letter of another script stays as it is
        out = unicodedata.normalize("NFKC", readable_form(cluster) if not cluster.isalpha() else cluster)
        known = _pieces[cluster] = out
    return known


_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_DOT_SAID = r"\s?[\[({]\s?(?:dot|DOT|\.|punkt|point|točka)\s?[\])}]\s?|(?<=\w)\s(?:dot|DOT)\s(?=\w)"
_AT_SAID = (
    r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s@\s?|(?<=\w)@\s"
    # the bare word only before what reads as a domain
    rf"|(?<=\w)\s(?:at|AT)\s(?=(?:{_LABEL}(?:{_DOT_SAID}|\.))*{_LABEL}(?:{_DOT_SAID})[^\W\d_]{{2,}}\b|{_LABEL}(?:\.{_LABEL})*\.[a-z]{{2,}}\b(?!\s[A-Z]{{2}}))"
)
# The names of the digits 0 to 9.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine", "oh", "null eins zwei drei vier fünf sechs sieben acht neun", "nula jedan dva tri četiri pet šest sedam osam devet",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zero uno due tre quattro cinque sei sette otto nove",
    "ноль один два три четыре пять шесть семь восемь девять",
)
_DIGIT_OF = {w: str(k) for names in DIGIT_NAMES for k, w in enumerate(names.split())}
_TIMES = {"double": 2, "triple": 3}
_NAME_OF_DIGIT = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_ONE = rf"(?:(?:double|triple)[\s-]+)?{_NAME_OF_DIGIT}"
_SAID = rf"(?i:\b{_ONE}(?:[\s,-]{{1,2}}(?:{_ONE}|\d+))+\b)"
_SPACED = r"(?<![\w.,/-])\d(?: \d){6,}(?![\w]|[.,]\d)"
_SIGN_RULES, _DIGIT_RULES = rf"(?P<dot>{_DOT_SAID})|(?P<at>{_AT_SAID})", rf"(?P<said>{_SAID})|(?P<spaced>{_SPACED})"
#: The rules that may apply, by whether there are written-out signs and digits.
_RULES = {(True, True): re.compile(f"{_SIGN_RULES}|{_DIGIT_RULES}"), (True, False): re.compile(_SIGN_RULES), (False, True): re.compile(_DIGIT_RULES)}
_DIGIT_TOKEN = re.compile(rf"(?i)(double|triple)[\s-]+({_NAME_OF_DIGIT})|({_NAME_OF_DIGIT})|(\d)")
#: Cheap tests for a text in which a rule may apply, by its words and signs.
_DIGIT_WORDS, _SIGN_WORDS = frozenset(_DIGIT_OF), frozenset(("at", "AT", "dot", "DOT", "punkt", "point", "točka"))
_MAY_SIGN = re.compile(r"[\[({<]\s?(?:at|AT|dot|DOT|\.|punkt|point|točka)\b|\s(?:at|AT)\s\S+(?:\.[a-z]|\s(?:dot|DOT)\s|\s?[\[({])|\s(?:dot|DOT)\s")
_MAY_SPACED = re.compile(r"\d \d \d \d")


def _may_rules(t: str, words: set[str]) -> tuple[bool, bool]:
    signs = "@ " in t or " @" in t or "@\n" in t or "\n@" in t or "(." in t or "[." in t or "(@" in t or "[@" in t or not words.isdisjoint(_SIGN_WORDS) and _MAY_SIGN.search(t) is not None
    return signs, _MAY_SPACED.search(t) is not None or len(_DIGIT_WORDS.intersection(map(str.lower, words))) + bool(words & {"double", "triple"}) > 1


#: Fewest digits that spelled digits have to give together.
LEAST_SAID = 6


def said_as_signs(t: str, words: set[str] | None = None) -> tuple[str, list[int] | None]:
    """``t`` with written-out signs and digits as signs and digits, and per character the index in ``t``; None if unchanged."""
    rules = _RULES.get(_may_rules(t, set(_tokens(t).findall(t)) if words is None else words))
    if rules is None:
        return t, None
    out: list[str] = []
    source: list[int] = []
    at = 0

    def emit(piece: str, places) -> None:
        out.append(piece)
        source.extend(places)

    for m in rules.finditer(t):
        a, b = m.span()
        kind = m.lastgroup
        if kind in ("at", "dot"):
            emit(t[at:a], range(at, a))
            emit("@" if kind == "at" else ".", [a])
        elif kind == "spaced":
            emit(t[at:a], range(at, a))
            emit(t[a:b:2], range(a, b, 2))
        else:
            digits = [(x.start(), _DIGIT_OF[(x.group(2) or x.group(3)).lower()] * _TIMES.get((x.group(1) or "").lower(), 1) if not x.group(4) else x.group(4)) for x in _DIGIT_TOKEN.finditer(t, a, b)]
            if sum(len(d) for _, d in digits) < LEAST_SAID:
                continue  # a few numbers in running text
            emit(t[at:a], range(at, a))
            for place, d in digits:
                emit(d, [place] * len(d))
        at = b
    if not at:
        return t, None
    emit(t[at:], range(at, len(t)))
    return "".join(out), source


# -------------------------------------------------------------------- patterns

_EMAIL = re.compile(rf"(?<![\w.+-])[^\W_][\w.+-]*@{_LABEL}(?:\.{_LABEL})*(?:\.|\.\s(?=[a-z]{{2,12}}\b)|\s\.\s?(?=[a-z]{{2,12}}\b))[^\W\d_]{{2,}}(?![\w@])")
#: Cheap tests that let most texts pass by.
_LONG_NUMBER = re.compile(r"\d(?:[ .\n/()-]{0,2}\d){5}")
_MIXED_NUMBER = re.compile(r"\d{4}[A-Z]\d")

_SEP = r"[ .\-/‐-–\n]"
_PHONE = re.compile(
    rf"(?<![\w+/.-])(?:"
    rf"\+\d{{1,3}}(?:{_SEP}?\(?\d{{1,5}}\)?){{2,6}}"  # with country code
    rf"|00\d{{1,3}}(?:{_SEP}?\(?\d{{1,5}}\)?){{2,6}}"
    rf"|\(\d{{2,5}}\){_SEP}?\d{{3,8}}(?:{_SEP}\d{{2,6}}){{0,3}}"  # area code in brackets
    rf"|1?{_SEP}?\d{{3}}[-. \n]\d{{3}}[-. \n]\d{{4}}"
    rf"|1\d{{10}}"
    rf"|0\d{{1,5}}(?:{_SEP}?\d{{2,8}}){{1,5}}"  # national, with trunk zero
    rf")(?![\w<]|[-./]\d)"
)
_ID_LABEL = (
    r"(?:(?i:passport|identity (?:card|number|no)|id(?:entity)? card|national id|social (?:security|insurance)|insurance (?:number|no)|tax (?:id|number|no)"
    r"|driving licen[cs]e|licen[cs]e (?:number|no)|steuer-?\s?(?:id|nummer)|ausweis|reisepass|sozialversicherung|osobna iskaznica|iskaznic|putovnic"
    r"|s[ée]curit[ée] sociale|carte d.identit[ée]|passeport|num[ée]ro fiscal|codice fiscale|carta d.identit[àa]|passaporto|pasaporte|seguridad social"
    r"|паспорт|снилс|инн)|\bOIB\b|\bID\b|\bSSN\b|\bNINO?\b|\bDNI\b|\bNIF\b)"
)
_ID_TOKEN = (
    r"(?:\d{3}[-\s]\d{2}[-\s]\d{4}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]|[A-Z]<\d{6,9}|[A-Z]\d{4}[A-Z]\d{4}|[A-Z]{1,3}\s?\d{6,10}[A-Z]?"
    r"|[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}|\d(?:\s?\d){7,15}|\d{2,3}(?:[\s./-]\d{2,6}){2,4}|\d{6,15})"
)
#: Characters that the pattern before a number can take.
ID_REACH = 80
_ID_AT = re.compile(r"\d+")
_ID_PREFIX = re.compile(r"(?:[A-Z]{1,3}<?|[A-Z]{2}\s(?=\d{2}\s\d{2}\s\d{2}\s[A-Z]\b))$")
_ID_MATCH = re.compile(rf"({_ID_TOKEN})(?![\w]|-\d)")
_ID_BEFORE = re.compile(rf"{_ID_LABEL}[^\d.;!?<]{{0,32}}?(?:no\.|nr\.|br\.|n°|№)?[^\d.;!?<]{{0,12}}?$")


def _labelled_ids(t: str):
    """Spans of numbers that follow the name of a kind of number."""
    at = 0
    for m in _ID_AT.finditer(t):
        a = m.start()
        if a < at:
            continue
        prefix = _ID_PREFIX.search(t, max(0, a - 4), a)
        if prefix:
            a = prefix.start()
        if (a and (t[a - 1].isalnum() or t[a - 1] in "_-")):
            continue
        token = _ID_MATCH.match(t, a)
        if token and sum(map(str.isdigit, token.group(1))) >= 6 and _ID_BEFORE.search(t, max(0, a - ID_REACH), a):
            at = token.end(1)
            yield a, at


_ID_ALONE = re.compile(r"(?<![\w-])(?:\d{3}([- ])\d{2}\1\d{4}|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[A-Z]<\d{7})(?![\w]|-\d)")

_CAP = r"[A-ZÀ-ÖØ-ÞĆČĐŠŽ][\w'’-]*"
_S = r"(?: ?\n| )"
_EN_TYPE = (
    r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Close|Crescent|Cres|Square|Sq|Terrace|Way|Court|Ct|Place|Pl|Row|Walk|Gardens|Grove|Mews|Hill|Parade|Boulevard|Blvd"
    r"|STREET|ST|ROAD|RD|LANE|LN|AVENUE|AVE|DRIVE|DR|CLOSE|CRESCENT|SQUARE|SQ|TERRACE|WAY|COURT|PLACE|ROW|WALK|GARDENS|GROVE|MEWS|HILL|BOULEVARD)"
)
_EN_LOWER = r"(?:street|road|lane|avenue|drive|close|crescent|square|terrace|rd|ave)"
_NOT_STREET = r"(?!(?:of|the|a|an|in|on|and|for|at|to|by|sheets|images|minutes|pages|x)\b)"
#: From the house number on.
_NUMBER_FIRST = re.compile(
    rf"\d{{1,4}}[A-Za-z]?,?{_S}(?:{_CAP}{_S}){{1,3}}{_EN_TYPE}\b"
    rf"|\d{{1,4}}[a-z]?,?{_S}(?:{_NOT_STREET}[a-z'’-]{{3,}}{_S}){{1,3}}{_EN_LOWER}\b(?!\s[a-z])"
    rf"|\d{{1,4}}(?:{_S}?(?:bis|ter|[a-zA-Z]))?,?{_S}(?i:rue|avenue|chemin|place|allée|boulevard|quai|impasse|route|cours|passage|square|ruelle){_S}"
    rf"(?:(?:de{_S}la|de{_S}l['’]|du|des|de|d['’]|la|le|les|aux?)(?:{_S})?)?{_CAP}(?:{_S}{_CAP}){{0,3}}"
)
_DE_TYPE = ("straße", "strasse", "str.", "weg", "allee", "platz", "gasse", "ring", "damm", "ufer", "steig", "markt", "graben", "hof", "chaussee")
_HR_TYPE = ("ulica", "ul.", "cesta", "trg", "put", "prilaz", "ulice")
_ROMANCE = re.compile(
    rf"(?<![\w-])(?i:ulica|ul\.|trg|cesta|calle|avenida|plaza|paseo|via|viale|piazza|corso|largo|улица|ул\.|проспект|переулок){_S}(?:(?:de{_S}la|del|della|dei|di|de|d['’]){_S})?"
    rf"(?:{_CAP}|[А-ЯЁ][а-яё-]+)(?:{_S}(?:{_CAP}|[А-ЯЁ][а-яё-]+)){{0,3}},?{_S}(?:n\.?º?{_S}|д\.{_S}?)?$"
)
_ROMANCE_WORDS = frozenset("ulica ul. trg cesta calle avenida plaza paseo via viale piazza corso largo улица ул. проспект переулок".split())
_DE_START = re.compile(rf"(?:(?<![\w-])(?:Alte|Neue|Große|Kleine|Lange|Breite|Hohe|Obere|Untere|Am|An der|Im|Zum|Zur|Auf der)[rsn]?{_S})?(?<![\w-])[A-ZÄÖÜ][\wäöüß-]*\.?(?: ?\n| )$")
_HR_START = re.compile(rf"(?<![\w-]){_CAP}(?:{_S}{_CAP}){{0,2}}{_S}[\w.]+(?: ?\n| )$")
_HOUSE = re.compile(r"\d{1,4}(?:[ ]?[A-Za-z]\b)?(?![\w%]|[.,:]\d|[-/]\d)")


#: Words before a house number that a pattern can take.
ADDRESS_WORDS = 9


def addresses(t: str) -> list[tuple[int, int]]:
    """Spans of street addresses: from each house number, forwards and backwards."""
    out = []
    for m in _HOUSE.finditer(t):
        a = m.start()
        if a and (t[a - 1].isalnum() or t[a - 1] in "_.,/-"):
            continue
        f = _NUMBER_FIRST.match(t, a)
        if f:
            out.append(f.span())
            continue
        if not a or t[a - 1] not in " \n":
            continue
        back = 60
        before = t[max(0, a - back) : a]
        while back < a and before.count(" ") + before.count("\n") < ADDRESS_WORDS:  # long words: as many words as a pattern takes
            back *= 2
            before = t[max(0, a - back) : a]
        parts = before.split()
        if not parts:
            continue
        word = parts[-1].rstrip(",").lstrip("(\"'„«")
        low, f = word.lower(), None
        if not word:
            continue
        if word[0].isupper() and low.endswith(_DE_TYPE) and len(low) > 4:
            f = _DE_START.search(before)
        elif low in _HR_TYPE:
            f = _HR_START.search(before)
        if f is None and word[0].isupper() and not _ROMANCE_WORDS.isdisjoint(before.lower().split()):
            f = _ROMANCE.search(before)
        if f:
            out.append((a - len(before) + f.start(), m.end()))
    return out


# ----------------------------------------------------------------------- names

_UPPER = "A-Z" + "".join(chr(c) for c in range(0xC0, 0x530) if chr(c).isupper())
_PART = rf"[{_UPPER}][^\W\d_]*(?:['’][^\W\d_]+)?(?:-[{_UPPER}][^\W\d_]+)*"
_INITIAL = rf"[{_UPPER}]\."
TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Herr", "Herrn", "Frau", "M", "Mme", "Mlle", "Madame", "Monsieur", "Mademoiselle", "Signor", "Signora", "Signorina", "Sig", "Sr",
    "Sra", "Señor", "Señora", "gospodin", "gospodine", "gospođa", "gospođo", "gospođi", "gđa", "gosp", "господин", "госпожа",
)
#: Salutations, closings, fields and agents, after which a person's full name may stand.
_TAKES = (
    r"(?:\b(?:[Dd]ear|[Ll]iebe[r]?|[Cc]h[eè]re?|[Qq]uerid[oa]|[Ee]stimad[oa]|[Cc]ar[oa]|[Dd]rag[ia]|[Pp]oštovan[ia]|[Уу]важаем(?:ый|ая)|[Дд]орог(?:ой|ая))"
    r"|(?:[Rr]egards|[Ss]incerely|[Ff]aithfully|[Tt]ruly|[Ww]ishes|[Gg]rüßen|[Gg]rüße|[Cc]ordialement|[Ss]alutations|[Ss]aludos|[Ss]aluti|[Pp]ozdrav|[Уу]важением),?|\n--"
    r"|\b(?:[Ff]rom|[Tt]o|[Cc]c|[Nn]ame|[Aa]ttn|[Cc]ontact|[Vv]on|[Aa]n|[Dd]e|À|[Pp]ara|[Dd]a|[Oo]d|[Зз]а|[Кк]ому|[Оо]т):|\b[Cc]ontact|\b[A-Za-z]{2,}(?:ed|en|t|id) by)"
)
_TITLE = r"(?:" + "|".join(x if len(x) > 1 else rf"{x}(?=\.)" for x in TITLES) + r")\b\.?"
_RUN = re.compile(rf"(?:{_PART}|{_INITIAL})(?:[ \n](?:{_PART}|{_INITIAL})){{1,3}}")
_TAKES_END = re.compile(rf"{_TAKES}\s+$")
_SEED_TITLE = re.compile(rf"\b{_TITLE}[ \n]((?:(?:{_PART}|{_INITIAL})[ \n]){{0,2}}{_PART})")
_TITLE_WORDS = frozenset(TITLES)
#: Words that stand under a name in a letter and are none.
_NO_NAME = frozenset(("tel", "phone", "fax", "mobile", "mobil", "telefon", "mail", "e-mail", "email"))
_PARTICLES = {"mac", "mc", "van", "von", "de", "der", "di", "da", "du", "del", "della", "le", "la", "st", "zu"}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+(?:['’][^\W\d_]+)*)*")
_TOKEN_ASCII = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*(?:-[A-Za-z]+(?:'[A-Za-z]+)*)*")


def _tokens(t: str) -> "re.Pattern":
    """The pattern of tokens; over ASCII text plain ranges do and are faster."""
    return _TOKEN_ASCII if t.isascii() else _TOKEN


def _plain(word: str) -> str:
    return word.lower().replace("’", "'")


class _Marks(dict):
    """Marks of a word that occurs, kept per worker; emptied when large."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        x = _plain(word)
        out = self[word] = ("w" + x, "l" + x) if word[0] == x[0] else ("w" + x,)
        return out


_marks = _Marks()


def name_evidence(text: str) -> tuple[set[str], set[tuple[str, str]]]:
    """(marks of words, pairs) of a text. Marks: ``w`` occurs, ``l`` occurs in lower case, ``g`` and ``s`` given name and surname
    by a phrase, ``t`` surname after a form of address; each before the word. Pairs: the last two words of
    every run of capitalised words, initials between them left out."""
    form = readable_form(text)
    words = set(_tokens(form).findall(form))
    out = set()
    for w in words:
        out.update(_marks[w])
    pairs = set()
    for m in _RUN.finditer(form):
        parts = m.group().split()
        own = parts[max((k + 1 for k, p in enumerate(parts) if p.rstrip(".") in _TITLE_WORDS), default=0) :]
        own = [p for p in own if _plain(p) not in _NO_NAME]
        full = [p for p in own if not p.endswith(".") and _plain(p) not in _PARTICLES]
        if len(full) < 2 or len(full[-1]) < 2 or own[-1].endswith("."):
            continue
        last = _plain(full[-1])
        if len(full[-2]) > 2:
            pairs.add((_plain(full[-2]), last))
        # the phrase may be the first word of the run itself ("Contact Ivy Vantrupp")
        for k in (0, 1)[: len(full) - 1]:
            a = m.start() + m.group().index(full[k]) if k else m.start()
            if _TAKES_END.search(form, max(0, a - TAKES_REACH), a):
                out.add("s" + last)
                out.update("g" + _plain(p) for p in full[k:-1] if len(p) > 2)
                break
    if not words.isdisjoint(_TITLE_WORDS):
        for m in _SEED_TITLE.finditer(form):
            last = m.group(1).split()[-1]
            if len(last) > 1 and _plain(last) not in _NO_NAME:
                out.add("t" + _plain(last))
    return out, pairs


#: Characters that a phrase before a name can take.
TAKES_REACH = 40
#: Share of the texts with a word in which it has to stand as a name, and share in which it may stand in lower case (as in
#: the addresses of mail).
MOSTLY, SELDOM = 0.3, 0.5
#: Rounds in which names are learnt from the names beside them.
ROUNDS = 3


def name_roles(docs: DataFrame, text: str = "content") -> DataFrame:
    """(word, role): ``g`` for given names and ``s`` for surnames, over all texts; repeated rows count as they stand.

    Evidence for a word is the number of texts with a phrase that introduces it, or with a run of capitalised words in which it
    stands beside a word of the other role. Two texts, or a form of address, are enough where most texts with the word are
    such. Each round is two joins of the table of pairs with the roles so far.
    """

    def run(batches):
        marks: dict[str, int] = {}
        pairs: dict[tuple[str, str], int] = {}

        def drain():
            rows = [(w[0], w[1:], None, n) for w, n in marks.items()] + [("p", a, b, n) for (a, b), n in pairs.items()]
            marks.clear()
            pairs.clear()
            cols = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["mark", "word", "other", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    m, p = name_evidence(t)
                    for w in m:
                        marks[w] = marks.get(w, 0) + 1
                    for w in p:
                        pairs[w] = pairs.get(w, 0) + 1
            if len(marks) + len(pairs) > 500_000:
                yield drain()
        yield drain()

    rows = docs.select(text).mapInArrow(run, "mark string, word string, other string, n bigint")
    table = cut(rows.groupBy("mark", "word", "other").agg(F.sum("n").alias("n")))
    of = lambda m: F.coalesce(F.sum(F.when(F.col("mark") == m, F.col("n"))), F.lit(0))
    words = table.filter("mark <> 'p'").groupBy("word").agg(*[of(m).alias(m) for m in "wlgst"])
    words = cut(words.filter((F.col("l") <= SELDOM * F.col("w")) & (F.length("word") > 1)))
    near = words.select("word", "w")
    pairs = table.filter("mark = 'p'").select(F.col("word").alias("first"), F.col("other").alias("last"), "n")
    pairs = cut(pairs.join(near.select(F.col("word").alias("first")), "first", "left_semi").join(near.select(F.col("word").alias("last")), "last", "left_semi"))
    seed = F.when(F.col("g") > F.col("s") + F.col("t"), "g").otherwise("s")
    told = (F.col("g") + F.col("s") + F.col("t") >= 2) & (F.col("g") + F.col("s") + F.col("t") >= 0.05 * F.col("w")) | (F.col("t") > 0) & (F.col("t") >= 0.5 * F.col("w"))
    roles = cut(words.filter(told).select("word", seed.alias("role")))
    for _ in range(ROUNDS):
        given, sur = (roles.filter(F.col("role") == r).select(F.col("word").alias(c)) for r, c in (("g", "first"), ("s", "last")))
        s = pairs.join(given, "first", "left_semi").groupBy(F.col("last").alias("word")).agg(F.sum("n").alias("s2"))
        g = pairs.join(sur, "last", "left_semi").groupBy(F.col("first").alias("word")).agg(F.sum("n").alias("g2"))
        both = words.join(s, "word", "left").join(g, "word", "left").select("word", "w", (F.col("g") + F.coalesce("g2", F.lit(0))).alias("g"), (F.col("s") + F.col("t") + F.coalesce("s2", F.lit(0))).alias("s"), "t")
        enough = F.greatest("g", "s") >= F.greatest(F.lit(2), MOSTLY * F.col("w"))
        roles = cut(both.filter(enough | (F.col("t") > 0) & (F.col("t") >= 0.5 * F.col("w"))).select("word", F.when(F.col("g") > F.col("s"), "g").otherwise("s").alias("role")))
    return roles


_NEAR = re.compile(r"(?:\.?|,)[ \n]{1,2}")


class _Held:
    """The words that may be names by the filter; what is known is kept per worker and emptied when large."""

    def __init__(self, held: Filter):
        self.held, self.known, self.names = held, set(), set()

    def among(self, words: set[str]) -> set[str]:
        new = words - self.known
        if new:
            if len(self.known) > 500_000:
                self.known, self.names, new = set(), set(), words
            self.known |= new
            self.names.update([w for w in new if len(w) > 1 and self.held.may_hold(signed_key(_plain(w)) & ((1 << 64) - 1))])
        return words & self.names


class Finder:
    """Finds personal information in one text at a time: all but names, and the stretches in which names may stand."""

    def __init__(self, held: Filter):
        self.held = _Held(held)
        self.title = re.compile(rf"\b{_TITLE}[ \n]{{1,2}}$")

    def stretches(self, t: str, taken: bytearray, held: set[str]) -> list[tuple[int, int, bool]]:
        """(start, end, after a form of address) of the longest stretches of words that may be names, with initials and
        particles between them, outside of what is taken."""
        if not held:
            return []
        out, run = [], []  # run: (start, end, held)

        def close():
            while run and not run[-1][2] and not (run[-1][1] - run[-1][0] == 1):
                run.pop()
            if any(h for _, _, h in run):
                a, b = run[0][0], run[-1][1]
                b += run[-1][1] - run[-1][0] == 1 and t[b : b + 1] == "."
                out.append((a, b, self.title.search(t, max(0, a - 20), a) is not None))
            run.clear()

        for m in _tokens(t).finditer(t):
            a, b = m.span()
            w = m.group()
            hold = w in held and not any(taken[a:b])
            part = hold or len(w) == 1 and w.isupper() and t[b : b + 1] == "." or w.lower() in _PARTICLES
            if run and not (part and _NEAR.fullmatch(t, run[-1][1], a)):
                close()
            if part:
                run.append((a, b, hold))
        close()
        return out

    def spans(self, text: str):
        """(spans, stretches): (start, end, kind) of all but names in characters of ``text``, without overlaps; and for names
        (start, end, after a form of address, the stretch, places of its characters in ``text`` or None where they run on)."""
        t, source = deobfuscated(text)
        words = set(_tokens(t).findall(t))
        u, inner = said_as_signs(t, words)
        found: list[tuple[int, int, str]] = []
        taken = bytearray(len(t))

        def place(a: int, b: int) -> tuple[int, int]:
            return (a, b) if inner is None else (inner[a], inner[b - 1] + 1 if b == len(inner) else inner[b])

        def take(a: int, b: int, kind: str) -> None:
            if b > a and not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                found.append((a, b, kind))

        if "@" in u:
            for m in _EMAIL.finditer(u):
                take(*place(*m.span()), "email")
        if _LONG_NUMBER.search(u) or _MIXED_NUMBER.search(u):
            for a, b in _labelled_ids(u):
                take(*place(a, b), "id_number")
            for m in _ID_ALONE.finditer(u):
                take(*place(*m.span()), "id_number")
            for m in _PHONE.finditer(u):
                digits = sum(map(str.isdigit, m.group()))
                least = 8 if m.group()[0] in "+(" else 9
                if least <= digits <= 15:
                    a = m.start() + len(m.group()) - len(m.group().lstrip(" \n-./"))
                    take(*place(a, m.end()), "phone")
        for a, b in addresses(t):
            take(a, b, "street_address")
        names = [(a, b, titled, t[a:b], None if source is None else source[a:b] + [source[b] if b < len(source) else len(text)]) for a, b, titled in self.stretches(t, taken, self.held.among(words))]
        if source is not None:
            end = len(text)
            found = [(source[a], source[b] if b < len(source) else end, k) for a, b, k in found]
        return found, names


def names(t: str, roles: dict[str, str], titled: bool) -> list[tuple[int, int]]:
    """Spans of names in a stretch of words, by the roles of its words (lower case); ``titled``: a form of address precedes."""
    words = [(m.start(), m.end(), m.group()) for m in _tokens(t).finditer(t)]
    kinds = [roles.get(_plain(w), "") for _, _, w in words]
    hits = [i for i, k in enumerate(kinds) if k]
    # letters beside names: initials and particles
    for i in hits:
        for j in (i - 1, i + 1, i - 2):
            if 0 <= j < len(words) and not kinds[j]:
                _, b, w = words[j]
                if len(w) == 1 and t[b : b + 1] == "." and w.isupper():
                    kinds[j] = "i"
                elif w.lower() in _PARTICLES and j == i - 1:
                    kinds[j] = "p"
    spans, k, n = [], 0, len(words)

    def gap(a: int, b: int) -> str:
        return t[words[a][1] : words[b][0]]

    def near(a: int) -> bool:
        return re.fullmatch(r"\.?[ \n]{1,2}", gap(a, a + 1)) is not None and (gap(a, a + 1)[0] != "." or kinds[a] == "i")

    while k < n:
        if not kinds[k]:
            k += 1
            continue
        e = k
        while e + 1 < n and kinds[e + 1] and near(e):
            e += 1
        run = kinds[k : e + 1]
        last_s = max((i for i, x in enumerate(run) if x == "s"), default=-1)
        if len([x for x in run if x != "p"]) >= 2 and ("s" in run or "g" in run[1:]) and run[-1] in "sg":
            # two names without a sign between them don't occur; the run is one full name
            spans.append((words[k][0], words[e][1]))
            k = e + 1
        elif last_s >= 0 and titled and k == 0:
            spans.append((words[k][0], words[e][1]))
            k = e + 1
        elif last_s >= 0 and e + 1 < n and kinds[e + 1] in ("g", "i", "s") and re.fullmatch(r",[ \n]{1,2}", gap(e, e + 1)):
            # surname, given name: only if what follows isn't a full name itself
            f = e + 1
            while f + 1 < n and kinds[f + 1] and near(f):
                f += 1
            if "s" not in kinds[e + 1 : f + 1]:
                spans.append((words[k][0], words[f][1] + (kinds[f] == "i" and t[words[f][1] : words[f][1] + 1] == ".")))
                k = f + 1
            else:
                k = e + 1
        else:
            k = e + 1
    return spans


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])


def spans_table(docs: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, digest, start, end, kind): every piece of personal information of every text, in code points.

    ``digest`` tells different texts of a key apart; repeated rows count once. The words of stretches in which a name may
    stand are joined with the roles; a stretch then is decided by its own words.
    """
    roles = name_roles(docs, text)
    held = docs.sparkSession.sparkContext.broadcast(filter_of(roles.select("word").mapInArrow(_keys, "key long")))  # of fixed size
    kind = dict(docs.dtypes)[key]

    def run(batches):
        finder = Finder(held.value)
        for b in batches:
            out = []
            for i, d, t in zip(*(c.to_pylist() for c in b.columns)):
                found, stretches = finder.spans(t)
                out += [(i, d, a, e, k, None, None, None) for a, e, k in found]
                out += [(i, d, a, e, None, s, titled, places) for a, e, titled, s, places in stretches]
            cols = list(zip(*out)) if out else [[]] * 8
            types = [b.schema.field(0).type, pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["_id", "digest", "start", "end", "kind", "stretch", "titled", "places"])

    rows = docs.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, F.unhex(F.md5(text)).alias("_d"), text)
    schema = f"_id {kind}, digest binary, start bigint, end bigint, kind string, stretch string, titled boolean, places array<bigint>"
    both = cut(rows.mapInArrow(run, schema))
    asked = both.filter("stretch is not null").select("_id", "digest", "start", "stretch", "titled", "places").distinct()

    def words_of(batches):
        for b in batches:
            words = [sorted({_plain(w) for w in _tokens(x).findall(x)}) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["stretch", "words"])

    # each different stretch is asked for once
    forms = asked.select("stretch").distinct().mapInArrow(words_of, "stretch string, words array<string>").select("stretch", F.explode("words").alias("word"))
    told = forms.join(roles, "word").groupBy("stretch").agg(F.collect_list(F.struct("word", "role")).alias("roles"))

    def decide(batches):
        for b in batches:
            out = []
            for i, d, start, s, titled, places, rs in zip(*(c.to_pylist() for c in b.columns)):
                for x, y in names(s, {r["word"]: r["role"] for r in rs}, titled):
                    out.append((i, d, start + x if places is None else places[x], start + y if places is None else places[y], "person_name"))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [b.schema.field(0).type, pa.binary(), pa.int64(), pa.int64(), pa.string()])], names=["_id", "digest", "start", "end", "kind"])

    people = asked.join(told, "stretch").select("_id", "digest", "start", "stretch", "titled", "places", "roles").mapInArrow(decide, f"_id {kind}, digest binary, start bigint, end bigint, kind string")
    return both.filter("stretch is null").select("_id", "digest", "start", "end", "kind").unionByName(people).distinct().withColumnRenamed("_id", key)


def _keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([signed_key(w) for w in b.column(0).to_pylist()], pa.int64())], names=["key"])


def found(docs: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, kind, start_pos): every piece of personal information, by code points before it.

    Null and empty texts have none; repeated rows count once. Pieces that begin at the same place count by their kind.
    """
    return spans_table(docs, key, text).select(key, "kind", F.col("start").alias("start_pos")).distinct()


def redacted(docs: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, redacted): the text with ``[KIND]`` for every piece; the rest is unchanged. Null stays null."""
    kind = dict(docs.dtypes)[key]
    pieces = spans_table(docs, key, text).groupBy(F.col(key).alias("_of"), "digest").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_spans"))
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    both = rows.join(pieces, (F.col("_id") == F.col("_of")) & (F.unhex(F.md5("_text")) == F.col("digest")), "left").select("_id", "_text", "_spans")

    def run(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at, parts = 0, []
                for x in spans or ():
                    parts += [t[at : x["start"]], f"[{x['kind'].upper()}]"]
                    at = x["end"]
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "redacted"])

    return both.mapInArrow(run, f"`{key}` {kind}, redacted string")
