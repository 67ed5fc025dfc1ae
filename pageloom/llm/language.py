"""Missing or wrong document language labels: languages of texts and of their segments by compression.

For every language of the reference list a raw-content dictionary for zstandard is filled with sample texts; a stretch of
text is in the language whose dictionary compresses it best; where the runner-up is too close the choice is rejected. A text is
cut into sentences (long unpunctuated runs into windows of words), each is compressed with every dictionary, and neighbouring
sentences of a language make a segment. The confidence is the margin: the share by which the runner-up is larger.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .normalize import readable_form
from .quality import Scale, _matrix, _Words, language_words, sketches, statistics
from .scans import Reader

#: Sample texts a language: one from each of so many hash blocks, none longer than SAMPLE_CHARS; the model is bounded by both.
BLOCKS, SAMPLE_CHARS = 96, 3000
#: Bytes of a dictionary.
DICT_BYTES = 64 << 10
LEVEL = 1
#: Least words of a segment; words of a window in unpunctuated text.
LEAST_WORDS, WINDOW = 5, 8
#: The runner-up has to be larger by this share, else the stretch is rejected.
MARGIN = 0.04

_UNIT = re.compile(r"(?<=[.!?…:])[\"'”»)]*\s+|\s+[/|]\s+|\n\s*[-–—=_*]{2,}\s*\n|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SPACES = re.compile(r"\s+")
#: Bibliographic three-letter codes that differ from the terminological ones (fixed values).
BIBLIOGRAPHIC = {"ger": "deu", "fre": "fra", "dut": "nld", "cze": "ces", "gre": "ell", "rum": "ron", "slo": "slk", "scr": "hrv"}
NO_LABEL = ("", "und", "unknown", "osd", "none", "null", "mul", "zxx")


def label_names(packs: DataFrame) -> dict[str, str]:
    """Every lower-case way to name a language of the reference list (code, two letters, English name) to its code."""
    rows = packs.filter("kind = 'language'").select("code", "name", "iso1").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the list of languages has more than 10,000 entries")
    out = {}
    for code, name, iso in rows:
        for x in (code, name, iso):
            if x:
                out[x.lower()] = code
    return out | {b: t for b, t in BIBLIOGRAPHIC.items() if t in out}


def languages_of_label(label: str | None, names: dict[str, str]) -> frozenset | None:
    """The codes a label names; None where it names none. A part that isn't known counts as itself."""
    if label is None or label.strip().lower() in NO_LABEL:
        return None
    out = set()
    for part in re.split(r"[+,;]", label):
        p = part.strip().lower()
        if p in NO_LABEL:
            continue
        base = re.split(r"[_-]", p)[0]
        out.add(names.get(p) or names.get(base) or p)
    return frozenset(out) or None


def sample_texts(docs: DataFrame, names: dict[str, str], common: dict[str, frozenset], text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """Content of the dictionaries: up to BLOCKS labelled texts a language, at most SAMPLE_CHARS each, of which the last
    DICT_BYTES bytes count.

    One text is taken per language and hash block, by an aggregate with map-side combine. Texts whose frequent words speak
    for another language than their label are left out.
    """
    h = F.xxhash64(key, text)
    rows = (
        docs.filter(F.col(lang).isNotNull() & F.length(text).between(120, SAMPLE_CHARS))
        .select(F.lower(lang).alias("_l"), F.pmod(h, F.lit(BLOCKS)).alias("_b"), h.alias("_h"), F.col(text).alias("_t"))
        .groupBy("_l", "_b")
        .agg(F.min_by("_t", "_h").alias("_t"))
        .filter(F.col("_l").isin(*names))
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["_l"], r["_b"])):
        code = names[r["_l"]]
        words = [w.lower() for w in _WORD.findall(readable_form(r["_t"]))]
        votes = {c: sum(w in s for w in words) for c, s in common.items()}
        if not votes or votes.get(code, 0) >= max(votes.values()):
            out.setdefault(code, []).append(readable_form(r["_t"]))
    raw = {c: _SPACES.sub(" ", "\n".join(v).lower()).encode("utf-8", "replace") for c, v in sorted(out.items())}
    return {c: x[-DICT_BYTES:] for c, x in raw.items()}


class Model:
    """Compressors by language. ``samples`` hold what ``sample_texts`` gives, at most DICT_BYTES a language."""

    def __init__(self, samples: dict[str, bytes]):
        import zstandard as z

        self.size = {}
        for code, raw in samples.items():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.size[code] = z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def classify(self, unit: bytes) -> tuple[str | None, str | None, float]:
        """(smallest, runner-up, margin): the margin is the share by which the runner-up is larger."""
        sizes = sorted([(len(f(unit)), c) for c, f in self.size.items()])
        if len(sizes) < 2:
            return (sizes[0][1], None, 1.0) if sizes else (None, None, 0.0)
        (a, best), (b, second) = sizes[:2]
        return best, second, (b - a) / b

    def told(self, unit: bytes, before: str | None) -> tuple[str | None, float]:
        """(language, margin). A narrow margin rejects the choice: the stretch then goes on in the language before it, if that
        is one of the two that can't be told apart, and is in no language else."""
        best, second, margin = self.classify(unit)
        if margin >= MARGIN:
            return best, margin
        return (before if before in (best, second) else None), margin

    def segments(self, text: str) -> list[tuple[str, float, int]]:
        """(language, confidence, words) of every segment, in reading order; the confidence is the mean margin by words."""
        units: list[list] = []  # language, margin, words
        before = None
        for piece in _UNIT.split(text):
            words = _WORD.findall(piece)
            n = len(words)
            if n < 3:
                if units:
                    units[-1][2] += n
                continue
            whole = _SPACES.sub(" ", piece.lower()).strip().encode("utf-8", "replace")
            lang, margin = self.told(whole, before)
            parts = [(lang, margin, n)]
            if n > 2 * WINDOW + 4 and (n > 26 or margin < MARGIN):
                # windows of words; a sentence of normal length stays whole if one language fits all of it
                at = [m.start() for m in _WORD.finditer(piece)][::WINDOW] + [len(piece)]
                if len(at) > 2 and n % WINDOW and n % WINDOW < 4:
                    at.pop(-2)
                at[0], parts, last = 0, [], before
                for a, b in zip(at, at[1:]):
                    p = piece[a:b]
                    lang, margin = self.told(_SPACES.sub(" ", p.lower()).strip().encode("utf-8", "replace"), last)
                    last = lang or last
                    parts.append((lang, margin, len(_WORD.findall(p))))
            for lang, margin, k in parts:
                if lang is not None:
                    units.append([lang, margin, k])
                    before = lang
        out = _runs(units)
        return [tuple(x) for x in _runs([x for x in out if x[2] >= LEAST_WORDS])]


def _runs(units: list[list]) -> list[list]:
    """Neighbours of a language as one, with the mean margin by words."""
    out: list[list] = []
    for lang, margin, k in units:
        if out and out[-1][0] == lang:
            m, n = out[-1][1], out[-1][2]
            out[-1][1:] = [(m * n + margin * k) / max(1, n + k), n + k]
        else:
            out.append([lang, margin, k])
    return out


@lru_cache(2)
def _model(samples: tuple) -> Model:
    return Model(dict(samples))


_SEGMENT = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int64())])


def classified(texts: DataFrame, packs: DataFrame, common_words: DataFrame, samples: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, lang, stats, segments): statistics and segments of every content that isn't null or blank; materialised.

    Texts are read where they lie and never shuffled; what goes on is some 100 bytes a content. A key in several rows counts
    once. The model that is sent to the tasks is bounded by languages x DICT_BYTES.
    """
    common = language_words(common_words)
    model = tuple(sample_texts(samples, label_names(packs), common).items())
    kind = dict(texts.dtypes)[key]

    def run(batches):
        m, known, reader = _model(model), _Words(common), Reader()
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                if i is None or not t or t.isspace():
                    continue
                form = readable_form(t)
                found = m.segments(form)
                if len(found) > 1:
                    # headers, footers and page numbers of scans are no part of the text
                    lines = form.split("\n")
                    noise = set().union(*reader.edges(t.split("\n")))
                    if noise:
                        found = m.segments("\n".join(x for k, x in enumerate(lines) if k not in noise))
                lang, s = statistics(t, known, form)
                out.append((i, lang, s, [dict(zip(("lang", "confidence", "words"), x)) for x in found]))
            cols = list(zip(*out)) if out else [[]] * 4
            types = [b.schema.field(0).type, pa.string(), pa.list_(pa.float32()), pa.list_(_SEGMENT)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=[key, "lang", "stats", "segments"])

    schema = f"`{key}` {kind}, lang string, stats array<float>, segments array<struct<lang:string,confidence:double,words:bigint>>"
    return cut(texts.select(key, text).mapInArrow(run, schema).dropDuplicates([key]))


def languages(texts: DataFrame, files: DataFrame, packs: DataFrame, common_words: DataFrame, samples: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, lang, confidence, kind, label_fits, segments): one row for every content that isn't null or blank.

    ``lang`` names the languages of the content in order of appearance, joined by ``+``, and is ``und`` where none can be
    told (confidence 0); ``confidence`` is the mean margin of its segments by words; ``kind`` is that of the quality
    statistics; ``label_fits`` says whether the label in ``files`` (id, lang) names exactly these languages, and is null
    without a label. A content without a row in ``files`` has no label; with an empty sample nothing can be told.
    """
    names, rows = label_names(packs), classified(texts, packs, common_words, samples, key, text)
    scale = Scale(sketches(rows))
    labels = files.groupBy(F.col("id").alias("_of")).agg(F.max("lang").alias("_label"))
    kind = dict(texts.dtypes)[key]

    def run(batches):
        for b in batches:
            ids, langs, _, segs, label = (c.to_pylist() if k != 2 else c for k, c in enumerate(b.columns))
            kinds = scale.kinds(langs, _matrix(b.column(2)))
            found = [list(dict.fromkeys(x["lang"] for x in s)) for s in segs]
            words = [sum(x["words"] for x in s) for s in segs]
            conf = [sum(x["confidence"] * x["words"] for x in s) / n if n else 0.0 for s, n in zip(segs, words)]
            named = [languages_of_label(x, names) for x in label]
            fits = [None if x is None else x == frozenset(f) for x, f in zip(named, found)]
            cols = [b.column(0), pa.array(["+".join(f) or "und" for f in found]), pa.array(conf, pa.float64()), pa.array(kinds, pa.string()), pa.array(fits, pa.bool_()), b.column(3)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "lang", "confidence", "kind", "label_fits", "segments"])

    both = rows.join(labels, F.col(key) == F.col("_of"), "left").select(key, "lang", "stats", "segments", "_label")
    return both.mapInArrow(run, f"`{key}` {kind}, lang string, confidence double, kind string, label_fits boolean, segments array<struct<lang:string,confidence:double,words:bigint>>")


def segments(texts: DataFrame, files: DataFrame, packs: DataFrame, common_words: DataFrame, samples: DataFrame, key: str = "file_id", text: str = "content", wrong_only: bool = False) -> DataFrame:
    """(key, seg_no, lang, confidence, words): the segments of every prose text, numbered in reading order.

    With ``wrong_only``, of the texts whose label is missing or doesn't name exactly the languages found, or that hold more
    than one. Null, empty and blank texts, and texts in which no stretch of five words can be told, have no rows; repeated
    rows count once; an empty sample gives no rows.
    """
    rows = languages(texts, files, packs, common_words, samples, key, text).filter("kind = 'prose'")
    if wrong_only:
        rows = rows.filter(~F.coalesce("label_fits", F.lit(False)) | F.contains("lang", F.lit("+")))
    return rows.select(key, F.posexplode("segments").alias("_k", "_s")).select(key, (F.col("_k") + 1).cast("long").alias("seg_no"), "_s.lang", "_s.confidence", "_s.words")
