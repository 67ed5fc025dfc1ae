"""Encoding of a corpus with a public byte-level BPE tokenizer.

``BpeAutomaton`` compiles the merge list into a deterministic automaton whose arcs are labelled with token ids. It follows
the construction by successive merge gadgets: start from the automaton with one arc per byte; the gadget of a merge (a, b)
forbids the arc of b right after the arc of a and adds an arc for ab that goes where that pair went. What all gadgets
together leave, for a pair of neighbouring tokens (u, v), is a finite condition: no merge may apply across the border before
u and v themselves are complete, which is decided by walking down the right spine of u and the left spine of v. So the state
after a token is that token, an arc (u, v) exists iff the gadgets leave it, and a word has exactly one accepted path. The
arcs are compiled when first met and kept in a transition table; encoding is table-driven: ``last[i]`` is the one token that
ends the accepted path of the first i bytes, and the path is read back from the end. Decoding emits the byte labels of the arcs.

Words come from the tokenizer's pre-split pattern. Most words of a corpus are repeats, so that the automaton runs once per
distinct word of a worker; a text is then a row of table look-ups.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabulary files.
TOKENIZER_DIR = "/opt/tokenizers"
#: Pre-split pattern that belongs to the byte-level vocabularies (fixed value).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over ASCII text, where the classes are plain ranges and the standard engine is faster (fixed value).
PRE_SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words kept per worker before the table starts afresh; it bounds memory and never changes a result.
KEPT_WORDS = 400_000
#: Largest rank file.
MOST_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a rank file."""
    return ranks_of(_bytes_of(path))


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def _bytes_of(path: str) -> bytes:
    """A rank file as the driver reads it; its size is checked, as it is sent to every worker."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


class BpeAutomaton:
    """Deterministic tokenization automaton of a byte-level BPE whose ids are merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.label = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = {}  # the merge that makes a token
        self.arcs: dict[tuple[int, int], bool] = {}  # compiled transitions
        self.words: dict[str, tuple[int, ...]] = {}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        # tokens by first byte and length: which token lengths can start with these two bytes
        self.lengths: dict[bytes, list[int]] = {}
        for b in ranks:
            if len(b) > 1:
                self.lengths.setdefault(b[-2:], []).append(len(b))
        self.lengths = {k: sorted(set(v), reverse=True) for k, v in self.lengths.items()}

    def merge_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None for a byte."""
        if token in self.parts:
            return self.parts[token]
        b, out = self.label[token], None
        if len(b) > 1:
            # replay the merges below this token's own rank: what is left is its last pair
            seq = [self.byte[x] for x in b]
            while len(seq) > 2:
                best, at = token, -1
                for i in range(len(seq) - 1):
                    r = self.ranks.get(self.label[seq[i]] + self.label[seq[i + 1]])
                    if r is not None and r < best:
                        best, at = r, i
                if at < 0:
                    break
                seq[at : at + 2] = [best]
            out = (seq[0], seq[1]) if len(seq) == 2 else None
        self.parts[token] = out
        return out

    def arc(self, left: int, right: int) -> bool:
        """True iff the gadgets leave the arc ``right`` after the arc ``left``."""
        key = (left, right)
        known = self.arcs.get(key)
        if known is not None:
            return known
        u, v, limit, ok = left, right, 1 << 60, True
        label, ranks = self.label, self.ranks
        while True:
            r = ranks.get(label[u] + label[v])
            if r is not None and r < limit:
                ok = False
                break
            # undo the later of the two merges and look again; bytes have the lowest ids and can't be undone
            if u > v:
                parts = self.merge_of(u)
                if parts is None:
                    break
                limit, u = u, parts[1]
            else:
                parts = self.merge_of(v)
                if parts is None:
                    break
                limit, v = v + 1, parts[0]
        self.arcs[key] = ok
        return ok

    def encode_bytes(self, word: bytes) -> tuple[int, ...]:
        """The labels of the one accepted path over ``word``."""
        whole = self.ranks.get(word)
        n = len(word)
        if n == 0:
            return ()
        if whole is not None and self.merges_to_itself(whole):
            return (whole,)
        last = [-1] * (n + 1)
        ranks, byte, lengths = self.ranks, self.byte, self.lengths
        for i in range(1, n + 1):
            found = -1
            for size in lengths.get(word[max(0, i - 2) : i], ()):
                if size > i:
                    continue
                t = ranks.get(word[i - size : i])
                if t is None or not self.merges_to_itself(t):
                    continue
                if i == size or (last[i - size] >= 0 and self.arc(last[i - size], t)):
                    found = t
                    break
            if found < 0:
                found = byte[word[i - 1]]
            last[i] = found
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(self.label[last[i]])
        return tuple(reversed(out))

    def merges_to_itself(self, token: int) -> bool:
        """False for a token that no sequence of merges reaches."""
        return len(self.label[token]) == 1 or self.merge_of(token) is not None

    def encode_word(self, word: str) -> tuple[int, ...]:
        out = self.words.get(word)
        if out is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            out = self.words[word] = self.encode_bytes(word.encode("utf-8", "replace"))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(self.label[i] for i in ids)


class Encoder:
    """Text to ids by pre-split words and the automaton."""

    def __init__(self, ranks: dict[bytes, int]):
        import re

        import regex

        self.automaton = BpeAutomaton(ranks)
        self.ascii = re.compile(PRE_SPLIT_ASCII, re.ASCII).findall
        self.any = regex.compile(PRE_SPLIT).findall

    def split(self, text: str) -> list[str]:
        # the ASCII separators 0x1c-0x1f are white space to one engine only, so such texts take the general pattern
        plain = text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        return (self.ascii if plain else self.any)(text)

    def ids(self, text: str) -> np.ndarray:
        words, enc, out = self.automaton.words, self.automaton.encode_word, []
        for w in self.split(text):
            out += words.get(w) or enc(w)
        return np.array(out, dtype=np.int32)

    def count(self, text: str) -> int:
        words, enc = self.automaton.words, self.automaton.encode_word
        return sum([len(words.get(w) or enc(w)) for w in self.split(text)])

    def decode(self, ids) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return encoder_of(_bytes_of(path))


@lru_cache(2)
def encoder_of(data: bytes) -> Encoder:
    return Encoder(ranks_of(data))


def _shipped(df: DataFrame, path: str | None):
    """The rank file, read in the driver and sent to the workers, which need no file of their own."""
    return df.sparkSession.sparkContext.broadcast(_bytes_of(path or vocabulary(df.sparkSession)))


def vocabulary(spark, name: str = "byte_bpe_50k") -> str:
    """Path of a rank file; the folder is the session setting ``pageloom.tokenizers``, else the one of the image."""
    return os.path.join(spark.conf.get("pageloom.tokenizers", None) or TOKENIZER_DIR, f"{name}.tiktoken")


def token_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, ids array<int>): the ids of every text, without special tokens.

    Null text gives a null array and empty text an empty one; strings of special tokens in a text are ordinary text. Texts
    are encoded whole, whatever their length; there is no shuffle.
    """
    file = _shipped(docs, path)

    def run(batches):
        enc = encoder_of(file.value)
        for b in batches:
            ids = [None if t is None else enc.ids(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            offsets[1:] = np.cumsum([0 if x is None else len(x) for x in ids])
            flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, n_tokens bigint): length of every text in tokens; null text counts 0."""
    file = _shipped(docs, path)

    def run(batches):
        enc = encoder_of(file.value)
        for b in batches:
            n = [0 if t is None else enc.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decoded(tokens: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text) from (key, ids): the inverse of ``token_ids`` for texts that are valid Unicode."""
    file = _shipped(tokens, path)

    @F.pandas_udf(T.StringType())
    def text_of(ids: pd.Series) -> pd.Series:
        enc = encoder_of(file.value)
        return pd.Series([None if x is None else enc.decode(x) for x in ids], dtype=object)

    return tokens.select(key, text_of("ids").alias("text"))
