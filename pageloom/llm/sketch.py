"""Counts of the words of a corpus, exact by 64-bit key, and a filter of fixed size that tells which keys may be in a table.

What depends on the vocabulary of a corpus is decided by joins; only two things are ever sent to all tasks: ``BITS`` bits that
let most words pass by unasked (how full they are changes how many rows are asked for, never a result), and the words that at
least a given share of the texts has, whose number is bounded by the mean number of words of a text over that share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a filter (8 MB) and bits a key.
BITS, EACH = 1 << 26, 2


def key_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


def signed_key(word: str) -> int:
    """``key_of`` as the signed number that a column of keys holds."""
    k = key_of(word)
    return k - (1 << 64) if k >> 63 else k


class Filter:
    """A Bloom filter over 64-bit keys: never wrong about a key that is held."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def may_hold(self, key: int) -> bool:
        for r in range(EACH):
            at = key >> (26 * r) & (BITS - 1)
            if not int(self.words[at >> 6]) >> (at & 63) & 1:
                return False
        return True


def filter_of(keys: DataFrame) -> Filter:
    """The filter of the column ``key`` (long). Bits are gathered per 64-bit word by an aggregate with map-side combine; at
    most BITS / 64 numbers reach the driver, whatever the number of keys."""
    # the low half of the key gives the first place, bits 26 to 51 the second
    places = F.explode(F.array(*[F.shiftrightunsigned("key", 26 * r).bitwiseAND(BITS - 1) for r in range(EACH)])).alias("at")
    bits = keys.select(places).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))

    def packed(batches):
        for b in batches:
            if b.num_rows:
                at, x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int32), b.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["at", "bits"])

    out = np.zeros(BITS // 64, dtype=np.uint64)
    for r in bits.mapInArrow(packed, "at binary, bits binary").toLocalIterator():
        out[np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["bits"], dtype=np.uint64)
    return Filter(out)


class Counts:
    """Numbers by word, exact but for equal 64-bit keys: 12 bytes a word."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], numbers[order]

    def get(self, word: str) -> int:
        """The number of ``word``; 0 if it isn't held."""
        key = np.uint64(key_of(word))
        i = self.keys.searchsorted(key)
        return int(self.numbers[i]) if i < len(self.keys) and self.keys[i] == key else 0


def word_counts(docs: DataFrame, text: str, words_of, marks: tuple[str, ...] = ("",)) -> DataFrame:
    """(key, n0, n1 ..): for each word how often ``words_of(text)`` has it behind each of ``marks`` (of equal length), over all
    rows of ``docs`` whose text isn't null.

    Words are counted in the task first; what is shuffled are numbers, at most one row a task, mark and distinct word.
    """
    width, place = len(marks[0]), {m: i for i, m in enumerate(marks)}

    def run(batches):
        counts: dict[str, int] = {}

        def drain():
            size = len(counts)
            keys = np.fromiter((key_of(w[width:]) for w in counts), dtype=np.uint64, count=size).view(np.int64)
            at = np.fromiter((place[w[:width]] for w in counts), dtype=np.int8, count=size)
            n = np.fromiter(counts.values(), dtype=np.int64, count=size)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at), pa.array(n)], names=["key", "mark", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    for w in words_of(t):
                        counts[w] = counts.get(w, 0) + 1
            if len(counts) > 500_000:
                yield drain()
        if counts:
            yield drain()

    rows = docs.select(text).mapInArrow(run, "key long, mark byte, n long")
    return rows.groupBy("key").agg(*[F.sum(F.when(F.col("mark") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(marks))])


def frequent(rows: DataFrame, number: str, total: int, share: float) -> Counts:
    """The column ``number`` of ``rows`` by their ``key`` where it is at least ``share`` of ``total`` texts, brought to the
    driver: at most (mean number of different words of a text) / ``share`` entries, at any size of the corpus."""

    def packed(batches):
        for b in batches:
            if b.num_rows:
                keys, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["keys", "n"])

    keys, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    some = rows.filter(F.col(number) >= share * total).select("key", F.col(number).cast("long").alias("n"))
    for r in some.mapInArrow(packed, "keys binary, n binary").toLocalIterator():
        keys.append(np.frombuffer(r["keys"], dtype=np.uint64))
        n.append(np.frombuffer(r["n"], dtype=np.int64))
    return Counts(np.concatenate(keys), np.concatenate(n))
