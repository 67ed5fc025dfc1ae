"""Near-duplicate records with small edits: a chosen-path set similarity join.

A record is the set of its runs of three consecutive words, embedded as ``COORDS`` minwise tokens. A tree starts from a
root that branches by a few of these coordinates; all records with the same token at a branch share a node. A node with few
members is compared exhaustively; a larger one branches again by two coordinates picked by its own path (two, because at a
similarity of one half every branch keeps a pair with probability one half). ``ROOTS`` independent root branches bring the
recall at the threshold above 0.98; more similar pairs are found almost surely. What the sketch lets through is checked
exactly on the word runs themselves, so that every row returned is right.

Many variants of one text would stay together in every node. So a node first looks for balls: records that are all but equal to
one of a few pivots, which are those nearest to the commonest value of every token. Two records within a distance of (1 - t) / 2 of a pivot are within 1 - t of each other (Jaccard distance
is a metric), so that a ball stands for all pairs in it and costs a row a member; only pairs that no ball covers are compared,
and the node needs no branching if these are few.

For Spark: texts with equal words are one class and enter once; only some 40 bytes a row and root are shuffled; the rows of a
partition arrive sorted by node, so that whole batches of nodes branch and compare as array operations. A node of more than
``WIDE`` members never has to fit in a task: its rows are passed on as rows of its children and shuffled again in a next round.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .normalize import readable_form

#: Words in a run, and the fewest words of a text that counts.
RUN, LEAST_WORDS = 3, 30
#: Minwise tokens of a record; root branches; members of a node compared exhaustively; levels of branching.
COORDS, ROOTS, LEAF, DEPTH = 48, 8, 24, 10
#: Members beyond which a node is passed on to another round instead of being branched in memory (36 bytes a member).
WIDE = 2_000_000
#: Tokens are kept to four bits for comparing. Of COORDS, how many must agree before a pair is checked exactly: 2.7 standard
#: deviations under the mean at a similarity of one half, 3.4 over the mean at one tenth.
AGREE = 16
PACKED = COORDS // 2
#: Tokens that have to agree with the pivot of a ball (the exact check decides: few may be missed, some may fail), fewest members of a ball, pivots about one centre and centres of a node; and
#: uncovered pairs a member up to which a node is settled without branching.
BALL, BALL_LEAST, PIVOTS, CENTRES, EACH = 28, 8, 16, 2, 64
#: Rows of results kept before they are handed on.
HELD = 500_000

_WORD = re.compile(r"[^\W_]+")
_WORD_ASCII = re.compile(r"[a-z0-9]+")
_U = np.uint64


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 31, COORDS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, COORDS, dtype=np.int64).astype(np.uint32)


#: Equal halves of a byte, from the exclusive or of two bytes.
_ALIKE = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], dtype=np.uint8)


class _WordHashes(dict):
    """Stable 64-bit hash of a word, kept per worker; emptied when large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"), 7)
        return h


_hash_of = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def word_hashes(text: str) -> np.ndarray:
    form = readable_form(text).lower()
    words = (_WORD_ASCII if form.isascii() else _WORD).findall(form)
    get = _hash_of
    return np.array([get[w] for w in words], dtype=_U)


def run_hashes(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the runs of RUN words. Two different runs of a pair of texts fall together with a
    probability of some 1e-6 a pair, and then move its similarity by one run."""
    if len(words) < RUN:
        return np.empty(0, np.uint32)
    h = words[:-2] * _U(0x9E3779B97F4A7C15) + words[1:-1] * _U(0xC2B2AE3D27D4EB4F) + words[2:] * _U(0x165667B19E3779F9)
    return np.unique((_mix(h) >> _U(32)).astype(np.uint32))


def _signatures(batches):
    """(id, digest of the words, root tokens and four bits of every token)."""
    import xxhash

    a, b = _functions()
    for batch in batches:
        ids, digests, sigs = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = word_hashes(text)
            if len(w) < LEAST_WORDS:
                continue
            m = (run_hashes(w)[:, None] * a + b).min(axis=0)
            four = (m * np.uint32(0x9E3779B1)) >> np.uint32(28)
            ids.append(i)
            digests.append(xxhash.xxh3_128_digest(w.tobytes()))
            sigs.append(m[:ROOTS].tobytes() + (four[::2] << np.uint32(4) | four[1::2]).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["_id", "_digest", "_sig"])


def _mix_node(node: np.ndarray, salt: int) -> np.ndarray:
    return _mix(node + _U(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))


def _roots(batches):
    """Each record once per root branch: (node, level, id, eight bits of each token)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, 4 * ROOTS + PACKED)
        tokens = np.ascontiguousarray(sig[:, : 4 * ROOTS]).view(np.uint32)
        short = pa.array([x.tobytes() for x in sig[:, 4 * ROOTS :]], pa.binary())
        for r in range(ROOTS):
            node = _mix_node(tokens[:, r].astype(_U), r + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(n, 1, np.int32)), batch.column(0), short], names=["_node", "_level", "_id", "_short"])


def _children(node: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node keys of the two branches of each row; the coordinate depends on the node's path only."""
    rows = np.arange(len(node))
    out = []
    for branch in (1, 2):
        at = _mix_node(node, 100 + branch)
        c = (at % _U(COORDS)).astype(np.int64)
        token = (short[rows, c >> 1] >> (4 * (1 - (c & 1))).astype(np.uint8)) & np.uint8(15)
        out.append(_mix(at + token.astype(_U) * _U(0x9E3779B97F4A7C15)))
    return out[0], out[1]


def _compare(order: np.ndarray, start: np.ndarray, short: np.ndarray, found: list) -> None:
    """All pairs within the runs of ``order`` that begin where ``start`` is true."""
    group = np.cumsum(start)
    d = 1
    while True:
        same = np.flatnonzero(group[d:] == group[:-d]) if d < len(group) else ()
        if not len(same):
            return
        i, j = order[same], order[same + d]
        keep = _ALIKE[short[i] ^ short[j]].sum(axis=1) >= AGREE
        if keep.any():
            found.append(np.stack([i[keep], j[keep]], 1))
        d += 1


def _agree(short: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _ALIKE[short ^ one].sum(axis=1)


def _centre(short: np.ndarray) -> np.ndarray:
    """The commonest value of each token."""
    out = np.empty(PACKED, np.uint8)
    for c in range(PACKED):
        both = np.bincount(short[:, c], minlength=256).reshape(16, 16)
        out[c] = both.sum(1).argmax() << 4 | both.sum(0).argmax()
    return out


def _open_pairs(mask: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of pairs that no ball covers, distinct masks, the mask of each row, which masks share no ball)."""
    masks, group, size = np.unique(mask, return_inverse=True, return_counts=True)
    apart = (masks[:, None] & masks[None, :]) == 0
    own = size[masks == 0].sum()
    return int(((apart * np.outer(size.astype(float), size)).sum() - own) / 2), masks, group, apart


def _settle(idx: np.ndarray, short: np.ndarray, found: list, stars: list, last: bool) -> bool:
    """Balls and uncovered pairs of one node, whose members are ``idx`` in order of their keys; False if so many pairs are left
    uncovered that the node should branch (never where ``last``)."""
    s, n = short[idx], len(idx)
    mask, balls = np.zeros(n, np.uint32), []
    open_pairs = n * (n - 1) / 2
    # a few members tell whether many are alike at all
    if not last and max((_agree(s, s[at]) >= BALL).sum() for at in (0, n // 2, n - 1)) < BALL_LEAST:
        return False
    for _ in range(CENTRES):
        rest = np.flatnonzero(mask == 0)
        if len(rest) < BALL_LEAST or open_pairs <= n:
            break
        central = _agree(s[rest], _centre(s[rest]))
        if central.max() < BALL + COORDS // 4:
            break  # nothing that many are close to
        for at in rest[np.argsort(-central, kind="stable")[:PIVOTS]]:
            ball = np.flatnonzero(_agree(s, s[at]) >= BALL)
            if len(ball) >= BALL_LEAST:
                mask[ball] |= np.uint32(1 << len(balls))
                balls.append((at, ball))
                open_pairs = _open_pairs(mask)[0]
                if open_pairs <= n:
                    break
    open_pairs, masks, group, apart = _open_pairs(mask)
    if open_pairs > EACH * n and not last:
        return False
    for at, ball in balls:
        stars.append(np.stack([np.full(len(ball), idx[at]), idx[ball]], 1))
    if open_pairs:
        members = [np.flatnonzero(group == g) for g in range(len(masks))]
        for i in range(len(masks)):
            for j in range(i, len(masks)):
                if not apart[i, j]:
                    continue
                a, b = (members[i], members[j]) if len(members[i]) <= len(members[j]) else (members[j], members[i])
                for k, x in enumerate(a):
                    rest = b[k + 1 :] if i == j else b
                    hit = rest[_agree(s[rest], s[x]) >= AGREE]
                    if len(hit):
                        found.append(np.stack([np.full(len(hit), idx[x]), idx[hit]], 1))
    return True


def _explore(node: np.ndarray, level: int, short: np.ndarray):
    """Branches and compares the rows of complete nodes, given in order of their keys; yields (pairs, stars) as lists of index
    arrays, a star being a pivot and a member of its ball."""
    rows = np.arange(len(node))
    found: list = []
    stars: list = []
    while len(rows):
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        start = np.empty(len(rows), bool)
        start[0] = True
        np.not_equal(node[1:], node[:-1], out=start[1:])
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(rows)))
        each = np.repeat(size, size)
        small = (each >= 2) & (each <= LEAF)
        if small.any():
            _compare(rows[small], start[small], short, found)
        branch = np.zeros(len(rows), bool)
        for a, n in zip(at[size > LEAF], size[size > LEAF]):
            members = np.unique(rows[a : a + n])
            if not _settle(members, short, found, stars, level >= DEPTH):
                branch[a : a + n] = True
            if sum(map(len, found)) + sum(map(len, stars)) > HELD:
                yield found, stars
                found, stars = [], []
        rows, node = rows[branch], node[branch]
        one, two = _children(node, short[rows])
        rows, node = np.concatenate([rows, rows]), np.concatenate([one, two])
        level += 1
    yield found, stars


_NODES = "_node long, _level int, _id long, _short binary, _b long, _ball boolean"


def _nodes(batches):
    """Rows sorted by node and key to pairs (``_node`` null), members of balls (``_ball``) and, of nodes that are too wide,
    rows of their children."""
    names = [x.split()[0] for x in _NODES.split(", ")]

    def result(ids, found, ball):
        both = ids[np.concatenate(found)]
        both = np.unique(both if ball else np.sort(both, axis=1), axis=0)
        n = len(both)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(both[:, 0]), pa.nulls(n, pa.binary()), pa.array(both[:, 1]), pa.array(np.full(n, ball))], names=names)

    def passed_on(node, level, ids, short):
        blobs, n = [x.tobytes() for x in short], len(ids)
        for child in _children(node.view(_U), short):
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array((level + 1).astype(np.int32)), pa.array(ids), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=names)

    def work(node, level, ids, short):
        for lv in np.unique(level):
            at = np.flatnonzero(level == lv)
            for found, stars in _explore(node[at].view(_U), int(lv), short[at]):
                if found:
                    yield result(ids[at], found, False)
                if stars:
                    yield result(ids[at], stars, True)

    def joined(parts):
        return tuple(np.concatenate(c) for c in zip(*parts))

    parts: list = []  # batches whose last node may go on
    wide = None  # a node that is being passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = (
            batch.column(0).to_numpy(zero_copy_only=False),
            batch.column(1).to_numpy(zero_copy_only=False),
            batch.column(2).to_numpy(zero_copy_only=False),
            np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, PACKED),
        )
        if wide is not None:
            other = np.flatnonzero(cols[0] != wide)
            k = int(other[0]) if len(other) else len(cols[0])
            if k:
                yield from passed_on(*(c[:k] for c in cols))
                cols = tuple(c[k:] for c in cols)
            if not len(cols[0]):
                continue
            wide = None
        open_at = int(np.flatnonzero(cols[0] == cols[0][-1])[0])  # the last node may go on in the next batch
        if open_at or parts and parts[-1][0][-1] != cols[0][0]:
            yield from work(*joined([*parts, tuple(c[:open_at] for c in cols)]))
            parts = []
        parts.append(tuple(c[open_at:] for c in cols))
        if sum(len(x[0]) for x in parts) > WIDE and parts[0][1][0] < DEPTH:
            wide = parts[0][0][0]
            for x in parts:
                yield from passed_on(*x)
            parts = []
    if parts:
        yield from work(*joined(parts))


def _word_runs(batches):
    for batch in batches:
        runs = [run_hashes(word_hashes(t)).view(np.int32) for t in batch.column(1).to_pylist()]
        offsets = np.zeros(len(runs) + 1, dtype=np.int32)
        offsets[1:] = np.cumsum([len(x) for x in runs])
        flat = pa.array(np.concatenate(runs) if runs else np.empty(0, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["_id", "_runs"])


def signed(docs: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(_id, _digest, _sig): the records that count, with a digest of their words. Materialised; null keys are left out."""
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).filter("_id is not null and _text is not null")
    return cut(rows.mapInArrow(_signatures, "_id long, _digest binary, _sig binary"))


def classes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (_id, _sig) per class of equal words, under its least key, and (_id, _rep, _copies) for every record of a
    class of several. Copies are counted with map-side combine; single records have no second row."""
    one = members.groupBy("_digest").agg(F.min("_id").alias("_rep"), F.max("_id").alias("_last"), F.min("_sig").alias("_sig"))
    one = cut(one)
    several = one.filter("_rep <> _last").select("_digest", "_rep")
    copies = cut(members.select("_id", "_digest").join(several, "_digest").select("_id", "_rep").distinct())
    return one.select(F.col("_rep").alias("_id"), "_sig"), copies


def class_links(docs: DataFrame, reps: DataFrame, key: str = "file_id", text: str = "content", threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) and (ball, member): the links between class representatives (least keys), materialised.

    Two representatives are linked (similarity of at least ``threshold``) iff they are a pair or members of the same ball. A
    ball is named by its pivot, which is a member; each of its members is exactly checked to lie within half the distance
    of its pivot. A pair may also lie in a ball.
    """
    rows = reps.select("_id", "_sig").mapInArrow(_roots, "_node long, _level int, _id long, _short binary")
    found = None
    while True:
        out = cut(rows.repartition("_node").sortWithinPartitions("_node", "_id").mapInArrow(_nodes, _NODES))
        new = out.filter("_node is null").select(F.col("_id").alias("a"), F.col("_b").alias("b"), "_ball")
        found = new if found is None else found.unionByName(new)
        rows = out.filter("_node is not null").select("_node", "_level", "_id", "_short")
        if rows.isEmpty():
            break
    found = cut(found.filter("a <> b").distinct())
    checked = cut(_similarities(docs, found, key, text))
    near = (1 + threshold) / 2
    balls = checked.filter(F.col("_ball") & (F.col("similarity") >= near)).select(F.col("a").alias("ball"), F.col("b").alias("member"))
    balls = cut(balls.unionByName(balls.select("ball", F.col("ball").alias("member"))).distinct())
    links = checked.filter(F.col("similarity") >= threshold).filter(~F.col("_ball") | (F.col("similarity") < near))
    # a candidate that isn't near enough to its pivot counts for itself: against every candidate of that ball
    stray = checked.filter(F.col("_ball") & (F.col("similarity") < near)).select(F.col("a").alias("ball"), F.col("b").alias("x"))
    if not stray.isEmpty():
        more = stray.join(checked.filter("_ball").select(F.col("a").alias("ball"), F.col("b").alias("y")), "ball").filter("x <> y")
        more = cut(more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(False).alias("_ball")).distinct())
        links = links.unionByName(_similarities(docs, more, key, text).filter(F.col("similarity") >= threshold))
    return cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()), balls


def _similarities(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, _ball, similarity) of materialised candidates, by the word runs of their texts."""
    wanted = found.select(F.col("a").alias("_id")).union(found.select("b")).distinct()
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).filter("_text is not null")
    sets = cut(texts.join(wanted, "_id", "left_semi").dropDuplicates(["_id"]).mapInArrow(_word_runs, "_id long, _runs array<int>"))
    left = sets.select(F.col("_id").alias("a"), F.col("_runs").alias("_ra"))
    right = sets.select(F.col("_id").alias("b"), F.col("_runs").alias("_rb"))
    common = F.size(F.array_intersect("_ra", "_rb"))
    return (
        found.join(left, "a")
        .join(right, "b")
        .select("a", "b", "_ball", common.alias("_n"), (F.size("_ra") + F.size("_rb")).alias("_all"))
        .select("a", "b", "_ball", (F.col("_n") / (F.col("_all") - F.col("_n"))).alias("similarity"))
    )


def _within(groups: DataFrame, of: str, member: str) -> DataFrame:
    """(x, y): the pairs within each group, x < y. Members are dealt into blocks of some 2,000 by the size of the group, and
    two blocks meet in a task of their own, so that no task takes a whole large group."""
    size = groups.groupBy(F.col(of).alias("_g")).agg(F.ceil(F.count("*") / 2000).cast("int").alias("_k"))
    rows = groups.join(size, F.col(of) == F.col("_g")).select("_g", F.col(member).alias("_m"), "_k", F.pmod(F.xxhash64(member), F.col("_k")).cast("int").alias("_s"))
    x = rows.select("_g", F.col("_m").alias("x"), F.col("_s").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_j"))
    y = rows.select("_g", F.col("_m").alias("y"), F.col("_s").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i"))
    return x.join(y, ["_g", "_i", "_j"]).filter("x < y").select("x", "y")


def similar_pairs(docs: DataFrame, key: str = "file_id", text: str = "content", threshold: float = 0.5) -> DataFrame:
    """Pairs of keys with similarity of at least ``threshold``, the smaller key first; copies and balls are expanded.

    Null and empty texts and texts of fewer than 30 words never count; a key in several rows counts once; keys must be
    integers. An empty table gives no rows.
    """
    reps, several = classes(signed(docs, key, text))
    links, balls = class_links(docs, reps, key, text, threshold)
    pairs = links.select("a", "b").union(_within(balls, "ball", "member")).distinct()
    m1, m2 = (several.select(F.col("_id").alias(f"_m{k}"), F.col("_rep").alias(f"_r{k}")) for k in (1, 2))
    wide = pairs.join(m1, F.col("a") == F.col("_r1"), "left").select(F.coalesce("_m1", "a").alias("_x"), "b")
    wide = wide.join(m2, F.col("b") == F.col("_r2"), "left").select("_x", F.coalesce("_m2", "b").alias("_y"))
    equal = _within(several, "_rep", "_id").select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    return wide.union(equal).select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b")).distinct()


def _components(links: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, root): the least key that links (a, b) connect with each key that has any. Repeated minimum over neighbours with
    pointer jumping on tables; nothing of it comes to the driver but a flag a round."""
    both = cut(links.union(links.select("b", "a")).distinct())
    root = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(root.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("root").alias("_near"))
        step = root.join(near, "a").select("a", F.least("root", "_near").alias("_to"), F.col("root").alias("_old"))
        jump = step.select(F.col("a").alias("_to"), F.col("_to").alias("_next"))
        new = cut(step.join(jump, "_to", "left").select("a", F.least("_to", F.coalesce("_next", "_to")).alias("root"), "_old"))
        moved = not new.filter("root <> _old").isEmpty()
        root = new.select("a", "root")
        if not moved:
            return root


def linked(docs: DataFrame, key: str = "file_id", text: str = "content", threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Groups and links without expanding any: (groups, links).

    groups: (key, class_id, group_id, balls array<long>), one row per record that counts. ``class_id`` is the least key with
    the same words, ``group_id`` the least key of all that links connect, ``balls`` the balls its class is in.
    links: (class_id_a, class_id_b, similarity), the linked classes that share no ball. Two different records are linked iff
    they are of one class, share a ball, or their classes are in links: no link is lost and no clique is spelled out.
    """
    reps, several = classes(signed(docs, key, text))
    of = reps.select("_id", F.col("_id").alias("_rep")).union(several).distinct()
    links, balls = class_links(docs, reps, key, text, threshold)
    root = _components(links.select("a", "b").union(balls.filter("ball <> member").select("ball", "member")), reps)
    held = balls.groupBy(F.col("member").alias("_of")).agg(F.array_sort(F.collect_set("ball")).alias("balls"))
    groups = of.join(root, F.col("_rep") == F.col("a"), "left").join(held, F.col("_rep") == F.col("_of"), "left")
    groups = groups.select(F.col("_id").alias(key), F.col("_rep").alias("class_id"), F.coalesce("root", "_rep").alias("group_id"), F.coalesce("balls", F.array().cast("array<bigint>")).alias("balls"))
    left, right = (held.select(F.col("_of").alias(c), F.col("balls").alias(f"_{c}")) for c in "ab")
    apart = links.join(left, "a", "left").join(right, "b", "left").filter(~F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False)))
    return groups, apart.select(F.col("a").alias("class_id_a"), F.col("b").alias("class_id_b"), "similarity")
