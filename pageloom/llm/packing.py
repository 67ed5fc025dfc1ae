"""Filling fixed-capacity containers with items.

Pattern packing by non-negative least squares. The lengths are folded into a histogram of at most ``capacity`` entries,
however many items there are; on it, patterns of up to three lengths that fill a container exactly are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded down, and what is left is packed largest
first into the tightest space. Short items are bundled by equal length, and the commonest lengths take part in any number, so
that patterns of three reach far.
The plan (patterns and repeats) is as small as the histogram; items get their place from their rank among the items of the
same length, which is counted in salted blocks, so that no length, however frequent, passes through one task.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Resolution of the fit: lengths count in units of capacity / BINS, rounded up.
BINS = 512
#: Lengths that give pieces of any number of items.
HOT = 4
#: Fewest blocks in which the items of one length are counted; more where the session shuffles over more partitions.
SALTS = 64


#: Container sizes a table may have: it is a list of settings.
MOST_CAPACITIES = 1000


def fit_patterns(size: np.ndarray, row: np.ndarray, times: np.ndarray, hist: np.ndarray, full: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (k, 3) of pieces that fill a container of ``full`` units exactly (-1 = unused), and their fitted repeats.

    Piece i takes ``size[i]`` units and holds ``times[i]`` items of row ``row[i]`` of the histogram; ``hist[r]`` counts the items of
    a row. Minimises |A x - hist| over x >= 0 by accelerated projected gradient; each column of A has at most three entries, so
    that a step is two passes over the index arrays.
    """
    n = len(size)
    at = np.full(full + 1, -1)
    plain = np.flatnonzero(times == 1)
    at[size[times > 1]] = np.flatnonzero(times > 1)
    at[size[plain]] = plain
    a, b = np.triu_indices(n)
    c = full - size[a] - size[b]
    third = np.where(c > 0, at[np.clip(c, 0, full)], -1)
    ok = (c == 0) | ((c > 0) & (third >= 0) & (third >= b))
    pats = np.stack([a[ok], b[ok], third[ok]], 1)
    alone = np.flatnonzero(size == full)
    pats = np.vstack([pats, np.stack([alone, np.full(len(alone), -1), np.full(len(alone), -1)], 1)])
    if not len(pats):
        return pats, np.zeros(0)
    used = pats >= 0
    rows, coef = np.where(used, row[pats], 0), np.where(used, times[pats], 0).astype(float)
    heavy = np.zeros(len(hist))
    np.maximum.at(heavy, row, size / times / full)
    weight = 0.2 + heavy  # long items matter more
    target = hist * weight

    def forward(x):
        y = np.zeros(len(hist))
        for k in range(3):
            y += np.bincount(rows[:, k], weights=x * coef[:, k], minlength=len(hist))
        return y * weight

    def backward(r):
        return ((r * weight)[rows] * coef).sum(1)

    v = np.ones(len(pats))
    step = 1.0
    for _ in range(15):
        v = backward(forward(v))
        step = np.linalg.norm(v)
        v /= step
    x = z = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - backward(forward(z) - target) / step)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return pats, x


def plan(counts: dict[int, int], capacity: int, bins: int = BINS) -> list[tuple[dict[int, int], int]]:
    """(items by length, repeats): how many containers hold which lengths. Every item is placed, none is split.

    ``counts``: number of items by length, 1 .. capacity. The fitted patterns come first, then the packing of what they leave:
    two ways of it are tried, and the one with fewer containers is taken.
    """
    fitted, left = _by_patterns(counts, capacity, bins)
    return fitted + min((_residual(dict(left), capacity, hot) for hot in (True, False)), key=lambda o: sum(m for _, m in o))


def _by_patterns(counts: dict[int, int], capacity: int, bins: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Containers by fitted patterns, and the items they leave.

    Lengths of a unit share a row. A row gives one piece of an item, or of a bundle of equal short items (at most a third of
    the container); the lengths with most of the mass (HOT) are rows of their own and give a piece of every number that fits.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    width = -(-capacity // bins)
    full = capacity // width
    units = lambda n: -(-n // width)
    total = sum(s * n for s, n in left.items())
    hot = [s for s in sorted(left, key=lambda s: -s * left[s])[:HOT] if s * left[s] >= total / 50]
    rows: list[list[int]] = [[s] for s in hot]  # lengths of a row
    pieces = [(units(q * s), r, q, q) for r, s in enumerate(hot) for q in range(1, capacity // s + 1)]  # units, row, times, items
    by_unit: dict[tuple[int, int], int] = {}
    for s in sorted(set(left) - set(hot), reverse=True):
        q = max(1, capacity // (3 * s))
        if left[s] >= q and units(s * q) <= full:
            key = (units(s * q), q)
            if key not in by_unit:
                by_unit[key] = len(rows)
                pieces.append((key[0], len(rows), 1, q))
                rows.append([])
            rows[by_unit[key]].append(s)
    if not pieces:
        return out, left
    items = {p[1]: p[3] for p in pieces if p[1] >= len(hot)}  # of a bundle, by row
    hist = np.array([sum(left[s] // items.get(r, 1) for s in ss) for r, ss in enumerate(rows)], dtype=float)
    size, row, times, number = (np.array(c) for c in zip(*pieces))
    pats, reps = fit_patterns(size, row, times, hist, full)
    for k in np.argsort(-reps, kind="stable"):
        n = int(reps[k])
        while n > 0:
            want: dict[int, int] = {}  # items by length of one container of this pattern
            for p in pats[k]:
                if p >= 0:
                    q = int(number[p])
                    s = next((s for s in rows[row[p]] if left[s] - want.get(s, 0) >= q), None)
                    if s is None:
                        want = {}
                        break
                    want[s] = want.get(s, 0) + q
            if not want:
                break
            m = min(n, *(left[s] // q for s, q in want.items()))
            out.append((want, m))
            n -= m
            for s, q in want.items():
                left[s] -= q * m
    return out, left


def _residual(left: dict[int, int], capacity: int, hot: bool) -> list[tuple[dict[int, int], int]]:
    """Largest first, each space filled by the largest item that still fits. With ``hot``, the length that holds most of what
    is left is tried first, in up to eight pieces, where that wastes less (a choice among good containers; nothing is left out)."""
    out: list[tuple[dict[int, int], int]] = []
    sizes = sorted(s for s, n in left.items() if n > 0)

    def fill(space: int, want: dict[int, int]) -> tuple[int, dict[int, int]]:
        at = bisect_right(sizes, space)
        while at:
            s = sizes[at - 1]
            q = min(left[s] - want.get(s, 0), space // s)
            if q > 0:
                want[s] = want.get(s, 0) + q
                space -= q * s
            at = min(at - 1, bisect_right(sizes, space))
        return space, want

    while sizes:
        top, common = sizes[-1], max(sizes, key=lambda s: (s * left[s], s))
        options = [fill(capacity, {})]
        for q in range(1, min(8, (capacity - top) // common, left[common] - (top == common)) + 1 if hot else 1):
            start = {top: 1}
            start[common] = start.get(common, 0) + q
            options.append(fill(capacity - top - q * common, start))
        _, want = min(options, key=lambda o: (o[0], -o[1].get(common, 0)))
        m = min(left[s] // q for s, q in want.items())
        out.append((want, m))
        for s, q in want.items():
            left[s] -= q * m
            if not left[s]:
                sizes.remove(s)
    return out


def _slots(plans: list[tuple[int, int, list[tuple[dict[int, int], int]]]]) -> pd.DataFrame:
    """One row per (capacity, length, pattern): the ranks [first, ...) of that length go to containers from ``base`` on."""
    rows, base = [], 1
    for cap_id, _, pats in plans:
        seen: dict[int, int] = {}
        for want, m in pats:
            for s, q in want.items():
                rows.append((cap_id, s, seen.get(s, 0), base, q))
                seen[s] = seen.get(s, 0) + q * m
            base += m
    return pd.DataFrame(rows, columns=["cap", "len", "first", "base", "per"])


def packed(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(capacity_id, container, key, part, n_tokens): a place for every item and every capacity.

    An item longer than the capacity is cut into full parts and a rest; part counts from 0. Items of null or no length take
    no room and get no place; capacities that are null or below 1 are left out; a key in several rows counts once, with its
    greatest length. Containers are numbered from 1 over all capacities, without gaps.
    """
    spark = sizes.sparkSession
    found = capacities.select("capacity_id", "capacity").distinct().limit(MOST_CAPACITIES + 1).collect()
    if len(found) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    caps = [(int(r[0]), int(r[1])) for r in found if r[0] is not None and (r[1] or 0) > 0]
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = sizes.filter(F.col(key).isNotNull() & (F.col(size) > 0)).groupBy(key).agg(F.max(size).alias("_n"))
    kinds = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(c).cast("long").alias("c")) for i, c in sorted(caps)])
    schema = f"capacity_id long, container long, {key} {dict(sizes.dtypes)[key]}, part int, {size} long"
    if not caps:
        return spark.createDataFrame([], schema)
    parts = (
        one.select(key, "_n", F.explode(kinds).alias("_k"))
        .select(key, "_n", F.col("_k.id").alias("_cap"), F.col("_k.c").alias("_c"), F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / F.col("_k.c")).cast("int"))).alias("part"))
        .select(key, "part", "_cap", F.least(F.col("_c"), F.col("_n") - F.col("part") * F.col("_c")).alias("_len"))
        .withColumn("_salt", F.pmod(F.xxhash64(key, "part"), F.lit(salts)).cast("int"))
    )
    # at most capacity x salts rows, whatever the number of items
    blocks = parts.groupBy("_cap", "_len", "_salt").agg(F.count("*").alias("_m"))
    before = Window.partitionBy("_cap", "_len").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    counts: dict[int, dict[int, int]] = {}
    for r in blocks.groupBy("_cap", "_len").agg(F.sum("_m").alias("n")).collect():
        counts.setdefault(r[0], {})[int(r[1])] = int(r[2])
    table = _slots([(i, c, plan(counts.get(i, {}), c)) for i, c in sorted(caps)])
    index = {k: (g["first"].to_numpy(), g["base"].to_numpy(), g["per"].to_numpy()) for k, g in table.groupby(["cap", "len"])}

    rank = F.row_number().over(Window.partitionBy("_cap", "_len", "_salt").orderBy(key, "part")) - 1
    ranked = (
        parts.withColumn("_rank", rank)
        .join(blocks.select("_cap", "_len", "_salt", "_before"), ["_cap", "_len", "_salt"])
        .select(F.col("_cap"), F.col("_len"), (F.col("_rank") + F.col("_before")).alias("_r"), key, "part")
    )

    def place(frames):
        for f in frames:
            box = np.empty(len(f), dtype=np.int64)
            for k, rows in f.groupby(["_cap", "_len"], sort=False).indices.items():
                first, base, per = index[k]
                r = f["_r"].to_numpy()[rows]
                at = np.searchsorted(first, r, side="right") - 1
                box[rows] = base[at] + (r - first[at]) // per[at]
            yield pd.DataFrame({"capacity_id": f["_cap"], "container": box, key: f[key], "part": f["part"], size: f["_len"]})

    return ranked.mapInPandas(place, schema)
