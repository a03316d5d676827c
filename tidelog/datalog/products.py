"""Joins over a middle argument that are aggregated at once, as products of sparse matrices: left (x, k) with right (k, y).

The rows of such a join are the wedges of a graph, many times its edges, so they are never shuffled or written. Left is dealt
into blocks of x, right into blocks of k, both by ranges, and a task takes one block of each, with right's rows only where
left's block has their k. It goes through the wedges a few million at a time and gives back what they come to. A task's
memory is bounded by the two blocks, what is shuffled by left's rows and right's rows times the blocks of x that need them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block: a share of all, between these. Wedges that a task looks at together.
SHARE, LEAST, MOST, WEDGES = 64, 50_000, 4_000_000, 2_000_000


def bounds(frame: DataFrame, column: str, rows: int, share: int) -> list[float]:
    """Where the blocks of a column's values begin, without the first."""
    number = -(-rows // min(MOST, max(LEAST, rows // share)))
    found = frame.approxQuantile(column, [k / number for k in range(1, number)], 0.2 / number) if number > 1 else []
    return sorted(set(found))


def block(frame: DataFrame, column: str, name: str, splits: list[float]) -> DataFrame:
    # a double may not tell long values apart, but equal ones get one block
    cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_value", outputCol="_block")
    wide = frame.withColumn("_value", F.col(column).cast("double"))
    return cut.transform(wide).withColumn(name, F.col("_block").cast("long")).drop("_value", "_block") if splits else frame.withColumn(name, F.lit(0).cast("long"))


def meeting(left: DataFrame, right: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Columns g, side, a, b, v: blocks of left (0: x, k, v), right (1: k, y, v) and mask (2: x, y) that belong together, in order."""
    left, right = left.where("k IS NOT NULL"), right.where("k IS NOT NULL")
    xs, ks = bounds(left, "x", left.count(), SHARE), bounds(right, "k", right.count(), 1)
    own = block(block(left, "x", "i", xs), "k", "j", ks)
    there = block(right, "k", "j", ks).join(own.select("i", "k").distinct(), "k")
    g = (F.col("i") * (len(ks) + 1) + F.col("j")).alias("g")
    parts = [own.select(g, F.lit(0).alias("side"), F.col("x").alias("a"), F.col("k").alias("b"), "v"), there.select(g, F.lit(1), "k", "y", "v")]
    if mask is not None:
        met = block(mask, "x", "i", xs).join(own.select("i", "j").distinct(), "i")
        parts.append(met.select(g, F.lit(2), "x", "y", F.lit(0).cast("long")))
    together = parts[0]
    for p in parts[1:]:
        together = together.union(p)
    return together.repartition(max(24, 2 * (len(xs) + len(ks) + 1)), "g").sortWithinPartitions("g", "side")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Each group's three sides, as arrays a, b and v."""
    now, held = None, [[], [], []]
    joined = lambda: [tuple(np.concatenate(c) for c in zip(*side, strict=True)) if side else tuple(np.empty(0, np.int64) for _ in range(3)) for side in held]
    for batch in batches:
        g, side, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(g)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if g[start] != now:
                if now is not None:
                    yield joined()
                now, held = g[start], [[], [], []]
            held[side[start]].append([c[start:end] for c in rest])
    if now is not None:
        yield joined()


class Wedges:
    """The wedges of a block of left and one of right. ids: the values of x and y by their codes."""

    def __init__(self, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]):
        order = np.argsort(right[0], kind="stable")
        self.middle, starts = np.unique(right[0][order], return_index=True)
        self.ys, y = np.unique(right[1], return_inverse=True)
        self.y, self.w = y[order], right[2][order]
        starts = np.append(starts, len(order))
        place = np.minimum(np.searchsorted(self.middle, left[1]), max(0, len(self.middle) - 1))
        kept = self.middle[place] == left[1] if len(self.middle) else np.zeros(len(left[1]), bool)
        order = np.argsort(left[0][kept], kind="stable")
        self.xs, self.x = np.unique(left[0][kept][order], return_inverse=True)
        self.k, self.v = place[kept][order], left[2][kept][order]
        self.start, self.length = starts[self.k], starts[self.k + 1] - starts[self.k]

    def spans(self) -> Iterator[tuple[int, int]]:
        """Ranges of left's rows that hold whole xs, of about WEDGES wedges or one x."""
        firsts = np.append(np.flatnonzero(np.diff(self.x, prepend=-1)), len(self.x))
        total = np.append(0, np.cumsum(self.length))[firsts]
        at = 0
        while at < len(firsts) - 1:
            to = max(at + 1, int(np.searchsorted(total, total[at] + WEDGES, side="right")) - 1)
            yield int(firsts[at]), int(firsts[to])
            at = to

    def pieces(self, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of left and of right for each wedge of a span, not more than about WEDGES at once."""
        total = np.append(0, np.cumsum(self.length[start:end]))
        at = 0
        while at < end - start:
            to = max(at + 1, int(np.searchsorted(total, total[at] + WEDGES, side="right")) - 1)
            n = self.length[start + at : start + to]
            rows = np.repeat(np.arange(start + at, start + to), n)
            yield rows, np.arange(len(rows)) + np.repeat(self.start[start + at : start + to] - (total[at:to] - total[at]), n)
            at = to


def summed(wedges: Wedges, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y and their number of wedges (count), or the least or greatest v + w of them (min, max)."""
    ny = len(wedges.ys)
    ufunc = {"count": np.add, "min": np.minimum, "max": np.maximum}[kind]
    none = {"count": 0, "min": np.iinfo(np.int64).max, "max": np.iinfo(np.int64).min}[kind]
    for start, end in wedges.spans():
        first = wedges.x[start]
        nx = int(wedges.x[end - 1] - first) + 1
        dense = nx == 1 or nx * ny <= 4 * int(wedges.length[start:end].sum())
        best, seen = (np.full(nx * ny, none, np.int64), np.zeros(nx * ny, bool)) if dense else (None, None)
        for rows, at in wedges.pieces(start, end):
            key = (wedges.x[rows] - first) * ny + wedges.y[at]
            if dense and kind == "count":
                best += np.bincount(key, minlength=nx * ny)
                continue
            value = np.ones(len(key), np.int64) if kind == "count" else wedges.v[rows] + wedges.w[at]
            if dense:
                ufunc.at(best, key, value)
                seen[key] = True
                continue
            # not one x, so a span is one piece
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            firsts = np.flatnonzero(np.diff(key, prepend=-1))
            yield wedges.xs[first + key[firsts] // ny], wedges.ys[key[firsts] % ny], ufunc.reduceat(value, firsts)
        if dense:
            key = np.flatnonzero(best if kind == "count" else seen)
            yield wedges.xs[first + key // ny], wedges.ys[key % ny], best[key]


def product(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """x, y, value for left (x, k, v) and right (k, y, v), all longs without nulls but for k: over all k the number of pairs
    of rows (count), or the least or greatest sum of their v (min, max). Rows may repeat, and count then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, _ in groups(batches):
            if kind != "count" and sum(int(np.abs(side[2].astype(float)).max(initial=0)) for side in (left, right)) >= 2**63 - 1:
                raise OverflowError("a sum of values doesn't fit a long")
            for columns in summed(Wedges(left, right), kind):
                for at in range(0, len(columns[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000], pa.int64()) for c in columns], ["x", "y", "value"])

    rows = meeting(left, right).mapInArrow(run, "x long, y long, value long")
    return rows.groupBy("x", "y").agg({"count": F.sum, "min": F.min, "max": F.max}[kind]("value").alias("value"))


def closed(left: DataFrame, right: DataFrame, mask: DataFrame) -> DataFrame:
    """id and number: how many wedges of left (x, k) and right (k, y) that mask (x, y) closes each x, k and y is in, under end
    x, k or y. Longs; rows are distinct."""
    zero = F.lit(0).cast("long").alias("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, mask in groups(batches):
            wedges = Wedges(left, right)
            nx, ny = len(wedges.xs), len(wedges.ys)
            if not nx or not ny:
                continue
            # the mask's rows with codes, in order
            x, y = (np.minimum(np.searchsorted(ids, values), len(ids) - 1) for ids, values in ((wedges.xs, mask[0]), (wedges.ys, mask[1])))
            keys = np.sort((x * ny + y)[(wedges.xs[x] == mask[0]) & (wedges.ys[y] == mask[1])])
            numbers = [np.zeros(n, np.int64) for n in (nx, len(wedges.middle), ny)]
            for start, end in wedges.spans():
                first, last = int(wedges.x[start]), int(wedges.x[end - 1])
                own = keys[np.searchsorted(keys, first * ny) : np.searchsorted(keys, (last + 1) * ny)] - first * ny
                size = (last - first + 1) * ny
                dense = size <= 16 * WEDGES
                marks = np.zeros(size if dense else 0, bool)
                if dense:
                    marks[own] = True
                for rows, at in wedges.pieces(start, end):
                    key = (wedges.x[rows] - first) * ny + wedges.y[at]
                    hit = marks[key] if dense else own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key if len(own) else np.zeros(len(key), bool)
                    rows, at = rows[hit], at[hit]
                    for n, codes in zip(numbers, (wedges.x[rows], wedges.k[rows], wedges.y[at]), strict=True):
                        n += np.bincount(codes, minlength=len(n))
            for end, ids, n in zip("xky", (wedges.xs, wedges.middle, wedges.ys), numbers, strict=True):
                found = np.flatnonzero(n)
                for at in range(0, len(found), 100_000):
                    part = found[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([end] * len(part), pa.string()), pa.array(ids[part], pa.int64()), pa.array(n[part], pa.int64())], ["end", "id", "number"])

    rows = meeting(left.select("x", "k", zero), right.select("k", "y", zero), mask.select("x", "y")).mapInArrow(run, "end string, id long, number long")
    return rows.groupBy("end", "id").agg(F.sum("number").alias("number"))
