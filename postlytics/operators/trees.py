"""Regression trees from histograms: a forest and gradient boosting as Spark jobs over binned rows.

Splits are those of Spark ML's trees (at most 32 bins a feature cut at the same
thresholds, variance gain, counts with bootstrap multiplicity), but a row is one
byte a column, columns that exclude each other (one-hot digits) share one byte,
and nothing is kept per row and tree: bootstrap counts are drawn anew from (seed,
tree, block).  A level of all trees of a forest is one job, as is a level of a
boosted tree (splits of one block are boosted in one job, and a forest of one block is grown in
one); tasks send sums per node and bin or trees, never rows.  A split is binned once for all its
models.  Blocks of many rows add up several columns in one pass and only the smaller of two
sibling nodes, from labels on a grid, so that sums and differences of sums are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.session import ship

MAX_BINS = 32
#: Rows of one task: a round boosted over several blocks is many short jobs, a task of a forest's level takes a group of
#: trees over more rows (18 bytes each), so that fewer tables of sums are shuffled; a split of FOREST_ROWS is one block to both.
BOOST_ROWS = 250_000
FOREST_ROWS = 2_000_000
#: Blocks of more rows are summed by ``Packed``, smaller ones column by column (the same trees but for ties in rounding).
PACKED_ROWS = 250_000
#: Values of one code of several columns, and rows that are added up at a time.
PACK = 1_024
CHUNK = 1 << 17
#: Rows of a partition that share a draw.
PIECE_ROWS = 10_000
#: Rows times trees of a forest's task, and the fewest trees of one.
TASK_WORK = 1_000_000
LEAST_TREES = 4
#: A boosted model's predictions are computed from all trees again after so many rounds: lineage stays short without checkpoints.
RESTART = 25
_LEAF = 255


def thresholds(values: np.ndarray, max_bins: int = MAX_BINS) -> np.ndarray:
    """Cuts of one column: midpoints of all neighbours, or those nearest to equal counts."""
    v, n = np.unique(values, return_counts=True)
    mid = (v[:-1] + v[1:]) / 2
    if len(mid) < max_bins:
        return mid
    stride, seen, cuts = len(values) / max_bins, np.cumsum(n), []
    target = stride
    for i in range(1, len(v)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            cuts.append(mid[i - 1])
            target += stride
    return np.array(cuts)


@dataclass
class Layout:
    """Columns of bytes and the splits they offer, in the order of the vector's slots."""

    columns: list[tuple[list[int], np.ndarray]]  # slots (several: each its own code) and cuts
    slot: np.ndarray  # of each split: slot and cut of the vector, column, and the bytes that go right: low < b <= high
    cut: np.ndarray
    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    slots: int

    @classmethod
    def of(cls, cuts: list[np.ndarray], together: np.ndarray) -> Layout:
        """``together``: in how many batches of rows two slots of one cut are both above it in some row."""
        columns: list[tuple[list[int], np.ndarray]] = []
        for f, t in enumerate(cuts):
            if len(t) > 1:
                columns.append(([f], t))
            elif len(t) == 1:
                last = columns[-1] if columns else None
                if last and len(last[0]) < 250 and len(cuts[last[0][0]]) == 1 and not together[f, last[0]].any():
                    columns[-1] = (last[0] + [f], np.append(last[1], t))
                else:
                    columns.append(([f], t))
        rows = []
        for c, (slots, t) in enumerate(columns):
            if len(slots) == 1:
                rows += [(slots[0], x, c, i, 254) for i, x in enumerate(t)]
            else:
                rows += [(f, x, c, i, i + 1) for i, (f, x) in enumerate(zip(slots, t))]
        slot, cut, column, low, high = zip(*rows) if rows else ((),) * 5
        return cls(columns, np.array(slot, np.int32), np.array(cut, float), np.array(column, np.int16),
                   np.array(low, np.uint8), np.array(high, np.uint8), len(cuts))

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.columns), len(x)), np.uint8)
        for c, (slots, t) in enumerate(self.columns):
            if len(slots) == 1:
                out[c] = np.searchsorted(t, x[:, slots[0]], side="left")
            else:
                for k, f in enumerate(slots):
                    out[c][x[:, f] > t[k]] = k + 1
        return out

    def sums(self, bins: np.ndarray, node: np.ndarray, weight: np.ndarray | None, y: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of every node's rows by bin, columns side by side; no ``weight``: each row counts once."""
        wy, count, total = y if weight is None else weight * y, [], []
        for (_, t), b in zip(self.columns, bins):
            k = len(t) + 1
            at = node * k + b
            count.append(np.bincount(at, weight, nodes * k).reshape(nodes, k).astype(float, copy=False))
            total.append(np.bincount(at, wy, nodes * k).reshape(nodes, k))
        return np.hstack(count), np.hstack(total)

    def best(self, count: np.ndarray, total: np.ndarray, least: int) -> Splits:
        """Each node's split of the greatest decrease in squared error (-1: none); the first of equals."""
        k = len(self.columns[0][1]) + 1
        n, s = count[:, :k].sum(1)[:, None], total[:, :k].sum(1)[:, None]
        nl, sl, at = [], [], 0
        for slots, t in self.columns:
            c, v = count[:, at:at + len(t) + 1], total[:, at:at + len(t) + 1]
            at += len(t) + 1
            nl.append(np.cumsum(c, 1)[:, :-1] if len(slots) == 1 else n - c[:, 1:])
            sl.append(np.cumsum(v, 1)[:, :-1] if len(slots) == 1 else s - v[:, 1:])
        nl, sl = np.hstack(nl), np.hstack(sl)
        nr, sr = n - nl, s - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            both = sl * sl / nl + sr * sr / nr
            gain = both - s * s / n
        ok = (nl >= max(least, 1)) & (nr >= max(least, 1)) & (gain > 1e-13 * both)
        gain = np.where(ok, gain, -1.0)
        which = gain.argmax(1)
        i = np.arange(len(which))
        return Splits(np.where(gain[i, which] > 0, which, -1), gain[i, which], nl[i, which], sl[i, which], nr[i, which], sr[i, which], n[:, 0], s[:, 0])


@dataclass
class Splits:
    split: np.ndarray
    gain: np.ndarray
    left_n: np.ndarray
    left_sum: np.ndarray
    right_n: np.ndarray
    right_sum: np.ndarray
    n: np.ndarray
    sum: np.ndarray


@dataclass
class Tree:
    """Nodes in order of levels; a node's children stand side by side, a leaf's ``left`` is itself."""

    split: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    first: int = 0  # of the last level
    depth: int = 0

    @classmethod
    def root(cls) -> Tree:
        return cls(np.array([-1]), np.array([0], np.int32), np.array([0.0]), np.array([0.0]))

    @property
    def open(self) -> int:
        return len(self.left) - self.first

    def grow(self, s: Splits) -> None:
        """Splits of the last level's nodes; their children become the last level."""
        if self.depth == 0 and s.n[0]:
            self.value[0] = s.sum[0] / s.n[0]
        size, first = len(self.left), self.first
        self.split[first:] = s.split
        done = np.flatnonzero(s.split >= 0)
        self.gain[first + done] = s.gain[done]
        self.left[first + done] = size + 2 * np.arange(len(done))
        value = np.column_stack([s.left_sum[done] / s.left_n[done], s.right_sum[done] / s.right_n[done]]).ravel()
        new = len(value)
        self.split = np.append(self.split, np.full(new, -1))
        self.left = np.append(self.left, np.arange(size, size + new, dtype=np.int32))
        self.value, self.gain = np.append(self.value, value), np.append(self.gain, np.zeros(new))
        self.first, self.depth = size, self.depth + (new > 0)

    def binned(self, layout: Layout) -> tuple:
        """What ``route`` needs."""
        inner, at = self.split >= 0, np.maximum(self.split, 0)
        return (layout.column[at], np.where(inner, layout.low[at], _LEAF).astype(np.uint8), layout.high[at], self.left, self.depth)


def route(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The node of every row."""
    column, low, high, left, depth = tree
    n = bins.shape[1]
    flat, row, node = bins.ravel(), np.arange(n), np.zeros(n, np.int32)
    for _ in range(depth):
        b = flat.take(column.take(node) * np.int64(n) + row)
        node = left.take(node) + ((b > low.take(node)) & (b <= high.take(node)))
    return node


def _dense(column) -> np.ndarray:
    """Rows of a column of arrays or of ML vectors (type, size, indices, values), of which sparse ones cross as they are."""
    import pyarrow as pa

    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    if not pa.types.is_struct(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    kind, size, indices, values = (column.field(i) for i in range(4))
    n, sparse = len(column), kind.to_numpy(zero_copy_only=False) == 0
    per = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    slots = int(size[int(sparse.argmax())].as_py()) if sparse.any() else int(per[0])
    row, value = np.repeat(np.arange(n), per), values.flatten().to_numpy(zero_copy_only=False)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    slot[np.repeat(sparse, per)] = indices.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((n, slots))
    out[row, slot] = value
    return out


def _batches(batches: Iterable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield _dense(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)


def _values(batches: Iterable) -> Iterator:
    import pyarrow as pa

    for x, _ in _batches(batches):
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([x.shape[1]], pa.int32())], ["x", "slots"])


def _together(batches: Iterable, cuts: np.ndarray) -> Iterator:
    import pyarrow as pa

    total = np.zeros((len(cuts), len(cuts)))
    one = np.flatnonzero(np.isfinite(cuts))
    for x, _ in _batches(batches):
        above = x[:, one] > cuts[one]
        bits = np.packbits(above, axis=1)
        for f, rows in zip(one, above.T):
            total[f, one] += np.unpackbits(np.bitwise_or.reduce(bits[rows], axis=0, initial=0, dtype=np.uint8), count=len(one))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])


def _few(data: DataFrame) -> DataFrame:
    """The same rows in some tasks a core: a Python task costs as much as the rows of one small partition."""
    return data.coalesce(3 * data.sparkSession.sparkContext.defaultParallelism)


def layout_of(data: DataFrame, n: int, seed: int) -> Layout:
    """Cuts from a sample of some 10,000 rows (all, if fewer) as in Spark ML; which columns exclude each other from all rows."""
    share = max(MAX_BINS * MAX_BINS, 10_000) / n
    sample = _few(data if share >= 1 else data.sample(share, seed)).mapInArrow(_values, "x binary, slots int").collect()
    x = np.vstack([np.frombuffer(r["x"]).reshape(-1, r["slots"]) for r in sample])
    cuts = [thresholds(c) for c in x.T]
    one = np.array([t[0] if len(t) == 1 else np.inf for t in cuts])
    parts = _few(data).mapInArrow(lambda it: _together(it, one), "m binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(len(one), -1))
    return Layout.of(cuts, parts.treeReduce(np.add))


Block = tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]  # (partition, number, rows) of its pieces; bytes; labels


def blocks(data: DataFrame, layout: Layout, n: int, rows: int) -> RDD:
    """Binned rows, one element a partition of about ``rows``; pieces (PIECE_ROWS of a partition) keep their number for draws."""
    parts, given = max(1, math.ceil(n / rows)), data.rdd.getNumPartitions()

    def encode(batches):
        import pyarrow as pa

        at, seen = None, 0  # partition and rows of it before
        for b in batches:
            p = b.column(2).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for lo, hi in zip(cut, cut[1:]):
                if lo < hi and p[lo] != at:
                    at, seen = int(p[lo]), 0
                while lo < hi:
                    to = min(hi, lo + PIECE_ROWS - seen % PIECE_ROWS)
                    x, y = next(_batches([b.slice(lo, to - lo)]))
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([seen // PIECE_ROWS], pa.int32()), pa.array([seen % PIECE_ROWS], pa.int32()),
                                                      pa.array([layout.encode(x).tobytes()]), pa.array([y.astype(float).tobytes()])], ["p", "i", "at", "b", "y"])
                    seen, lo = seen + to - lo, to

    def join(it) -> Iterator[Block]:
        got = sorted((v for _, v in it), key=lambda v: v[:3])
        if got:
            ys = [np.frombuffer(v[4]) for v in got]
            bins = [np.frombuffer(v[3], np.uint8).reshape(-1, len(y)) for v, y in zip(got, ys)]
            rows: dict[tuple[int, int], int] = {}
            for v, y in zip(got, ys):  # a piece may come in parts, as tasks read several partitions
                rows[v[:2]] = rows.get(v[:2], 0) + len(y)
            yield [(*k, n) for k, n in rows.items()], np.hstack(bins), np.concatenate(ys)

    pieces = (_few(data.withColumn("p", F.spark_partition_id())).mapInArrow(encode, "p int, i int, at int, b binary, y binary")
              .rdd.map(lambda r: (r[0] * parts // given, tuple(r))))
    return pieces.partitionBy(parts, lambda k: k).mapPartitions(join).persist(StorageLevel.MEMORY_AND_DISK)


def _draw(pieces: list, key: tuple[int, int], how: Callable) -> np.ndarray:
    return np.concatenate([how(np.random.default_rng((*key, p, i)), n) for p, i, n in pieces])


def _grown(layout: Layout, bins: np.ndarray, w: np.ndarray, y: np.ndarray, depth: int, least: int) -> Tree:
    """A tree of rows that are all here: rows go from a level to the next, nodes too small to split are not summed."""
    tree, node, can = Tree.root(), np.zeros(len(y), np.int64), np.array([True])
    for _ in range(depth):
        if not tree.open:
            break
        look = np.flatnonzero(can)
        if len(look) < len(can):
            place = np.full(len(can), -1)
            place[look] = np.arange(len(look))
            node = place[node]
            on = np.flatnonzero(node >= 0)
            bins, w, y, node = bins[:, on], w[on], y[on], node[on]
        few = layout.best(*layout.sums(bins, node, w, y, len(look)), least)
        s = Splits(*(np.full(len(can), -1, v.dtype) for v in vars(few).values()))
        for mine, found in zip(vars(s).values(), vars(few).values()):
            mine[look] = found
        tree.grow(s)
        done = few.split >= 0
        size = np.column_stack([few.left_n[done], few.right_n[done]]).ravel()
        can = size >= 2 * max(least, 1)
        child, which = np.where(done, 2 * (np.cumsum(done) - 1), -1)[node], few.split[node]
        on = np.flatnonzero(child >= 0)
        if len(on) < len(node):
            bins, w, y, child, which = bins[:, on], w[on], y[on], child[on], which[on]
        b = bins.ravel().take(layout.column.take(which) * np.int64(len(y)) + np.arange(len(y)))
        node = child + ((b > layout.low.take(which)) & (b <= layout.high.take(which)))
    return tree


def _on_grid(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Labels rounded to so many bits that their sums (``w`` times each) are exact in any order."""
    top = float(np.abs(y).sum() if w is None else np.abs(y) @ w)
    if not 0 < top < np.inf:
        return y
    scale = 51 - math.frexp(top)[1]
    return np.ldexp(np.rint(np.ldexp(y, scale)), -scale)


class Packed:
    """A block's columns side by side in codes of at most PACK values: a pass of sums serves several columns."""

    def __init__(self, layout: Layout, bins: np.ndarray):
        self.layout, self.bins, self.flat = layout, bins, bins.ravel()
        size = [len(t) + 1 for _, t in layout.columns]
        self.first = np.append(0, np.cumsum(size))
        groups: list[list[int]] = []
        for c in sorted(range(len(size)), key=lambda c: -size[c]):
            fits = [g for g in groups if math.prod(size[i] for i in g) * size[c] <= PACK]
            if fits:
                fits[0].append(c)
            else:
                groups.append([c])
        self.single = [(bins[c], (c,), (k,)) for c, k in enumerate(size)]
        self.groups = [(self._code(g, size), tuple(g), tuple(size[c] for c in g)) for g in groups]
        self.stride = max(size)

    def _code(self, columns: list[int], size: list[int]) -> np.ndarray:
        code = self.bins[columns[0]].astype(np.uint16)
        for c in columns[1:]:
            code *= np.uint16(size[c])
            code += self.bins[c]
        return code

    def sums(self, slot: np.ndarray, rows: np.ndarray, w: np.ndarray | None, wy: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of ``rows`` by slot and bin, columns side by side."""
        wide = slots * PACK <= len(rows)
        count, total = np.empty((slots, self.first[-1])), np.empty((slots, self.first[-1]))
        parts = self.groups if wide else self.single
        found: list[list] = [[None, None] for _ in parts]
        step = max(CHUNK, 4 * slots * PACK) if wide else max(CHUNK, len(rows))
        for lo in range(0, max(len(rows), 1), step):
            part = slice(lo, lo + step)
            r, s, v, y = rows[part], slot[part], None if w is None else w[part], wy[part]
            for (code, _, dims), sums in zip(parts, found):
                size = math.prod(dims)
                at = s * size
                at += code.take(r)
                for i, x in enumerate((np.bincount(at, v, slots * size), np.bincount(at, y, slots * size))):
                    sums[i] = x if sums[i] is None else sums[i] + x
        for (_, columns, dims), sums in zip(parts, found):
            for out, x in zip((count, total), sums):
                x = x.reshape(slots, *dims)
                for i, c in enumerate(columns):
                    others = tuple(j + 1 for j in range(len(dims)) if j != i)
                    out[:, self.first[c]:self.first[c + 1]] = x.sum(axis=others) if others else x
        return count, total

    def step(self, tree: Tree, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Each row's node a level further (leaves stay)."""
        lay, size = self.layout, len(tree.left)
        inner = tree.split >= 0
        at = np.maximum(tree.split, 0)
        table = np.repeat(np.arange(size)[:, None], self.stride, 1)
        b = np.arange(self.stride)[None]
        right = (b > lay.low[at[inner]][:, None]) & (b <= lay.high[at[inner]][:, None])
        table[inner] = tree.left[inner][:, None] + right
        start = np.where(inner, lay.column[at].astype(np.int64), 0) * self.bins.shape[1]
        out = np.empty(len(node), np.int64)
        table = table.ravel()
        for lo in range(0, len(node), CHUNK):
            n = node[lo:lo + CHUNK]
            place = start.take(n)
            place += rows[lo:lo + CHUNK]
            key = n * self.stride
            key += self.flat.take(place)
            out[lo:lo + CHUNK] = table.take(key)
        return out

    def grown(self, rows: np.ndarray, w: np.ndarray | None, y: np.ndarray, depth: int, least: int, track: bool = False) -> tuple[Tree, np.ndarray | None]:
        """A tree of ``rows`` (label ``y`` on a grid, weight ``w``) and, if ``track``, each row's leaf.

        Of two siblings the one of fewer rows is added up, the other is what the parent has more.
        """
        tree, least = Tree.root(), max(least, 1)
        wy = y if w is None else w * y
        leaf, place, node = np.zeros(len(rows), np.int64) if track else None, None, np.zeros(len(rows), np.int64)
        count, total = self.sums(node, rows, w, wy, 1)
        look = np.array([0])  # nodes of the last level that have sums
        for level in range(depth):
            few = self.layout.best(count, total, least)
            s = Splits(*(np.full(tree.open, -1, v.dtype) for v in vars(few).values()))
            for mine, found in zip(vars(s).values(), vars(few).values()):
                mine[look] = found
            tree.grow(s)
            done = np.flatnonzero(few.split >= 0)
            if not len(done):
                break
            if level == depth - 1:
                if track:
                    node = self.step(tree, node, rows)
                break
            node = self.step(tree, node, rows)
            # children in order of their parents: left, right
            size = np.column_stack([few.left_n[done], few.right_n[done]])
            can = size >= 2 * least
            small = (size[:, 1] < size[:, 0]).astype(np.int64)
            need = np.flatnonzero(can.any(1))
            if not len(need):
                break
            child = tree.first + 2 * need + small[need]
            slot_of = np.full(len(tree.left), -1)
            slot_of[child] = np.arange(len(need))
            live = np.zeros(len(tree.left), bool)
            live[tree.first:] = can.ravel()
            on = live.take(node)
            if (kept := np.count_nonzero(on)) < 0.875 * len(node):  # rows in leaves go
                on = np.flatnonzero(on)
                if track:
                    leaf[slice(None) if place is None else place] = node
                    place = on if place is None else place[on]
                # rows of a smaller sibling that is a leaf are needed once more, as what its parent has less
                lost = np.flatnonzero((slot_of.take(node) >= 0) & ~live.take(node))
                slot, extra = slot_of.take(node[lost]), (rows[lost], None if w is None else w[lost], wy[lost])
                node, rows, wy, w = node[on], rows[on], wy[on], None if w is None else w[on]
            else:
                slot, extra, kept = None, None, len(node)
            mine = slot_of.take(node)
            use = np.flatnonzero(mine >= 0)
            given = [mine[use], rows[use], None if w is None else w[use], wy[use]]
            if extra is not None and len(slot):
                given = [None if a is None else np.concatenate([a, b]) for a, b in zip(given, (slot, *extra))]
            c, t = self.sums(*given, len(need))
            parent_c, parent_t = count[done[need]], total[done[need]]
            both_c, both_t = np.empty((2 * len(need), c.shape[1])), np.empty((2 * len(need), c.shape[1]))
            at = 2 * np.arange(len(need))
            both_c[at + small[need]], both_t[at + small[need]] = c, t
            both_c[at + 1 - small[need]], both_t[at + 1 - small[need]] = parent_c - c, parent_t - t
            which = np.flatnonzero(can[need].ravel())
            count, total = both_c[which], both_t[which]
            look = (2 * need[:, None] + np.arange(2)).ravel()[which]
        if track:
            leaf[slice(None) if place is None else place] = node
        return tree, leaf

    def leaves(self, tree: Tree, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(tree.depth):
            node = self.step(tree, node, rows)
        return node


def _forest_block(base: RDD, layout: Layout, n: int, trees: int, depth: int, least: int, seed: int) -> list[Tree]:
    """``_forest`` of one block: there is nothing to add up, so a task grows its trees to the end, in one job."""
    groups = max(1, min(math.ceil(trees / LEAST_TREES), math.ceil(4 * trees * n / TASK_WORK)))

    def grown(pair):
        group, (pieces, bins, y) = pair
        packed = Packed(layout, bins) if len(y) > PACKED_ROWS else None
        for t in range(group, trees, groups):
            w = _draw(pieces, (seed, t), lambda r, n: r.poisson(1.0, n))
            used = np.flatnonzero(w)
            if packed:
                w = w[used].astype(float)
                tree, _ = packed.grown(used, w, _on_grid(y[used], w), depth, least)
            else:
                tree = _grown(layout, bins[:, used], w[used].astype(float), y[used], depth, least)
            tree.split = tree.split.astype(np.int32)
            yield t, tree

    found = dict(base.context.parallelize(range(groups), groups).cartesian(base).flatMap(grown).collect())
    return [found[t] for t in range(trees)]


def _forest(base: RDD, layout: Layout, n: int, trees: int, depth: int, least: int, seed: int) -> list[Tree]:
    sc, forest = base.context, [Tree.root() for _ in range(trees)]
    groups = min(math.ceil(trees / LEAST_TREES), math.ceil(trees * n / TASK_WORK))
    pairs = sc.parallelize(range(groups), groups).cartesian(base)
    for _ in range(depth):
        live = {t: (tree.binned(layout), tree.first, tree.open) for t, tree in enumerate(forest) if tree.open}
        if not live:
            break
        now = sc.broadcast(live)

        def sums(pair):
            group, (pieces, bins, y) = pair
            for t in range(group, trees, groups):
                if t in now.value:
                    tree, first, nodes = now.value[t]
                    w = _draw(pieces, (seed, t), lambda r, n: r.poisson(1.0, n))
                    used = np.flatnonzero(w)
                    mine = bins[:, used]
                    node = route(tree, mine)
                    on = np.flatnonzero(node >= first)
                    used, mine, node = (used, mine, node) if len(on) == len(node) else (used[on], mine[:, on], node[on])
                    count, total = layout.sums(mine, node - np.int64(first), w[used].astype(float), y[used], nodes)
                    yield t, (count.astype(np.uint32), total)

        found = pairs.flatMap(sums)
        if base.getNumPartitions() > 1:
            found = found.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), min(trees, groups))
        for t, s in found.mapValues(lambda v: layout.best(v[0].astype(float), v[1], least)).collect():
            forest[t].grow(s)
        now.destroy()
    return forest


def _boost(bases: list[RDD], layouts: list[Layout], n: int, rounds: int, depth: int, step: float, share: float, seed: int) -> list[list[Tree]]:
    """Models of several splits, a level of all of them in one job.

    The first tree fits the label, each later one twice the residual (Spark ML's gradient) at ``step``.
    """
    models: list[list[Tree]] = [[] for _ in bases]
    tagged = [b.map(lambda block, k=k: (k, block)) for k, b in enumerate(bases)]
    base = tagged[0] if len(tagged) == 1 else bases[0].context.union(tagged).coalesce(max(1, math.ceil(n / BOOST_ROWS)))

    def scored(done: list[list[tuple]], start: bool):
        def run(pair):
            k, block = pair
            pieces, bins, y = block[:3]
            p = np.zeros(len(y)) if start else block[3].copy()
            for rate, tree, value in done[k]:
                p += rate * value[route(tree, bins)]
            return k, (pieces, bins, y, p)
        return run

    state = None
    for r in range(rounds):
        before, start = state, r % RESTART == 0
        done = [[(step if i else 1.0, t.binned(lay), t.value) for i, t in enumerate(m) if start or i == r - 1] for m, lay in zip(models, layouts)]
        state = (base if start else before).map(scored(done, start)).persist(StorageLevel.MEMORY_AND_DISK)
        trees = [Tree.root() for _ in bases]
        for _ in range(depth):
            live = {k: (t.binned(layouts[k]), t.first, t.open) for k, t in enumerate(trees) if t.open}
            if not live:
                break
            for k, s in _level(state, layouts, live, r, share, seed).items():
                trees[k].grow(layouts[k].best(*s, 1))
        if before is not None:
            before.unpersist()
        for m, t in zip(models, trees):
            m.append(t)
    if state is not None:
        state.unpersist()
    return models


def _boost_blocks(bases: list[RDD], layouts: list[Layout], rounds: int, depth: int, step: float, share: float, seed: int) -> list[list[Tree]]:
    """``_boost`` of splits of one block each (at most FOREST_ROWS rows): there is nothing to add up, so a split's task grows
    its trees and all of it is one job instead of one a level."""
    def grown(k: int, layout: Layout):
        def run(block):
            pieces, bins, y = block
            p, trees = np.zeros(len(y)), []
            packed = Packed(layout, bins) if len(y) > PACKED_ROWS else None
            for r in range(rounds):
                target, tree = 2 * (y - p) if r else y, Tree.root()
                w = _drawn(pieces, r, share, seed)
                if packed:
                    used = np.arange(len(y)) if w is None else np.flatnonzero(w)
                    tree, found = packed.grown(used, None, _on_grid(target[used]), depth, 1, track=True)
                    if w is None:
                        leaf = found
                    else:
                        leaf, rest = np.empty(len(y), np.int64), np.flatnonzero(~w)
                        leaf[used], leaf[rest] = found, packed.leaves(tree, rest)
                    p += ((step if r else 1.0) * tree.value).take(leaf)
                    trees.append(tree)
                    continue
                for _ in range(depth):
                    if not tree.open:
                        break
                    tree.grow(layout.best(*_node_sums(layout, tree.binned(layout), tree.first, tree.open, bins, w, target), 1))
                p += (step if r else 1.0) * tree.value[route(tree.binned(layout), bins)]
                trees.append(tree)
            return k, trees
        return run

    jobs = [b.map(grown(k, layout)) for k, (b, layout) in enumerate(zip(bases, layouts))]
    return [trees for _, trees in sorted(bases[0].context.union(jobs).collect(), key=lambda x: x[0])]


def _drawn(pieces: list, r: int, share: float, seed: int) -> np.ndarray | None:
    """Which rows a round uses (None: all)."""
    return None if share >= 1 else _draw(pieces, (seed + r, 0), lambda g, n: g.random(n) < share)


def _node_sums(layout: Layout, binned: tuple, first: int, nodes: int, bins: np.ndarray, drawn: np.ndarray | None, target: np.ndarray):
    node = route(binned, bins)
    use = node >= first if drawn is None else (node >= first) & drawn
    if not use.all():
        used = np.flatnonzero(use)
        bins, node, target = bins[:, used], node[used], target[used]
    return layout.sums(bins, node - np.int64(first), None, target, nodes)


def _level(state: RDD, layouts: list[Layout], live: dict[int, tuple], r: int, share: float, seed: int) -> dict[int, tuple]:
    """Sums of the open nodes of one level, by split."""
    def sums(pair):
        k, (pieces, bins, y, p) = pair
        if k not in live:
            return {}
        binned, first, nodes = live[k]
        target = 2 * (y - p) if r else y
        w = _drawn(pieces, r, share, seed)
        return {k: _node_sums(layouts[k], binned, first, nodes, bins, w, target)}

    def add(a, b):
        return {k: (a[k][0] + b[k][0], a[k][1] + b[k][1]) if k in a and k in b else a.get(k) or b[k] for k in a.keys() | b.keys()}

    out = state.map(sums)
    return out.treeReduce(add) if state.getNumPartitions() > 64 else out.reduce(add)


@dataclass
class TreeRegressor:
    """Estimator over ``features`` and a label; ``rounds`` > 0 boosts, else it is a forest of ``trees``."""

    label: str
    trees: int = 0
    rounds: int = 0
    depth: int = 5
    least: int = 1
    step: float = 0.1
    share: float = 1.0
    seed: int = 42

    def fit(self, df: DataFrame) -> TreeModel:
        return self.fit_all([df])[0]

    def fit_all(self, splits: list[DataFrame | Binned]) -> list[TreeModel]:
        """One model a split; boosted ones share their jobs."""
        out, bases, own = {}, {}, []
        try:
            for i, split in enumerate(splits):
                if not isinstance(split, Binned):
                    split = Binned(split, self.label, self.seed)
                    own.append(split)
                if split.layout.columns:
                    bases[i] = split
                else:  # nothing to split on
                    tree = Tree.root()
                    tree.value[0] = split.data.agg(F.avg("y")).first()[0]
                    out[i] = TreeModel([tree], [1.0], split.layout, False)
            if self.rounds and bases:
                layouts, ns = [s.layout for s in bases.values()], [s.n for s in bases.values()]
                rdds = [s.blocks(self.block_rows(max(ns))) for s in bases.values()]
                if max(ns) <= FOREST_ROWS:
                    done = _boost_blocks(rdds, layouts, self.rounds, self.depth, self.step, self.share, self.seed)
                else:
                    done = _boost(rdds, layouts, sum(ns), self.rounds, self.depth, self.step, self.share, self.seed)
                for i, layout, trees in zip(bases, layouts, done):
                    out[i] = TreeModel(trees, [1.0] + [self.step] * (len(trees) - 1), layout, False)
            elif bases:
                for i, split in bases.items():
                    base = split.blocks(self.block_rows(split.n))
                    grow = _forest_block if base.getNumPartitions() == 1 else _forest
                    trees = grow(base, split.layout, split.n, self.trees, self.depth, self.least, self.seed)
                    out[i] = TreeModel(trees, [1 / len(trees)] * len(trees), split.layout, True)
            return [out[i] for i in range(len(splits))]
        finally:
            for split in own:
                split.release()

    def block_rows(self, n: int) -> int:
        """Rows of a block of a split of ``n``: boosting takes small ones where each round is a few jobs over all of them."""
        return BOOST_ROWS if self.rounds and n > FOREST_ROWS else FOREST_ROWS


class Binned:
    """A split's layout and binned rows, made once for all models that grow on it; ``release`` gives the blocks up."""

    def __init__(self, df: DataFrame, label: str, seed: int):
        ship(df.sparkSession)
        self.data = df.select(F.col("features").alias("x"), F.col(label).cast("double").alias("y"))
        self.n = self.data.count()
        self.layout = layout_of(self.data, self.n, seed)
        self._blocks: dict[int, RDD] = {}

    def blocks(self, rows: int) -> RDD:
        parts = max(1, math.ceil(self.n / rows))
        if parts not in self._blocks:
            self._blocks[parts] = blocks(self.data, self.layout, self.n, rows)
        return self._blocks[parts]

    def load(self, models: list[TreeRegressor]) -> None:
        """Blocks that ``models`` need are made now, so that the rows they come from may be given up."""
        for rows in {m.block_rows(self.n) for m in models}:
            if self.layout.columns:
                self.blocks(rows).count()

    def release(self) -> None:
        for b in self._blocks.values():
            b.unpersist()
        self._blocks.clear()


class TreeModel(Model):
    """Weighted sum of trees over ``features``."""

    def __init__(self, trees: list[Tree], weights: list[float], layout: Layout, by_tree: bool):
        super().__init__()
        self.trees, self.weights, self.layout, self.by_tree = trees, weights, layout, by_tree
        self._sent = None

    @property
    def numFeatures(self) -> int:
        return self.layout.slots

    @property
    def featureImportances(self) -> DenseVector:
        """Decrease in squared error by slot, a forest's trees normed each, in all 1."""
        total = np.zeros(self.layout.slots)
        for t in self.trees:
            own = np.zeros(self.layout.slots)
            inner = t.split >= 0
            np.add.at(own, self.layout.slot[t.split[inner]], t.gain[inner])
            total += own / (own.sum() or 1.0) if self.by_tree else own
        return Vectors.dense(total / (total.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        if self._sent is None:
            lay = self.layout
            rows = [(lay.slot[np.maximum(t.split, 0)] if len(lay.slot) else np.zeros(len(t.split), int),
                     np.where(t.split >= 0, lay.cut[np.maximum(t.split, 0)] if len(lay.cut) else 0.0, np.inf), t.left, t.depth, w * t.value)
                    for t, w in zip(self.trees, self.weights)]
            self._sent = dataset.sparkSession.sparkContext.broadcast(rows)
        sent = self._sent

        @F.pandas_udf("double")
        def predict(features: pd.Series) -> pd.Series:
            out = np.zeros(len(features))
            if len(features):
                x = np.stack(features.to_list())
                flat, row = x.ravel(), np.arange(len(x)) * x.shape[1]
                for slot, cut, left, depth, value in sent.value:
                    node = np.zeros(len(x), np.int32)
                    for _ in range(depth):
                        node = left.take(node) + (flat.take(slot.take(node) + row) > cut.take(node))
                    out += value[node]
            return pd.Series(out)

        return dataset.withColumn("prediction", predict(vector_to_array("features")))
