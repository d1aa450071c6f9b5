"""Gradient boosting by histograms, with trees grown by levels or by leaves.

Rows are binned once. Rows that agree in all bins, a cell, are in one leaf of
every tree, so all that a round needs of them are the number and the sum of
those it draws. Where the grid of all bins has at most ``grid`` cells, passes
over the rows, sorted by cell, add these up for many rounds at a time, and the
rounds run over the cells: a node is a box of the grid. The work after the
passes then does not depend on the rows. At most ``finish`` rows
are one bounded group, as the subtrees of a forest are, and the same rounds
run inside its task. More rows on a larger grid become blocks that stay in
the memory of the executors; a pass over them adds up, for the nodes in
question, the rows and residuals of every bin, and only these sums reach the
driver: targets x features x bins, whatever the rows.
Of two siblings the smaller is summed and the other
subtracted from their parent. What the model holds is bounded by its rounds
and leaves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.operators.forest import BINS, bin_cuts, binned
from panelforge.session import discard, durable, scratch_path

ROWS, FINISH = 1 << 16, 1 << 19
# Cells of the largest grid that rounds run over, cells times rounds that are summed at a time, and rows summed at once.
GRID, SUMMED, CHUNK = 1 << 22, 1 << 24, 1 << 15
# Rounds between two rewritings of the residuals, and rewritings between two cuts of their lineage.
KEEP, CUT = 10, 5
AHEAD = 4
NODES = "tree int, weight double, node int, feature int, threshold double, left int, right int, value double, cover double, gain double"


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1, a node's children are ``left`` and ``left`` + 1."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray


def route(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    at, each = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while (inner := feature[at] >= 0).any():
        f = np.maximum(feature[at], 0)
        at = np.where(inner, left[at] + (bins[f, each] > cut[at]), at)
    return at


def kept(key: np.ndarray, number: int, seed: int, share: float) -> np.ndarray:
    """Which rows a round draws, by a hash of their key."""
    x = key.view(np.uint64) ^ np.uint64((number * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < share * 2.0**53


def drawn_features(width: int, number: int, seed: int, share: float) -> np.ndarray:
    count = max(1, round(share * width))
    return np.sort(np.random.default_rng((seed, number)).permutation(width)[:count])


def _residuals(block, recent: Sequence[Tree]):
    bins, key, r = block
    for t in recent:
        r = r - t.value[route(t.feature, t.bin, t.left, bins)]
    return bins, key, r


def boxes(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, shape: Sequence[int]) -> Iterator[tuple[int, tuple[slice, ...]]]:
    """Every leaf with the part of the grid of bins that it covers; parts without a cell are left out."""
    held = [(0, tuple(slice(0, n) for n in shape))]
    while held:
        n, box = held.pop()
        f = int(feature[n])
        if any(s.start >= s.stop for s in box):
            continue
        if f < 0:
            yield n, box
            continue
        held += [(int(left[n]) + side, part) for side, part in enumerate(halves(box, f, int(cut[n])))]


def halves(box: tuple[slice, ...], f: int, cut: int) -> tuple[tuple[slice, ...], tuple[slice, ...]]:
    """A box, split behind bin ``cut`` of feature ``f``."""
    at = min(max(cut + 1, box[f].start), box[f].stop)
    return box[:f] + (slice(box[f].start, at),) + box[f + 1 :], box[:f] + (slice(at, box[f].stop),) + box[f + 1 :]


@dataclass
class Boosted:
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]  # values hold the learning rate

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(c) + 1 for c in self.cuts)

    @cached_property
    def table(self) -> np.ndarray:
        """The prediction of every cell."""
        out = np.full(self.shape, self.base)
        for t in self.trees:
            for leaf, box in boxes(t.feature, t.bin, t.left, self.shape):
                out[box] += t.value[leaf]
        return out.ravel()

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        if math.prod(self.shape) <= GRID:
            return self.table[np.ravel_multi_index(bins, self.shape)]
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[route(t.feature, t.bin, t.left, bins)]
        return out

    def transform(self, rows: DataFrame, vector: str = "features", name: str = "prediction") -> DataFrame:
        """``rows`` with the prediction; a null vector gives null."""
        shared, width = rows.sparkSession.sparkContext.broadcast(self), len(self.cuts)

        @F.arrow_udf("double")
        def scored(x: pa.Array) -> pa.Array:
            there = x.is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros(len(x))
            out[there] = shared.value.score(np.asarray(x.flatten(), float).reshape(-1, width))
            return pa.array(out, pa.float64(), mask=~there | np.isnan(out))

        return rows.withColumn(name, scored(F.when(F.col(vector).isNotNull(), vector_to_array(vector))))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as a table; the first tree is the base value alone."""
        rows = [(0, 1.0, 0, -1, None, -1, -1, self.base, 1.0, 0.0)]
        for i, t in enumerate(self.trees, 1):
            for k in range(len(t.feature)):
                f, b, child = int(t.feature[k]), int(t.bin[k]), int(t.left[k])
                cut = float(self.cuts[f][b]) if f >= 0 else None
                rows.append((i, 1.0, k, f, cut, child, child + 1 if f >= 0 else -1, float(t.value[k]), float(t.cover[k]), float(t.gain[k])))
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> str:
        """Two tables below ``path``: nodes, and the cuts of the features."""
        self.nodes(spark).coalesce(1).write.parquet(f"{path}/nodes")
        cuts = [(i, c.tolist()) for i, c in enumerate(self.cuts)]
        spark.createDataFrame(cuts, "feature int, cuts array<double>").coalesce(1).write.parquet(f"{path}/cuts")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        cuts = [np.array(r.cuts, float) for r in spark.read.parquet(f"{path}/cuts").orderBy("feature").collect()]
        table = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        trees = []
        for _, t in table[table.tree > 0].groupby("tree"):
            f = t.feature.to_numpy()
            b = np.array([np.searchsorted(cuts[i], c) if i >= 0 else -1 for i, c in zip(f, t.threshold)])
            trees.append(Tree(f, b, t.left.to_numpy(), t.value.to_numpy(), t.cover.to_numpy(), t.gain.to_numpy()))
        return cls(cuts, float(table[table.tree == 0].value.iloc[0]), trees)


def importances(model: Boosted, features: Sequence[str], spark: SparkSession, top: int | None = None) -> DataFrame:
    """Share of each feature in the loss that all splits remove, the largest first."""
    gains = model.nodes(spark).where("feature >= 0").groupBy("feature").agg(F.sum("gain").alias("g"))
    names = spark.createDataFrame(list(enumerate(features)), "feature int, name string")
    total = F.nullif(gains.agg(F.sum("g")).scalar(), F.lit(0.0))
    out = names.join(gains, "feature", "left").select(F.col("name").alias("feature"), F.coalesce(F.col("g") / total, F.lit(0.0)).alias("importance"))
    ordered = out.orderBy(F.desc("importance"), "feature")
    return ordered.limit(top) if top else ordered


class Grower:
    """One tree, from the sums that ``ask(feature, cut, left, targets)`` gives for nodes of a half-grown tree."""

    def __init__(self, ask, width: int, bins: int, used: np.ndarray, least: int, ridge: float, rate: float):
        self.ask, self.bins, self.used, self.least, self.ridge, self.rate = ask, bins, used, least, ridge, rate
        self.feature, self.cut, self.left, self.gain = [-1], [-1], [-1], [0.0]
        self.hist = {0: ask(np.array([-1]), np.array([-1]), np.array([-1]), [0])[0]}
        self.sums = {0: self.hist[0][0].sum(axis=0)}
        self.best = {0: self.find(0)}

    def find(self, node: int):
        """The best split of a node: (gain, feature, bin, sums of the left side), or None. Ties go to the first feature and bin."""
        hist = self.hist[node][self.used]
        upto, whole = np.cumsum(hist, axis=1), self.sums[node]
        rest = whole - upto
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = upto[..., 1] ** 2 / (upto[..., 0] + self.ridge) + rest[..., 1] ** 2 / (rest[..., 0] + self.ridge)
        before = whole[1] ** 2 / (whole[0] + self.ridge)
        gain = np.where((upto[..., 0] >= self.least) & (rest[..., 0] >= self.least), gain - before, -np.inf)
        i = int(np.argmax(gain))
        f, b = divmod(i, self.bins)
        return (float(gain[f, b]), int(self.used[f]), b, upto[f, b]) if gain[f, b] > 1e-10 * max(before, 1e-300) else None

    def split(self, node: int) -> tuple[int, int]:
        gain, f, b, left = self.best[node]
        child = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = f, b, child, gain
        for values, none in ((self.feature, -1), (self.cut, -1), (self.left, -1), (self.gain, 0.0)):
            values += [none, none]
        self.sums[child], self.sums[child + 1] = left, self.sums[node] - left
        return child, child + 1

    def open(self, nodes: Sequence[int]) -> None:
        """Sums and best splits of the children of ``nodes``, in one pass over the rows."""
        smaller = [min((self.left[n], self.left[n] + 1), key=lambda c: self.sums[c][0]) for n in nodes]
        found = self.ask(np.array(self.feature), np.array(self.cut), np.array(self.left), smaller)
        for n, small, hist in zip(nodes, smaller, found):
            other = 2 * self.left[n] + 1 - small
            self.hist[small], self.hist[other] = hist, self.hist[n] - hist
            for c in (small, other):
                self.best[c] = self.find(c)
            del self.hist[n]

    def by_levels(self, depth: int) -> Tree:
        level = [0]
        for d in range(depth):
            split = [n for n in level if self.best[n] is not None]
            if not split:
                break
            level = [c for n in split for c in self.split(n)]
            if d + 1 < depth:
                self.open(split)
        return self.done()

    def by_leaves(self, leaves: int) -> Tree:
        """Best-first: always the leaf of largest gain (ties: the older) is split next.

        A pass opens the few leaves that stand first, as if they were split;
        those that other leaves overtake are closed again in the end.
        """
        heap = [(-self.best[0][0], 0)] if self.best[0] else []
        made, opened = 1, set()
        while heap and made < leaves:
            top = heap[0][1]
            if top not in opened and made + 1 < leaves:
                ahead = [n for _, n in heapq.nsmallest(min(AHEAD, leaves - made), heap) if n not in opened]
                for n in ahead:
                    self.split(n)
                self.open(ahead)
                opened.update(ahead)
            heapq.heappop(heap)
            if top in opened:
                opened.discard(top)
                for c in (self.left[top], self.left[top] + 1):
                    if self.best[c]:
                        heapq.heappush(heap, (-self.best[c][0], c))
            else:
                self.split(top)
            made += 1
        for n in opened:
            self.feature[n], self.cut[n], self.left[n], self.gain[n] = -1, -1, -1, 0.0
        return self.done()

    def done(self) -> Tree:
        """The nodes that are reached, numbered by levels."""
        order, place = [0], {}
        for n in order:
            place[n] = len(place)
            if self.left[n] >= 0:
                order += [self.left[n], self.left[n] + 1]
        sums = np.array([self.sums[n] for n in order])
        left = np.array([place[self.left[n]] if self.left[n] >= 0 else -1 for n in order])
        values = self.rate * sums[:, 1] / (sums[:, 0] + self.ridge)
        return Tree(np.array([self.feature[n] for n in order]), np.array([self.cut[n] for n in order]), left, values, sums[:, 0], np.array([self.gain[n] for n in order]))


def _summed(blocks: RDD, width: int, bins: int, recent: list[Tree], number: int, draw):
    """The ``ask`` of a round: sums over the drawn rows, added up on the executors where the parts are many."""

    def ask(feature, cut, left, targets):
        place = np.full(len(feature), -1)
        place[targets] = np.arange(len(targets))

        def part(blocks):
            out = np.zeros((len(targets), width, bins, 2))
            for block in blocks:
                b, key, r = _residuals(block, recent)
                at = place[route(feature, cut, left, b)] if len(feature) > 1 else np.zeros(len(r), np.int64)
                on = (at >= 0) & draw(key, number)
                at, b, r = at[on] * bins, b[:, on], r[on]
                for f in range(width):
                    k = at + b[f]
                    out[:, f, :, 0] += np.bincount(k, minlength=len(targets) * bins).reshape(-1, bins)
                    out[:, f, :, 1] += np.bincount(k, r, len(targets) * bins).reshape(-1, bins)
            yield out

        parts = blocks.mapPartitions(part)
        return parts.treeReduce(np.add) if blocks.getNumPartitions() > 32 else sum(parts.collect())

    return ask


class Group:
    """The ``ask`` of a round over the rows of one group; each node keeps the numbers of its rows."""

    def __init__(self, bins: np.ndarray, r: np.ndarray, size: int):
        width = len(bins)
        self.bins, self.r, self.width, self.size = bins, r, width, size
        self.keys = bins + (np.arange(width) * size)[:, None]
        self.rows = {0: np.arange(len(r))}

    def __call__(self, feature, cut, left, targets):
        parents = {int(c): p for p, c in enumerate(left) if c >= 0}
        out = np.zeros((len(targets), self.width, self.size, 2))
        for i, t in enumerate(targets):
            if t not in self.rows:
                p = parents[t] if t in parents else parents[t - 1]
                own = self.rows.pop(p)
                right = self.bins[feature[p], own] > cut[p]
                self.rows[int(left[p])], self.rows[int(left[p]) + 1] = own[~right], own[right]
            own = self.rows[t]
            keys = self.keys[:, own].ravel()
            out[i, :, :, 0] = np.bincount(keys, minlength=self.width * self.size).reshape(self.width, -1)
            out[i, :, :, 1] = np.bincount(keys, np.tile(self.r[own], self.width), self.width * self.size).reshape(self.width, -1)
        return out


class Cube:
    """The ``ask`` of a round over a grid of cells, from the drawn rows and their residuals in each cell."""

    def __init__(self, n: np.ndarray, r: np.ndarray, size: int):
        self.n, self.r, self.size = n, r, size
        self.boxes = {0: tuple(slice(0, k) for k in n.shape)}

    def __call__(self, feature, cut, left, targets):
        parents = {int(c): p for p, c in enumerate(left) if c >= 0}
        out = np.zeros((len(targets), self.n.ndim, self.size, 2))
        for i, t in enumerate(targets):
            if t not in self.boxes:
                p = parents[t] if t in parents else parents[t - 1]
                child = int(left[p])
                self.boxes[child], self.boxes[child + 1] = halves(self.boxes[p], int(feature[p]), int(cut[p]))
            box = self.boxes[t]
            for k, values in enumerate((self.n, self.r)):
                # Sums by the bins of each feature in turn, which is then summed away.
                rest = np.ascontiguousarray(values[box])
                for f, s in enumerate(box):
                    out[i, f, s, k] = rest.reshape(len(rest), -1).sum(axis=1)
                    rest = rest.sum(axis=0)
        return out


PACKED = ("<i4", "<i4", "<i4", "<f8", "<f8", "<f8")


def _in_one_group(cuts, base: float, rounds: int, grown, draw, size: int):
    """All rounds over the rows of one task; a row of packed arrays for each tree."""

    def run(batches):
        parts = [(binned(np.asarray(b["x"].flatten(), float).reshape(b.num_rows, -1), cuts), b["key"].to_numpy(), b["y"].to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        bins, key, y = [np.concatenate([p[i] for p in parts], axis=-1) for i in range(3)]
        order = np.lexsort((y, key))  # sums do not depend on how the rows came
        bins, key, r = bins[:, order], key[order], y[order] - base
        for number in range(rounds):
            on = draw(key, number)
            tree = grown(Group(np.ascontiguousarray(bins[:, on]), r[on], size), number)
            r = r - tree.value[route(tree.feature, tree.bin, tree.left, bins)]
            yield _tree_batch(number, tree)

    return run


def _celled(cuts, shape):
    """The cell, key and label of every row."""

    def run(batches):
        for b in batches:
            bins = binned(np.asarray(b["x"].flatten(), float).reshape(b.num_rows, -1), cuts)
            cell = np.ravel_multi_index(bins, shape) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), b["key"], b["y"]], ["cell", "key", "y"])

    return run


def chunks(batches, names: Sequence[str], least: int) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are put together to at least ``least`` rows."""
    held, rows = [], 0
    for b in batches:
        held.append([b[n].to_numpy() for n in names])
        rows += b.num_rows
        if rows >= least:
            yield [np.concatenate(c) for c in zip(*held)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


def _drawn_sums(numbers: range, base: float, draw):
    """Rows and residuals against ``base`` that each round draws in the cells of a chunk of rows."""

    def run(batches):
        for cell, key, y in chunks(batches, ("cell", "key", "y"), CHUNK):
            order = np.argsort(cell, kind="stable")
            cell, key, y = cell[order], key[order], y[order] - base
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            n, s = np.empty((len(numbers), len(starts)), np.int32), np.empty((len(numbers), len(starts)))
            for i, number in enumerate(numbers):
                on = draw(key, number)
                n[i], s[i] = np.add.reduceat(on, starts, dtype=np.int64), np.add.reduceat(y * on, starts)
            columns = [[v.tobytes()] for v in (cell[starts], n, s)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["cells", "n", "s"])

    return run


TREE = "number long, " + ", ".join(f"{c} binary" for c in "abcdef")


def _tree_batch(number: int, tree: Tree) -> pa.RecordBatch:
    arrays = (tree.feature, tree.bin, tree.left, tree.value, tree.cover, tree.gain)
    columns = [pa.array([number]), *[pa.array([a.astype(k).tobytes()]) for a, k in zip(arrays, PACKED)]]
    return pa.RecordBatch.from_arrays(columns, ["number", *"abcdef"])


def _over_cells(shape, numbers: range, grown, size: int):
    """Some rounds over the cells: a row of packed arrays for each tree, and one of number -1 with what the trees so far predict."""

    def run(batches):
        n, s = np.zeros((2, len(numbers), math.prod(shape)))
        so_far = np.zeros(shape)
        for batch in batches:
            for cells, k, v, state in zip(*[batch[c] for c in ("cells", "n", "s", "state")]):
                if state.is_valid:
                    so_far = np.frombuffer(state.as_buffer()).reshape(shape).copy()
                    continue
                at = np.frombuffer(cells.as_buffer(), np.int64)
                n[:, at] += np.frombuffer(k.as_buffer(), np.int32).reshape(len(numbers), -1)
                s[:, at] += np.frombuffer(v.as_buffer()).reshape(len(numbers), -1)
        for i, number in enumerate(numbers):
            drawn = n[i].reshape(shape)
            tree = grown(Cube(drawn, s[i].reshape(shape) - drawn * so_far, size), number)
            for leaf, box in boxes(tree.feature, tree.bin, tree.left, shape):
                so_far[box] += tree.value[leaf]
            yield _tree_batch(number, tree)
        none = pa.array([None], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([so_far.tobytes()]), *[none] * 5], ["number", *"abcdef"])

    return run


def _trees(rows) -> list[Tree]:
    return [Tree(*[np.frombuffer(v, k) for v, k in zip(r[1:], PACKED)]) for r in sorted(rows, key=lambda r: r.number)]


def celled(used: DataFrame, rows: int, cuts: list[np.ndarray], shape: Sequence[int]) -> DataFrame:
    """(cell, key, y) of every row, dealt into ranges of them, so that a crowded cell is in many."""
    parts = max(used.sparkSession.sparkContext.defaultParallelism, -(-rows // (ROWS << 4)))
    found = durable(used.mapInArrow(_celled(cuts, shape), "cell long, key long, y double"))
    return durable(found.repartitionByRange(parts, "cell", "key").sortWithinPartitions("cell", "key", "y"))


def _by_cells(used: DataFrame, rows: int, cuts, shape, base: float, rounds: int, grown, draw, size: int) -> list[Tree]:
    spark, dealt, trees, last = used.sparkSession, celled(used, rows, cuts, shape), [], None
    step = max(1, SUMMED // math.prod(shape))
    for at in range(0, rounds, step):
        numbers = range(at, min(at + step, rounds))
        paths = [scratch_path(spark, name) for name in ("sums", "rounds")]
        sums = durable(dealt.mapInArrow(_drawn_sums(numbers, base, draw), "cells binary, n binary, s binary"), paths[0])
        given = sums.withColumn("state", F.lit(None).cast("binary"))
        if last:
            state = spark.read.parquet(last).where("number < 0").select(F.col("a").alias("state"))
            given = given.unionByName(state, allowMissingColumns=True)
        done = durable(given.coalesce(1).mapInArrow(_over_cells(shape, numbers, grown, size), TREE), paths[1])
        trees += _trees(done.where("number >= 0").collect())
        for path in [paths[0], last] if last else paths[:1]:
            discard(spark, path)
        last = paths[1]
    discard(spark, last)
    return trees


def fit(train: DataFrame, width: int, key: Sequence[str], rounds: int = 600, rate: float = 0.03, depth: int | None = None,
        leaves: int | None = None, least: int = 1, ridge: float = 1.0, rows: float = 0.9, columns: float = 0.9, bins: int = BINS,
        seed: int = 42, finish: int = FINISH, vector: str = "features", label: str = "label", grid: int = GRID) -> Boosted:
    """Boosting for squared error: ``depth`` grows trees by levels, ``leaves`` by leaves, the best first.

    Each round draws the share ``rows`` of the rows by the hash of ``key`` (rows
    that agree there are drawn together) and the share ``columns`` of the
    features. Rows are boosted by cells where the grid of all bins has at most ``grid``
    and they are more than half of it; else at most ``finish`` rows in one group, more by passes. A leaf has at least ``least`` drawn rows; its value is the sum of
    its residuals over its rows and ``ridge``, times ``rate``. Rows without a
    label are left out; without rows the model predicts null.
    """
    if (depth is None) == (leaves is None):
        raise ValueError("give either depth or leaves")
    sc = train.sparkSession.sparkContext
    cuts = bin_cuts(train, vector, width, bins)
    used = train.where(F.col(label).isNotNull() & ~F.isnan(label)).select(
        F.xxhash64(*key).alias("key"), vector_to_array(vector).alias("x"), F.col(label).cast("double").alias("y")
    )
    total = used.agg(F.avg("y").alias("m"), F.count("*").alias("n")).first()
    if not total["n"]:
        return Boosted(cuts, float("nan"), [])
    base = float(total["m"])

    def draw(row_keys, number):
        return kept(row_keys, number, seed, rows)

    def grown(ask, number):
        grower = Grower(ask, width, bins, drawn_features(width, number, seed, columns), least, ridge, rate)
        return grower.by_leaves(leaves) if depth is None else grower.by_levels(depth)

    shape = tuple(len(c) + 1 for c in cuts)
    if math.prod(shape) <= grid and total["n"] > min(finish, math.prod(shape) // 2):
        return Boosted(cuts, base, _by_cells(used, total["n"], cuts, shape, base, rounds, grown, draw, bins))
    used = durable(used)
    if total["n"] <= finish:
        found = used.coalesce(1).mapInArrow(_in_one_group(cuts, base, rounds, grown, draw, bins), TREE).collect()
        return Boosted(cuts, base, _trees(found))

    def block(part):
        data = list(part)
        if data:
            x = np.array([r.x for r in data], float).reshape(-1, width)
            yield binned(x, cuts), np.array([r.key for r in data], np.int64), np.array([r.y for r in data]) - base

    spread = used.repartition(max(1, -(-total["n"] // ROWS)))
    blocks = spread.rdd.mapPartitions(block).persist(StorageLevel.MEMORY_AND_DISK)
    trees, recent = [], []
    for number in range(rounds):
        tree = grown(_summed(blocks, width, bins, recent, number, draw), number)
        trees.append(tree)
        recent = [*recent, tree]
        if len(recent) == KEEP and number + 1 < rounds:
            old, done = blocks, tuple(recent)
            blocks = old.map(lambda b, done=done: _residuals(b, done)).persist(StorageLevel.MEMORY_AND_DISK)
            if sc.getCheckpointDir() and (number + 1) % (KEEP * CUT) == 0:
                blocks.checkpoint()
            blocks.count()
            old.unpersist()
            recent = []
    blocks.unpersist()
    return Boosted(cuts, base, trees)
