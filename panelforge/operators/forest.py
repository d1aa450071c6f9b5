"""Random forests grown and applied as partitioned tables.

Rows that agree in all bins, a cell, take the same way through every tree: they
are sorted together and count as one entry, with the rows drawn, their draws
and their label sum. Entries become blocks: for each tree, up to ``BLOCK``
of one node, packed into binary columns. Nodes of more than
``finish`` entries are split level by level from sums by (tree, node, feature,
bin); a node of at most so many has its whole subtree grown in one group.
The trees stay tables, the top by nodes and the rest by subtrees, and cells are
scored by walking the top in joins and meeting their subtree. Neither the
rows of a tree nor its nodes are ever in one task or on the driver, and what
is kept for each tree grows with the cells, not with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelforge.session import durable

BINS, BLOCK, FINISH = 32, 8192, 1 << 19
# Rows of a task that are drawn from at once.
CHUNK = 1 << 15
# Rows that are sorted in a task, and cells that are scored in one.
SORTED, CELLS = 1 << 20, 1 << 16
LEAST_GAIN = 1e-10
# Poisson numbers of mean 1: the share of rows drawn at most 0, 1, 2, ... times.
DRAWN = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(12)])
PACKED = "tree int, node long, n long, bins binary, c binary, w binary, s binary"


@dataclass
class Forest:
    """``top``: (tree, node, feature, bin, value, cover, gain) of nodes above the subtrees; a node's children are 2 and 2 + 1 times it.

    ``subtrees``: (tree, node, feature, bin, value, cover, gains), one row each. ``feature`` and ``bin`` pack all nodes by levels,
    the children of the k-th split, from 0, at 2k + 1 and 2k + 2; ``value`` and ``cover`` pack the leaves, in the same order.
    ``cuts``: per feature the largest values of all bins but the last; ``levels``: of ``top``.
    """

    top: DataFrame
    subtrees: DataFrame
    cuts: list[np.ndarray]
    trees: int
    levels: int


def bin_cuts(rows: DataFrame, vector: str, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Quantiles of every feature in one aggregation, ``bins`` - 1 of them at most; none repeats."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    x = rows.select(vector_to_array(vector).alias("x"))
    asked = [F.percentile_approx(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]), shares, 100 * bins) for i in range(width)]
    found = x.agg(*[a.alias(str(i)) for i, a in enumerate(asked)]).first()
    return [np.unique(np.array(q if q is not None else [], float)) for q in found]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins by feature and row; a missing value is in the last."""
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)


def draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson numbers by a hash of the row's key."""
    x = key.view(np.uint64) + np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(DRAWN, (x >> np.uint64(11)) / 2.0**53, side="right").astype(np.uint8)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def bins_of(cuts: list[np.ndarray]):
    """The bins of a column of arrays, a byte each; null for null."""

    @F.arrow_udf("binary")
    def packed(x: pa.Array) -> pa.Array:
        there = x.is_valid().to_numpy(zero_copy_only=False)
        bins = np.ascontiguousarray(binned(np.asarray(x.flatten(), float).reshape(-1, len(cuts)), cuts).T)
        found = np.full(len(x), None, object)
        found[there] = [b.tobytes() for b in bins]
        return pa.array(found, pa.binary())

    return packed


def unpacked_bins(column: pa.Array, width: int) -> np.ndarray:
    """Bins by feature and row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width).T


def _chunks(batches, width: int):
    held, rows = [], 0
    for b in batches:
        held.append((unpacked_bins(b["bins"], width), b["key"].to_numpy(), b["y"].to_numpy()))
        rows += b.num_rows
        if rows >= CHUNK:
            yield [np.concatenate(c, axis=-1) for c in zip(*held)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(c, axis=-1) for c in zip(*held)]


def _blocks(width: int, trees: int, seed: int):
    """Entries of every tree, from rows sorted by their bins."""

    def run(batches):
        held, least = [[] for _ in range(trees)], BLOCK
        for bins, key, y in _chunks(batches, width):
            starts = np.concatenate([[0], 1 + np.flatnonzero((bins[:, 1:] != bins[:, :-1]).any(axis=0))])
            cells = bins[:, starts]
            for t in range(trees):
                w = draws(key, t, seed)
                c, s = np.add.reduceat(w > 0, starts, dtype=np.uint32), np.add.reduceat(w * y, starts)
                on = c > 0
                held[t].append((cells[:, on], c[on], np.add.reduceat(w, starts, dtype=np.uint32)[on], s[on]))
            if (least := least - len(starts)) <= 0:
                for t in range(trees):
                    yield from _filled(t, 1, held[t])
                held, least = [[] for _ in range(trees)], BLOCK
        for t in range(trees):
            yield from _filled(t, 1, held[t])

    return run


def _joined(parts: list) -> list[np.ndarray]:
    return [np.concatenate(p, axis=-1) for p in zip(*parts)]


def _filled(tree: int, node: int, parts: list):
    """Blocks of the entries in ``parts``."""
    if parts:
        joined = _joined(parts)
        for a in range(0, joined[0].shape[1], BLOCK):
            yield _packed(tree, node, *[p[..., a : a + BLOCK] for p in joined])


def _packed(tree: int, node: int, b: np.ndarray, c: np.ndarray, w: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    columns = [[tree], [node], [len(c)], *[[np.ascontiguousarray(v).tobytes()] for v in (b, c, w, s)]]
    kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["tree", "node", "n", "bins", "c", "w", "s"])


def _unpacked(batch, i: int, width: int):
    """Bins by feature and entry, and of each entry the rows, draws and label sum."""
    c, w = [np.frombuffer(batch[n][i].as_py(), np.uint32) for n in ("c", "w")]
    return np.frombuffer(batch["bins"][i].as_py(), np.uint8).reshape(width, -1), c, w, np.frombuffer(batch["s"][i].as_py(), float)


def _sums(width: int, bins: int):
    """Per block and feature the rows, draws and label sums of every bin."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b, *sums = _unpacked(batch, i, width)
                f, k = np.divmod(np.arange(width * bins), bins)
                count, weight, total = [np.concatenate([np.bincount(b[j], v, bins) for j in range(width)]) for v in sums]
                on = count > 0
                names = [batch[c][i].as_py() for c in ("tree", "node")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(on.sum(), names[0]), pa.int32()), pa.array(np.full(on.sum(), names[1]), pa.int64()),
                     pa.array(f[on], pa.int32()), pa.array(k[on], pa.int32()), pa.array(count[on]), pa.array(weight[on]), pa.array(total[on])],
                    ["tree", "node", "feature", "bin", "c", "w", "s"],
                )

    return run


def _best(sums: DataFrame, leaf: int) -> DataFrame:
    """The best split of each node; feature is null where none is good enough. Ties go to the first feature and bin."""
    per_bin = sums.groupBy("tree", "node", "feature", "bin").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    whole = Window.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = ("c", "w", "s")
    df = per_bin.withColumns({**{f"{n}l": F.sum(n).over(upto) for n in names}, **{f"{n}t": F.sum(n).over(whole) for n in names}})
    right = F.col("wt") - F.col("wl")
    base = F.col("st") * F.col("st") / F.col("wt")
    sides = F.col("sl") * F.col("sl") / F.col("wl") + (F.col("st") - F.col("sl")) * (F.col("st") - F.col("sl")) / F.nullif(right, F.lit(0.0))
    allowed = (F.col("cl") >= leaf) & (F.col("ct") - F.col("cl") >= leaf) & (sides - base > LEAST_GAIN * base)
    split = F.when(allowed, F.struct((sides - base).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    best = df.groupBy("tree", "node").agg(F.max(split).alias("m"), F.first("wt").alias("cover"), (F.first("st") / F.first("wt")).alias("value"))
    return best.select("tree", "node", (-F.col("m.f")).alias("feature"), (-F.col("m.b")).alias("bin"), "value", "cover", F.coalesce("m.gain", F.lit(0.0)).alias("gain"))


def _children(width: int):
    """Blocks of split nodes, sorted by node, to blocks of their children, filled up."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                tree, node, f, cut = [batch[c][i].as_py() for c in ("tree", "node", "feature", "cut")]
                entries = _unpacked(batch, i, width)
                for key in [k for k in held if k[0] != tree or k[1] >> 1 != node]:
                    yield from _filled(*key, held.pop(key))
                at = entries[0][f]
                for side, on in enumerate((at <= cut, at > cut)):
                    if on.any():
                        key = (tree, 2 * node + side)
                        held.setdefault(key, []).append([e[..., on] for e in entries])
                        if sum(len(p[1]) for p in held[key]) >= BLOCK:
                            yield from _filled(*key, held.pop(key))
        for key in list(held):
            yield from _filled(*key, held.pop(key))

    return run


def subtree(bins: np.ndarray, c: np.ndarray, w: np.ndarray, s: np.ndarray, leaf: int, depth: int, size: int):
    """All splits below one node, a level at a time: (feature, bin, left, value, cover, gain) by node; a leaf has feature -1.

    Entries stand for ``c`` rows, ``w`` draws and the label sum ``s``.
    Children of a node stand next to each other, the first at ``left``.
    """
    out = [[] for _ in range(6)]
    node, c, w = np.zeros(len(w), np.int64), c.astype(float), w.astype(float)
    frontier, made = 1, 1
    for level in range(depth + 1):
        cover, total, count = np.bincount(node, w, frontier), np.bincount(node, s, frontier), np.bincount(node, c, frontier)
        base = total * total / cover
        best, feature, cut = LEAST_GAIN * base, np.full(frontier, -1), np.full(frontier, -1)
        open_ = np.flatnonzero((count >= 2 * leaf) & (level < depth))
        if len(open_):
            place = np.full(frontier, -1)
            place[open_] = np.arange(len(open_))
            on = place[node] >= 0
            at, bins, c, w, s = place[node[on]], bins[:, on], c[on], w[on], s[on]
            k, C, W, S = len(open_), count[open_, None], cover[open_, None], total[open_, None]
            for f in range(len(bins)):
                key = at * size + bins[f]
                cl, wl, sl = [np.cumsum(np.bincount(key, v, k * size).reshape(k, size), axis=1) for v in (c, w, s)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((cl >= leaf) & (C - cl >= leaf), sl * sl / wl + (S - sl) * (S - sl) / (W - wl) - S * S / W, -np.inf)
                j = np.argmax(gain, axis=1)
                g = gain[np.arange(k), j]
                better = open_[g > best[open_]]
                rank = place[better]
                best[better], feature[better], cut[better] = g[rank], f, j[rank]
            split = feature >= 0
            left = np.where(split, made + 2 * (np.cumsum(split) - 1), -1)
            of = open_[at]
            stay = split[of]
            of, bins, c, w, s = of[stay], bins[:, stay], c[stay], w[stay], s[stay]
            node = left[of] - made + (bins[feature[of], np.arange(len(of))] > cut[of])
        else:
            split, left = np.zeros(frontier, bool), np.full(frontier, -1)
        for o, v in zip(out, (feature, cut, left, total / cover, cover, np.where(split, best, 0.0))):
            o.append(v)
        frontier = 2 * int(split.sum())
        made += frontier
        if not frontier:
            break
    return [np.concatenate(o) for o in out]


PARTS = "tree int, node long, feature binary, bin binary, value binary, cover binary, gains array<double>"
KINDS = ("<i2", "u1", "<f8", "<u4")


def _finish(width: int, size: int, leaf: int, depth: int):
    def run(key, table):
        parts = [_unpacked(table, i, width) for i in range(table.num_rows)]
        tree, node = [k.as_py() for k in key]
        feature, cut, _, value, cover, gain = subtree(*_joined(parts), leaf, depth - (node.bit_length() - 1), size)
        gains, ends = np.bincount(np.maximum(feature, 0), gain, width), feature < 0
        packed = (feature, np.maximum(cut, 0), value[ends], cover[ends])
        columns = [[tree], [node], *[[p.astype(k).tobytes()] for p, k in zip(packed, KINDS)], [gains.tolist()]]
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.float64()))
        names = ["tree", "node", "feature", "bin", "value", "cover", "gains"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _parts(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks to deal rows to, ``each`` at most and all cores at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def _apart(df: DataFrame, tasks: int) -> DataFrame:
    """Groups of a slow function over so many tasks, whatever their bytes."""
    return df.repartition(tasks, "tree", "node")


def grow(train: DataFrame, width: int, key: Sequence[str], trees: int = 400, leaf: int = 2, depth: int = 30, bins: int = BINS,
         seed: int = 42, finish: int = FINISH, vector: str = "features", label: str = "label") -> Forest:
    """A regression forest on all features: each tree draws the rows with Poisson weights and splits by squared error.

    ``key`` names the columns by whose hash rows are drawn; rows that agree
    there are drawn together. A leaf has at least ``leaf`` distinct rows. A
    feature is cut into at most ``bins`` bins by quantiles; a missing value
    counts as largest. Rows without a label are left out. A tree that draws
    no row is missing, and a forest without trees predicts null.
    """
    spark = train.sparkSession
    cuts = bin_cuts(train, vector, width, bins)
    x = bins_of(cuts)(vector_to_array(vector))
    rows = durable(train.where(F.col(label).isNotNull() & ~F.isnan(label)).select(
        F.xxhash64(*key).alias("key"), x.alias("bins"), F.col(label).cast("double").alias("y")
    ))
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # By key as well, so that a crowded cell is dealt to many tasks.
    count = rows.count()
    parts = _parts(spark, count, SORTED)
    sorted_ = rows.repartitionByRange(parts, "bins", "key").sortWithinPartitions("bins", "key", "y")
    blocks = sorted_.mapInArrow(_blocks(width, trees, seed), PACKED).where("n > 0")
    # Where the cells of all rows fit a group, so do those of a tree, and their blocks go to it at once. A chunk may begin amid a cell.
    small = rows.select("bins").distinct().count() + count // CHUNK + parts <= finish
    blocks = blocks if small else durable(blocks)
    names = "tree int, node long, feature int, bin int, value double, cover double, gain double"
    top, levels = spark.createDataFrame([], names), 0
    while levels < depth and not small:
        large = blocks.groupBy("tree", "node").agg(F.sum("n").alias("_n")).where(F.col("_n") > finish).select("tree", "node")
        large = durable(large)
        if large.isEmpty():
            break
        sums = blocks.join(large, ["tree", "node"], "left_semi").mapInArrow(_sums(width, bins), "tree int, node long, feature int, bin int, c double, w double, s double")
        found = durable(_best(sums, leaf))
        split = found.where("feature is not null").select("tree", "node", "feature", F.col("bin").alias("cut"))
        cut = blocks.join(split, ["tree", "node"]).repartition("tree", "node").sortWithinPartitions("tree", "node")
        rest = blocks.join(large, ["tree", "node"], "left_anti")
        blocks = durable(rest.unionByName(cut.mapInArrow(_children(width), PACKED)))
        top, levels = top.unionByName(found), levels + 1
    grown = _apart(blocks, tasks).groupBy("tree", "node").applyInArrow(_finish(width, bins, leaf, depth), PARTS)
    return Forest(durable(top), durable(grown), cuts, trees, levels)


SCORED = "tree int, node long, block long, rows binary, bins binary"
SCORED_NAMES = ["tree", "node", "block", "rows", "bins"]
VALUED = "block long, rows binary, sums binary, trees binary"


def _score_blocks(width: int):
    """Cells by the block, with their places in it."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, bins = part["row"].to_numpy(), np.ascontiguousarray(unpacked_bins(part["bins"], width))
                columns = [ids[:1], [ids.tobytes()], [np.arange(len(ids), dtype=np.uint16).tobytes()], [bins.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "ids", "rows", "bins"])

    return run


def _step(width: int):
    """Scored blocks of a split node, dealt to its children; others stay."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["feature"] is None:
                    out.append([r[n] for n in SCORED_NAMES])
                    continue
                bins, rows = np.frombuffer(r["bins"], np.uint8).reshape(width, -1), np.frombuffer(r["rows"], np.uint16)
                for side, on in enumerate((bins[r["feature"]] <= r["cut"], bins[r["feature"]] > r["cut"])):
                    if on.any():
                        out.append([r["tree"], 2 * r["node"] + side, r["block"], rows[on].tobytes(), np.ascontiguousarray(bins[:, on]).tobytes()])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], SCORED_NAMES)

    return run


def _walk(width: int):
    def run(blocks, parts):
        names, rows, values = [], [], []
        if parts.num_rows:
            part = parts.slice(0, 1).to_pylist()[0]
            feature, cut, ends = [np.frombuffer(part[n], k) for n, k in zip(("feature", "bin", "value"), KINDS)]
            split = feature >= 0
            left, value = 2 * np.cumsum(split) - 1, np.zeros(len(feature))
            value[~split] = ends
            for r in blocks.to_pylist():
                bins = np.frombuffer(r["bins"], np.uint8).reshape(width, -1)
                at, each = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
                while (inner := split[at]).any():
                    f = np.maximum(feature[at], 0)
                    at = np.where(inner, left[at] + (bins[f, each] > cut[at]), at)
                names.append(r["block"])
                rows.append(r["rows"])
                values.append(value[at].tobytes())
        return pa.table([pa.array(names, pa.int64()), pa.array(rows, pa.binary()), pa.array(values, pa.binary())], names=["block", "rows", "values"])

    return run


def _totals(batches):
    """Sums over the trees that a task has of a block, for a bounded number of blocks at a time."""
    held: dict[int, np.ndarray] = {}

    def full():
        for block, sums in held.items():
            on = np.flatnonzero(sums[1])
            columns = [[block], [on.astype(np.uint16).tobytes()], [sums[0, on].tobytes()], [sums[1, on].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "rows", "sums", "trees"])
        held.clear()

    for batch in batches:
        for block, rows, values in zip(*[batch[c].to_pylist() for c in ("block", "rows", "values")]):
            at = np.frombuffer(rows, np.uint16)
            sums = held.setdefault(block, np.zeros((2, BLOCK)))
            sums[0, at] += np.frombuffer(values, float)
            sums[1, at] += 1
            if len(held) == 256:
                yield from full()
    yield from full()


def _mean(totals, ids):
    """The mean over the trees for every cell of a block."""
    ids = np.frombuffer(ids["ids"][0].as_py(), np.int64)
    sums = np.zeros((2, BLOCK))
    for rows, total, trees in zip(*[totals[c].to_pylist() for c in ("rows", "sums", "trees")]):
        at = np.frombuffer(rows, np.uint16)
        sums[0, at] += np.frombuffer(total, float)
        sums[1, at] += np.frombuffer(trees, float)
    there = sums[1, : len(ids)] > 0
    return pa.table([pa.array(ids[there]), pa.array((sums[0] / np.maximum(sums[1], 1))[: len(ids)][there])], names=["row", "mean"])


def predict(forest: Forest, rows: DataFrame, vector: str = "features", name: str = "prediction") -> DataFrame:
    """``rows`` with the mean over the trees; a null vector gives a null prediction.

    Cells are scored once for all their rows. Many blocks of them that meet at
    one subtree are dealt over copies of it, 64 to a task.
    """
    width = len(forest.cuts)
    marked = rows.withColumn("_bins", bins_of(forest.cuts)(F.when(F.col(vector).isNotNull(), vector_to_array(vector))))
    cells = durable(marked.where("_bins is not null").select(F.col("_bins").alias("bins")).distinct())
    numbered = durable(cells.repartitionByRange(_parts(rows.sparkSession, cells.count(), CELLS), "bins").sortWithinPartitions("bins").withColumn("row", F.monotonically_increasing_id()))
    once = durable(numbered.mapInArrow(_score_blocks(width), "block long, ids binary, rows binary, bins binary"))
    blocks = once.withColumns({"tree": F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))), "node": F.lit(1).cast("long")}).select(*SCORED_NAMES)
    steps = forest.top.select("tree", "node", "feature", F.col("bin").alias("cut"))
    for _ in range(forest.levels):
        blocks = durable(blocks.join(steps, ["tree", "node"], "left").mapInArrow(_step(width), SCORED))
    copies = durable(blocks.groupBy("tree", "node").agg(F.ceil(F.count("*") / 64).cast("int").alias("copies")))
    parts = forest.subtrees.join(copies, ["tree", "node"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = blocks.join(copies, ["tree", "node"]).withColumn("copy", F.pmod(F.xxhash64("block", "rows"), F.col("copies")).cast("int"))
    by = ("tree", "node", "copy")
    met = dealt.select(*by, "block", "rows", "bins").groupBy(*by).cogroup(parts.select(*by, "feature", "bin", "value").groupBy(*by))
    valued = met.applyInArrow(_walk(width), "block long, rows binary, values binary")
    # Leaves above the subtrees: every row of such a block has the node's value.
    whole = forest.top.where("feature is null").select("tree", "node", "value")
    early = blocks.join(whole, ["tree", "node"]).mapInArrow(_constant, "block long, rows binary, values binary") if forest.levels else None
    valued = valued if early is None else valued.unionByName(early)
    totals = valued.mapInArrow(_totals, VALUED).groupBy("block").cogroup(once.select("block", "ids").groupBy("block"))
    means = totals.applyInArrow(_mean, "row long, mean double")
    found = durable(numbered.join(means, "row").select(F.col("bins").alias("_bins"), F.col("mean").alias(name)))
    return marked.join(found, "_bins", "left").drop("_bins")


def _constant(batches):
    for batch in batches:
        values = [np.full(len(r.as_py()) // 2, v.as_py()).tobytes() for r, v in zip(batch["rows"], batch["value"])]
        yield pa.RecordBatch.from_arrays([batch["block"], batch["rows"], pa.array(values, pa.binary())], ["block", "rows", "values"])


def importances(forest: Forest, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Share of each feature in the squared error that a tree removes, averaged over the trees; the largest first."""
    per_part = forest.subtrees.select("tree", F.posexplode("gains").alias("feature", "gain"))
    per_node = forest.top.where("feature is not null").select("tree", "feature", "gain")
    gains = per_part.unionByName(per_node).groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    whole = Window.partitionBy("tree")
    share = gains.withColumn("share", F.col("gain") / F.nullif(F.sum("gain").over(whole), F.lit(0.0)))
    every = share.groupBy("feature").agg((F.sum("share") / forest.trees).alias("importance"))
    total = Window.partitionBy()
    names = F.array(*[F.lit(f) for f in features])
    out = every.select(names[F.col("feature")].alias("feature"), (F.coalesce("importance", F.lit(0.0)) / F.sum("importance").over(total)).alias("importance"))
    ordered = out.orderBy(F.desc("importance"), "feature")
    return ordered.limit(top) if top else ordered
