"""Two detectors of multivariate outliers: isolation forest and density noise."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from panelforge.binding import col, quoted
from panelforge.functions import zscore
from panelforge.operators.aggregates import one_row
from panelforge.operators.boost import boxes
from panelforge.operators.quantiles import quantile_table
from panelforge.operators.sampling import hash_sample, row_hash
from panelforge.session import by_group, durable, spread

# Labels for the agreement of two detectors.
AGREEMENT = ("Normal", "Isolation Forest only", "DBSCAN only", "Both detectors")


def agreement(a: Column, b: Column) -> Column:
    """Which of two flags are set."""
    neither, first, second, both = AGREEMENT
    return (
        F.when(a & b, both).when(a, first).when(b, second).otherwise(neither)
    )


def prepare(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], most: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Complete rows with standardised features, optionally a sample of at most ``most`` rows."""
    rows = df.select(*[col(c) for c in ids], *[col(c).cast("double").alias(c) for c in features])
    rows = rows.dropna(subset=[quoted(c) for c in features])
    if most is not None:
        rows = hash_sample(rows, ids, most, seed)
    stats = one_row(
        rows,
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(features)],
    )
    return rows.withColumns(
        {c: zscore(col(c), stats[f"m{i}"], stats[f"s{i}"]) for i, c in enumerate(features)}
    )


# ------------------------------------------------------------ isolation forest

# Points that are compared with each other before any cells are.
TOGETHER = 2048
# Of the grid that a tree cuts, in which rows are looked up.
MOST_CELLS = 1 << 17
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def average_depth(n):
    """Mean depth of an unsuccessful search among ``n`` keys (Liu, Ting and Zhou, 2008)."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def tree_samples(
    df: DataFrame, ids: Sequence[str], trees: int, sample: int, seed: int
) -> DataFrame:
    """About as many rows for each tree as it needs, then the ``sample`` first by hash.

    Every row draws one hash. Of a large table only a small share stays; in a
    small one each row serves several trees. Either way the rows that go on
    number a few times ``trees * sample``, whatever the size of the table.
    """
    from panelforge.operators.windows import top_per_group

    total = df.agg(F.count("*")).scalar().cast("double")
    wanted = 2.0 * trees * sample
    keep = F.least(F.lit(1.0), wanted / total)
    copies = F.least(F.lit(trees), F.greatest(F.lit(1), F.ceil(wanted / total))).cast("int")
    draw = F.pmod(row_hash(ids, seed), F.lit(2**40)) / F.lit(float(2**40))
    first = F.pmod(row_hash(ids, seed + 1), F.lit(trees)).cast("int")
    spread = df.where(draw < keep).withColumn(
        "_step", F.explode(F.sequence(F.lit(0), copies - 1))
    )
    placed = spread.withColumn("tree", F.pmod(first + F.col("_step"), F.lit(trees)).cast("int"))
    order = F.xxhash64(*[col(c) for c in ids], F.col("tree"), F.lit(seed + 2))
    return top_per_group(placed.drop("_step"), ["tree"], [order.asc(), *[col(c) for c in ids]], sample)


def fit_isolation_forest(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], trees: int = 200,
    sample: int = 256, seed: int = 42,
) -> DataFrame:
    """Node table of the forest, one Spark task per group of trees.

    A tree sees at most ``sample`` rows, so the table has at most
    ``2 * trees * sample`` rows however large the input is.
    """
    # Plain names, as grouped functions refuse columns with dots.
    keys, names = [f"i{k}" for k in range(len(ids))], [f"f{k}" for k in range(len(features))]
    limit = math.ceil(math.log2(max(sample, 2)))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys)  # the same tree for any arrival order
        rng = np.random.default_rng([seed, int(key[0])])
        points = pdf[names].to_numpy(float)
        rows: list[list] = []
        waiting = [(points, 0)]
        rows.append([])
        place = [0]
        while waiting:
            part, depth = waiting.pop()
            at = place.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(part) < 2 or not len(usable):
                rows[at] = [at, -1, 0.0, -1, -1, depth + float(average_depth(len(part)))]
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            goes_left = part[:, f] <= cut
            left, right = len(rows), len(rows) + 1
            rows.extend([[], []])
            rows[at] = [at, f, cut, left, right, 0.0]
            waiting += [(part[goes_left], depth + 1), (part[~goes_left], depth + 1)]
            place += [left, right]
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "depth"])
        out.insert(0, "tree", int(key[0]))
        return out

    complete = df.select(
        *[col(c).alias(k) for c, k in zip(ids, keys)], *[col(c).cast("double").alias(k) for c, k in zip(features, names)]
    )
    samples = tree_samples(complete.dropna(subset=names), keys, trees, sample, seed)
    return by_group(samples, ["tree"]).groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def depth_tables(trees: list[tuple], width: int) -> tuple[list[np.ndarray], list[tuple | None]]:
    """All thresholds of each feature, and for each tree how to look a row's depth up by its ranks among them.

    A tree tells apart a grid of cells, between its own thresholds. Per feature an array
    turns the rank into the place on the grid, and the grid holds numbers of depths.
    A tree whose grid has more than ``MOST_CELLS`` cells has none.
    """
    inner = [left != np.arange(len(left)) for _, _, left, _, _ in trees]
    own = [[np.unique(t[on & (f == k)]) for k in range(width)] for (f, t, *_), on in zip(trees, inner)]
    every = [np.unique(np.concatenate([np.empty(0), *[o[k] for o in own]])) for k in range(width)]
    tables: list[tuple | None] = []
    for (feature, threshold, left, _, depth), on, at in zip(trees, inner, own):
        shape = tuple(len(a) + 1 for a in at)
        if math.prod(shape) > MOST_CELLS:
            tables.append(None)
            continue
        cut = np.array([np.searchsorted(at[f], t) for f, t in zip(feature, threshold)])
        depths, number = np.unique(depth, return_inverse=True)
        grid = np.zeros(shape, np.min_scalar_type(len(depths)))
        for leaf, box in boxes(np.where(on, feature, -1), cut, left, shape):
            grid[box] = number[leaf]
        steps = [math.prod(shape[k + 1 :]) for k in range(width)]
        places = [np.searchsorted(np.searchsorted(e, a), np.arange(len(e) + 1)) * step for e, a, step in zip(every, at, steps)]
        tables.append((places, grid.ravel(), depths))
    return every, tables


def isolation_scores(
    df: DataFrame, features: Sequence[str], forest: DataFrame, sample: int = 256,
    score: str = "score", partitions: int | None = None,
) -> DataFrame:
    """Anomaly score of each row, between 0 and 1; rows with a missing feature get NULL.

    The forest is collected: its size is set by its parameters, not by the data.
    ``partitions`` deals a short table out to so many tasks first.
    """
    nodes = forest.orderBy("tree", "node").toPandas()
    leaf = nodes["feature"] < 0
    nodes.loc[leaf, "left"] = nodes.loc[leaf, "node"]
    nodes.loc[leaf, "right"] = nodes.loc[leaf, "node"]
    nodes["feature"] = nodes["feature"].clip(lower=0)
    trees = [
        tuple(part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth"))
        for _, part in nodes.groupby("tree")
    ]
    shared = df.sparkSession.sparkContext.broadcast((trees, *depth_tables(trees, len(features))))
    norm = float(average_depth(sample))
    steps = math.ceil(math.log2(max(sample, 2)))

    @F.pandas_udf("double")
    def path_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        trees, every, tables = shared.value
        for frame in batches:
            points = frame.to_numpy(float)
            missing = np.isnan(points).any(axis=1)
            flat, width = points.ravel(), points.shape[1]
            first = np.arange(len(points)) * width
            ranks = [np.searchsorted(e, points[:, k]) for k, e in enumerate(every)]
            total = np.zeros(len(points))
            for (feature, threshold, left, right, depth), table in zip(trees, tables):
                if table is not None:
                    places, grid, depths = table
                    total += depths[grid[sum(place[r] for place, r in zip(places, ranks))]]
                    continue
                at = np.zeros(len(points), dtype=np.intp)
                for _ in range(steps):  # a leaf leads to itself
                    low = flat[first + feature[at]] <= threshold[at]
                    at = np.where(low, left[at], right[at])
                total += depth[at]
            score_ = 2.0 ** (-total / len(trees) / norm)
            yield pd.Series(np.where(missing, np.nan, score_))

    inputs = F.struct(*[col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    return spread(df, partitions).withColumn(score, path_score(inputs)).withColumn(
        score, F.when(~F.isnan(score), F.col(score))
    )


def isolation_forest(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], contamination: float = 0.01,
    trees: int = 200, sample: int = 256, seed: int = 42, flag: str = "outlier_iforest",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``score`` and a flag for the ``contamination`` share of rows with the highest scores."""
    forest = fit_isolation_forest(df, ids, features, trees, sample, seed)
    # Scores are written down: the threshold needs them twice before the flag.
    scored = durable(isolation_scores(df, features, forest, sample, partitions=partitions))
    limit = quantile_table(scored, [], {"_q": (F.col("score"), 1 - contamination)}).select("_q").scalar()
    return scored.withColumn(flag, F.coalesce(F.col("score") > limit, F.lit(False)))


# ---------------------------------------------------------------- density noise


def dbscan_noise(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], eps: float = 1.2,
    min_samples: int = 10, flag: str = "is_noise",
) -> DataFrame:
    """Mark the points that density clustering would leave out.

    A core point has at least ``min_samples`` points within ``eps``, itself
    included; noise is any point without a core point within ``eps``.

    Points fall into cells so small that all points of a cell are within
    ``eps`` of each other. A cell with ``min_samples`` points is core as a
    whole and needs no distances, however many points crowd in it. Only the
    thin cells are compared with the cells around them: by their counts where
    one cell lies within ``eps`` of the other as a whole, point by point only
    where that stays open. A thin cell has fewer than ``min_samples`` points,
    so the pairs grow with the number of points, not with its square.
    Before that, points are dealt into blocks of neighbours: one that has
    ``min_samples`` points within ``eps`` in its own block is core. Only cells
    with another point are thin.
    """
    d = len(features)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    near, sure = eps * eps * (1 + 1e-9), eps * eps * (1 - 1e-9)
    points = df.select(
        *[col(c) for c in ids],
        F.array(*[col(c).cast("double") for c in features]).alias("_x"),
    ).where(F.forall("_x", lambda x: x.isNotNull()))
    points = durable(points.withColumn(
        "_cell", F.transform("_x", lambda x: F.floor(x / side).cast("long"))
    ))
    points = durable(_marked(points, d, eps, min_samples))
    cells = durable(points.groupBy("_cell").agg(F.count("*").alias("_n"), F.bool_and("_sure").alias("_sure")).select(
        "_cell", "_n", ((F.col("_n") < min_samples) & ~F.col("_sure")).alias("_thin")))
    pairs = _cell_pairs(cells, side, near, sure, eps, d)
    pairs = durable(pairs)

    # What the counts of whole cells already decide.
    tally = pairs.groupBy("_cell").agg(
        F.sum(F.when(F.col("_inside"), F.col("_n")).otherwise(0)).alias("_at_least"),
        F.sum("_n").alias("_at_most"),
    )
    state = tally.select(
        "_cell", "_at_least",
        F.when(F.col("_at_least") >= min_samples, "core")
        .when(F.col("_at_most") < min_samples, "sparse").otherwise("open").alias("_state"),
    )
    thin = points.join(durable(state), "_cell")
    open_points = thin.where((F.col("_state") == "open") & ~F.col("_sure")).select(*ids, "_x", "_cell", "_at_least")
    edges = pairs.where(~F.col("_inside")).select("_cell", "_other")
    others = points.select(F.col("_cell").alias("_other"), F.col("_x").alias("_y"))
    distance = F.aggregate(
        F.zip_with("_x", "_y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
    )
    open_edges = open_points.join(edges, "_cell")
    needed = durable(open_edges.select("_other").distinct())
    counted = (
        open_edges.join(others.join(needed, "_other", "left_semi"), "_other")
        .where(distance <= eps * eps)
        .groupBy(*[col(c) for c in ids]).agg(F.count("*").alias("_close"))
    )
    resolved = open_points.join(counted, list(ids), "left").select(
        *ids, (F.col("_at_least") + F.coalesce("_close", F.lit(0)) >= min_samples).alias("_core")
    )
    judged = thin.join(resolved, list(ids), "left").select(
        *ids, "_x", "_cell",
        ((F.col("_state") == "core") | F.col("_sure") | F.coalesce("_core", F.lit(False))).alias("_core"),
    )
    judged = durable(judged)

    # Points that are not core: is any core point within reach?
    lonely = judged.where(~F.col("_core")).select(*ids, "_x", "_cell")
    thin_cores = judged.where("_core")
    dense_cells = cells.where(~F.col("_thin")).select(F.col("_cell").alias("_other"))
    core_cells = dense_cells.unionByName(
        thin_cores.select(F.col("_cell").alias("_other")).distinct()
    )
    reach = pairs.join(core_cells, "_other", "left_semi").select("_cell", "_other", "_inside")
    saved_whole = lonely.join(
        reach.where("_inside").select("_cell").distinct(), "_cell", "left_semi"
    ).select(*ids)
    rest = lonely.join(saved_whole, list(ids), "left_anti")
    core_points = others.join(dense_cells, "_other", "left_semi").unionByName(
        thin_cores.select(F.col("_cell").alias("_other"), F.col("_x").alias("_y"))
    )
    saved_near = (
        rest.join(reach.where(~F.col("_inside")).select("_cell", "_other"), "_cell")
        .join(core_points, "_other")
        .where(distance <= eps * eps).select(*ids).distinct()
    )
    noise = rest.select(*ids).join(saved_near, list(ids), "left_anti").withColumn(flag, F.lit(True))
    return points.select(*ids).join(noise, list(ids), "left").withColumn(
        flag, F.coalesce(flag, F.lit(False))
    )


def _marked(points: DataFrame, dims: int, eps: float, min_samples: int) -> DataFrame:
    """``points`` with ``_sure``: core by the points of its own block, at most ``TOGETHER`` that stand together on a curve through the cells."""
    bits = min(63 // dims, 16)
    at = [F.least(F.greatest(F.col("_cell")[i] + 2 ** (bits - 1), F.lit(0)), F.lit(2**bits - 1)) for i in range(dims)]
    curve = reduce(add, [F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)).cast("long"), b * dims + i) for b in range(bits) for i, x in enumerate(at)])

    def mark(batches):
        for batch in batches:
            x = np.asarray(batch["_x"].flatten(), float).reshape(batch.num_rows, dims)
            sure = np.zeros(len(x), bool)
            for a in range(0, len(x), TOGETHER):
                part = x[a : a + TOGETHER]
                apart = np.zeros((len(part), len(part)))
                for k in range(dims):
                    apart += (part[:, k, None] - part[:, k]) ** 2
                sure[a : a + TOGETHER] = (apart <= eps * eps).sum(axis=1) >= min_samples
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sure)], [*batch.schema.names, "_sure"])

    schema = StructType([*points.schema.fields, StructField("_sure", BooleanType())])
    dealt = points.withColumn("_at", curve).repartitionByRange("_at").sortWithinPartitions("_at")
    return dealt.drop("_at").mapInArrow(mark, schema)


def _leaves(cells: DataFrame, dims: int, span: int, leaf: int) -> DataFrame:
    """Cells dealt into the boxes of a k-d tree: one row of ``_own`` each, and copies of thin cells in all boxes in reach.

    A round cuts every box of more than ``leaf`` cells across its widest axis,
    at quantiles of its cells, into slabs that are wide next to the reach. A
    cell goes to its slab; the copy of a thin cell to all slabs within ``span``
    cells of it. A box no wider than the reach to both sides is not cut: every
    copy would go to both halves. By its size it holds at most
    (2 * span + 1)^dims cells. Boxes are rows, too, so the tree is never on
    the driver.
    """
    axes = [F.col("_cell")[i] for i in range(dims)]
    sixteenths = F.array(*[F.lit(k / 16) for k in range(1, 16)])
    once = cells.select("_cell", "_n", F.lit("").alias("_leaf"), "_thin")
    rows = durable(once.select("_cell", "_n", "_leaf", F.explode(
        F.when(F.col("_thin"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("_own")))
    placed = []
    while True:
        boxes = rows.where("_own").groupBy("_leaf").agg(
            F.count("*").alias("_size"),
            F.array(*[F.min(a) for a in axes]).alias("_low"),
            F.array(*[F.max(a) for a in axes]).alias("_high"),
            F.array(*[F.percentile_approx(a, sixteenths, 200) for a in axes]).alias("_at"),
        )
        width = F.zip_with("_high", "_low", lambda a, b: a - b)
        boxes = boxes.withColumn("_wide", F.array_max(width)).withColumn("_axis", (F.array_position(width, F.col("_wide")) - 1).cast("int"))
        step = F.when(F.col("_wide") >= 32 * span, 1).when(F.col("_wide") >= 4 * span, 4).otherwise(8)
        low, high = F.get("_low", "_axis"), F.get("_high", "_axis")
        cuts = F.array_distinct(F.filter(F.get("_at", "_axis"), lambda x, i: (x < high) & ((i + 1) % step == 0)))
        # Where most cells stand at the upper end, no quantile parts them: halve the width instead.
        halves = F.array(F.floor((low + high) / 2).cast("long"))
        boxes = durable(boxes.where((F.col("_size") > leaf) & (F.col("_wide") > 2 * span)).select(
            "_leaf", "_axis", F.when(F.size(cuts) > 0, cuts).otherwise(halves).alias("_cuts")))
        if boxes.isEmpty():
            return reduce(DataFrame.unionByName, [*placed, rows])
        value = F.get("_cell", "_axis")

        def slab(x: Column) -> Column:
            return F.size(F.filter("_cuts", lambda cut: cut < x))

        reach = F.when(F.col("_own"), 0).otherwise(span)
        slabs = F.sequence(slab(value - reach), slab(value + reach))
        moved = rows.join(boxes, "_leaf", "left").withColumn("_open", F.col("_cuts").isNotNull())
        moved = durable(moved.withColumn("_slab", F.explode(F.when(F.col("_open"), slabs).otherwise(F.array(F.lit(0))))).select(
            "_cell", "_n", "_own", "_open", F.when(F.col("_open"), F.concat("_leaf", F.hex("_slab"))).otherwise(F.col("_leaf")).alias("_leaf")))
        placed.append(moved.where("not _open").drop("_open"))
        rows = moved.where("_open").drop("_open")


def _met(cells: DataFrame, dims: int, span: int, leaf: int) -> DataFrame:
    """Pairs of a thin cell and a cell of the same box, each pair once."""
    rows = _leaves(cells, dims, span, leaf)
    left = rows.where(~F.col("_own")).select("_cell", "_leaf")
    right = rows.where("_own").select(F.col("_cell").alias("_other"), "_n", "_leaf")
    return left.join(right, "_leaf")


def _cell_pairs(
    cells: DataFrame, side: float, near: float, sure: float, eps: float, dims: int, leaf: int = 1024,
) -> DataFrame:
    """Thin cells with every cell that may hold a point within reach, itself included.

    The join runs over the boxes of a k-d tree over all axes, so a thin cell
    meets about ``leaf`` cells a box and few boxes. It moves cells, not points.
    """
    span = math.ceil(eps / side) + 1
    gaps = [F.abs(F.col("_cell")[i] - F.col("_other")[i]).cast("double") for i in range(dims)]

    def squared(extra: int) -> Column:
        return reduce(add, [F.pow(F.greatest(g + extra, F.lit(0.0)) * side, F.lit(2.0)) for g in gaps])

    joined = _met(cells, dims, span, leaf).where(squared(-1) <= near)
    return joined.select("_cell", "_other", "_n", (squared(1) <= sure).alias("_inside"))
