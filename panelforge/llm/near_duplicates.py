"""Near duplicates by BagMinHash signatures of word shingles, banded, and verified on whole multisets.

**Signature.** A text is a bag: shingles of five words with their counts.
Each shingle throws points by Poisson processes over the intervals [0, 1),
[1, 2), [2, 4), [4, 8) ... of its count, at a rate of the interval's length;
a point carries a time, a place in the interval and a register. A text takes
the points below its counts, and a register keeps its first one. Two texts
agree in a register with the probability of their weighted Jaccard similarity.
Points are drawn only up to the time that fills all registers.

**Bands.** Texts that agree in a band of registers meet. Exact copies are
folded first. Each band value then has a hub, its smallest id; every text is
compared with its hubs, which links dense groups with few comparisons. Texts
that meet under one hub and are still in different classes are compared in
blocks of 256 against 256, a table of overlaps at a time, so that no pair that
meets is left out; pairs inside a class are not compared, pairs of unlike
texts never become rows, and a block reports only what joins its classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from panelforge.llm.base import Words, col, flat, mixed, query, slices, spaced, starts_of, table, without
from panelforge.session import durable

SLICE = 1 << 19
_UNIT = 2.0**40


def shingles(words: Words, data: np.ndarray, offsets: np.ndarray, size: int):
    """Hashes of all runs of ``size`` words, and the n + 1 offsets of the texts; a shorter text is one run."""
    hashes, _, _, of = words(data, offsets)
    count = np.diff(of)
    many = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    to = np.concatenate([[0], np.cumsum(many)])
    start = np.arange(to[-1]) - np.repeat(to[:-1] - of[:-1], many)
    stop = np.repeat(of[1:], many)
    out = np.zeros(len(start), np.uint64)
    for j in range(size):
        at = start + j
        word = hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else hashes
        out = np.where(at < stop, mixed(out * np.uint64(0x9E3779B97F4A7C15) + word), out)
    return out, to


def bags(hashes: np.ndarray, to: np.ndarray):
    """Distinct shingles (48 bits) with text and count."""
    text = np.repeat(np.arange(len(to) - 1, dtype=np.uint64), np.diff(to))
    keys = np.sort((text << np.uint64(48)) | (hashes >> np.uint64(16)))
    at = starts_of(keys)
    keys = keys[at]
    return keys & np.uint64(2**48 - 1), (keys >> np.uint64(48)).astype(np.int64), np.diff(np.append(at, int(to[-1])))


def signatures(element: np.ndarray, text: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """First times of each register, for ``texts`` bags; the largest integer where a bag is empty."""
    never = np.iinfo(np.int64).max
    out = np.full(texts * registers, never)
    # The intervals of each element: level 0 is [0, 1), level k is [2^(k-1), 2^k).
    top = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(int), 0) + 1
    which = np.repeat(np.arange(len(count)), top)
    level = np.arange(len(which)) - np.repeat(np.cumsum(top) - top, top)
    below = np.where(level > 0, 2.0 ** np.maximum(level - 1, 0), 0.0)
    rate = np.where(level > 0, below, 1.0)
    share = np.clip((count[which] - below) / rate, 0, 1)
    seed = mixed(element[which] * np.uint64(64) + level.astype(np.uint64))
    of = text[which]
    weight = np.bincount(text, count, texts)
    limit = _UNIT * registers * (np.log(registers) + 3) / np.maximum(weight, 1)
    time = np.zeros(len(which), np.int64)
    drawn = np.zeros(len(which), np.int64)
    left = np.arange(len(which))
    while len(left):
        while len(left):
            # About as many points as the time that is left will take, one more at least.
            many = ((limit[of[left]] - time[left]) * rate[left] / _UNIT).astype(np.int64) + 1
            row = np.repeat(left, many)
            begin = np.cumsum(many) - many
            number = drawn[row] + np.arange(len(row)) - np.repeat(begin, many)
            bits = mixed(seed[row] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            step = (-np.log1p(-((bits >> np.uint64(11)) * 2.0**-53)) * (_UNIT / rate[row])).astype(np.int64)
            # Times are integers, so that a sum is the same in whatever blocks it is drawn.
            total = np.cumsum(step)
            at = total - np.repeat(total[begin] - step[begin], many) + time[row]
            last = begin + many - 1
            time[left] = at[last]
            drawn[left] += many
            bits = mixed(bits)
            good = (at <= limit[of[row]]) & ((bits >> np.uint64(40)) * 2.0**-24 < share[row])
            register = (bits & np.uint64(0xFFFFFF)).astype(np.int64) % registers
            np.minimum.at(out, of[row[good]] * registers + register[good], at[good])
            left = left[time[left] <= limit[of[left]]]
        # A text with an empty register goes on from the start, to twice the time.
        short = ((out.reshape(texts, registers) == never).any(1)) & (weight > 0)
        if short.any():
            limit = np.where(short, limit * 2, limit)
            left = np.flatnonzero(short[of])
            time[left] = 0
            drawn[left] = 0
    return out.reshape(texts, registers)


def band_values(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    parts = signature.view(np.uint64).reshape(len(signature), bands, rows)
    for j in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out


def _signed(text: str, size: int, bands: int, rows: int):
    def run(batches):
        words = Words(spaced(lower=True), 9)
        for batch in batches:
            data, offsets = flat(batch.column(text))
            values, weight = [], []
            for a, b in slices(offsets, SLICE):
                hashes, to = shingles(words, data[offsets[a] : offsets[b]], offsets[a : b + 1], size)
                values.append(band_values(signatures(*bags(hashes, to), b - a, bands * rows), bands, rows))
                weight.append(np.diff(to))
            values = np.concatenate(values) if values else np.zeros((0, bands), np.uint64)
            weight = np.concatenate(weight) if weight else np.zeros(0, np.int64)
            ends = np.arange(0, bands * (len(weight) + 1), bands, dtype=np.int32)
            out = batch.drop_columns([text]).append_column("weight", pa.array(weight, pa.int64()))
            yield out.append_column("bands", pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64))))

    return run


def similarity(words: Words, one: bytes, other: bytes, size: int) -> float:
    """Weighted Jaccard similarity of two texts: multiset overlap over multiset union."""
    a, b = (np.frombuffer(x, np.uint8) for x in (one, other))
    both, to = shingles(words, np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), size)
    x, y = both[: to[1]], both[to[1] :]
    if not len(x) or not len(y):
        return 0.0
    distinct, which = np.unique(both, return_inverse=True)
    n = np.bincount(which[: to[1]], minlength=len(distinct))
    m = np.bincount(which[to[1] :], minlength=len(distinct))
    return float(np.minimum(n, m).sum() / np.maximum(n, m).sum())


def _verified(size: int, least: float):
    def run(batches):
        words = Words(spaced(lower=True), 9)
        for batch in batches:
            good = [similarity(words, x.as_py() or b"", y.as_py() or b"", size) >= least for x, y in zip(batch.column("t"), batch.column("u"))]
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    return run


def linked(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Those of ``pairs`` (x, y) whose ``texts`` (id, text) are alike enough."""
    t = texts.select(F.col("id").alias("x"), F.col("text").alias("t")).hint("merge")
    u = texts.select(F.col("id").alias("y"), F.col("text").alias("u")).hint("merge")
    return pairs.join(t, "x").join(u, "y").mapInArrow(_verified(size, least), "x long, y long")


def numbered(hashes: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Shingles with the number of their occurrence in their text, so that a bag becomes a set of hashes."""
    text = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((hashes, text))
    key = hashes[order]
    at = starts_of(text[order], key)
    number = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    out = np.empty_like(hashes)
    out[order] = mixed(key + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def overlaps(one: list[np.ndarray], other: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many elements each set of ``one`` shares with each of ``other``: products of 0-1 tables, some columns at a time."""
    out = np.zeros((len(one), len(other)), np.float32)
    a, b = np.concatenate(one), np.concatenate(other)
    shared = np.intersect1d(a, b)
    sides = []
    for values, sets in ((a, one), (b, other)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        found = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[found], kind="stable")
        sides.append((row[found][order], at[found][order]))
    for k in range(0, len(shared), columns):
        tables = []
        for (row, at), n in zip(sides, (len(one), len(other))):
            x, y = np.searchsorted(at, [k, k + columns])
            t = np.zeros((n, min(columns, len(shared) - k)), np.float32)
            t[row[x:y], at[x:y] - k] = 1
            tables.append(t)
        out += tables[0] @ tables[1].T
    return out


def _blocks(size: int, least: float):
    """Links between classes in cells of (hub, i, j): texts of block i outside the hub's class against all of block j."""

    def run(cell: pa.Table) -> pa.Table:
        words = Words(spaced(lower=True), 9)
        data, offsets = flat(cell.column("text"))
        hashes, to = [], [np.zeros(1, np.int64)]
        for a, b in slices(offsets, SLICE):
            h, t = shingles(words, data[offsets[a] : offsets[b]], offsets[a : b + 1], size)
            hashes.append(numbered(h, t))
            to.append(t[1:] + to[-1][-1])
        hashes, to = np.concatenate(hashes), np.concatenate(to)
        ids, kind = np.asarray(cell.column("id")), np.asarray(cell.column("class"))
        out, left = np.asarray(cell.column("outside")), np.asarray(cell.column("left"))
        keys = [np.asarray(cell.column(c)) for c in ("hub", "i", "j")]
        order = np.lexsort(keys[::-1])
        at = starts_of(*[k[order] for k in keys])
        x, y = [], []
        for rows in np.split(order, at[1:]):
            one, other = rows[(left | (keys[1] == keys[2]))[rows] & out[rows]], rows[~left[rows]]
            if not len(one) or not len(other):
                continue
            a, b = ([hashes[to[r] : to[r + 1]] for r in side] for side in (one, other))
            both = overlaps(a, b)
            union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
            alike = (both >= least * union) & (kind[one][:, None] != kind[other][None, :])
            names, now = np.unique(np.concatenate([kind[one], kind[other]]), return_inverse=True)
            root = np.arange(len(names))
            for r in np.flatnonzero(alike.any(1)):
                own = now[r]
                for c in np.flatnonzero(alike[r]):
                    if root[now[len(one) + c]] != root[own]:
                        root[root == root[now[len(one) + c]]] = root[own]
                        x.append(int(ids[one[r]]))
                        y.append(int(ids[other[c]]))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return run


def linked_across(met: DataFrame, found: DataFrame, texts: DataFrame, size: int, least: float, block: int = 256, rows: int = 1024) -> DataFrame:
    """Links between members of one hub (hub, id) that ``found`` (id, class) has in different classes."""
    members = met.join(found, "id", "left").withColumn("class", F.coalesce("class", "id"))
    hubs = members.groupBy("hub").agg(
        F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"),
        F.max(F.when(F.col("id") == F.col("hub"), F.col("class"))).alias("own"),
    ).where("low < high")
    members = members.join(hubs.select("hub", "n", "own"), "hub")
    many = F.ceil(F.col("n") / block).cast("int")
    members = members.withColumns({"outside": F.col("class") != F.col("own"), "many": many})
    members = members.withColumn("b", F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("many") - 1))
    right = members.select("hub", "id", "class", "outside", F.lit(False).alias("left"), every.alias("i"), F.col("b").alias("j"))
    left = members.where("outside and many > 1").select("hub", "id", "class", "outside", F.lit(True).alias("left"), F.col("b").alias("i"), every.alias("j")).where("i <> j")
    sides = durable(right.union(left))
    cells = max(1, -(-sides.count() // rows))
    cell = F.pmod(F.xxhash64("hub", "i", "j"), F.lit(cells)).alias("cell")
    return sides.join(texts.hint("merge"), "id").select(cell, "*").groupBy("cell").applyInArrow(_blocks(size, least), "x long, y long")


def classes(edges: DataFrame) -> DataFrame:
    """Connected components (id, class): each id in ``edges`` (x, y) with the smallest id it is connected to.

    Large and small stars in turn: every id moves its larger, then its smaller
    neighbours to the smallest one, until no edge moves. Only edges and their
    sums cross the cluster; each round is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        ways = e.union(e.select("y", "x")) if large else e
        low = ways.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        moved = ways.join(low, "x").where("y > x" if large else "y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        if not large:
            moved = moved.union(low.select("x", F.col("m").alias("y")))
        return moved.where("x <> y").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()

    edges = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct()
    edges = durable(edges)
    before = state(edges)
    while before[0]:
        # A large star turns edges from the smaller end; order them from the larger one again.
        edges = star(edges, True).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        edges = durable(star(edges, False))
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("y").alias("id")).distinct().withColumn("class", F.col("id"))
    return edges.select(F.col("x").alias("id"), F.col("y").alias("class")).union(roots)


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8,
                    bands: int = 50, rows: int = 6) -> DataFrame:
    """One row per id: the smallest id of its class, and whether it is that one.

    Two texts are linked if the multisets of their runs of ``size`` words
    (between white space, A-Z as a-z; a shorter text is one run) have an
    overlap of at least ``least`` of their union; classes are what links
    connect. Fifty bands of six registers miss a pair at 0.8 with a
    probability of 3e-7, and a closer one less.

    Texts without words, null ones too, are like nothing, each its own class.
    Rows without an id are left out; rows that repeat an id are one document
    here, so their texts link what any of them links. No rows give none.
    """
    df = docs.select(col(id_).cast("long").alias("id"), col(text).cast("binary").alias("text")).where("id is not null")
    schema = StructType([StructField("id", LongType()), StructField("copy", df.select(F.md5("text")).schema[0].dataType), StructField("weight", LongType()), StructField("bands", ArrayType(LongType()))])
    signed = durable(df.withColumn("copy", F.md5("text")).select("id", "copy", "text").mapInArrow(_signed("text", size, bands, rows), schema))
    some = signed.where("weight > 0")
    firsts = some.groupBy("copy").agg(F.min("id").alias("y"), F.max("id").alias("last"))
    exact = some.select("id", "copy").join(firsts.where("y < last"), "copy").where("id <> y").select(F.col("id").alias("x"), "y")
    single = firsts.select(F.col("y").alias("id"))
    folded = some.join(single, "id", "left_semi")
    values = folded.select("id", F.posexplode("bands").alias("band", "value"))
    shared = values.groupBy("band", "value").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    met = durable(values.join(shared, ["band", "value"]).select("hub", "id").distinct())
    # Texts that meet another cross the cluster once; joins with texts are merges at every size.
    texts = durable(df.join(met.select("id").distinct().hint("merge"), "id", "left_semi"))
    pairs = met.where("id <> hub").select(F.col("id").alias("x"), F.col("hub").alias("y"))
    links = durable(linked(pairs, texts, size, least))
    found = durable(classes(links))
    more = linked_across(met, found, texts, size, least)
    final = classes(links.union(more).union(exact))
    ids = signed.select("id").distinct().join(final, "id", "left").withColumn("class", F.coalesce("class", "id"))
    return ids.select(F.col("id").alias(id_), F.col("class").alias("class_id"), (F.col("id") == F.col("class")).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents that stand for their class, and all rows without an id."""
    gone = near_duplicates(docs, id_, text, **kw).where("not kept").select(F.col(id_).alias("_gone"))
    return docs.join(gone, col(id_) == F.col("_gone"), "left_anti")


@query("op9_near_duplicates")
def op9_near_duplicates(spark, folder):
    """All documents, five words, 0.8."""
    return near_duplicates(table(spark, folder, "documents"))
