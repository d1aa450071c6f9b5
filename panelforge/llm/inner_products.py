"""Exact largest inner products: candidates by descending length, partial sums in rotated axes, Cauchy-Schwarz bounds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelforge.llm.base import col, query, table
from panelforge.session import durable

LIMIT = 2.0**31
QUERIES_AT_ONCE, BLOCK, SEEDS, HEAD = 4096, 1024, 2048, 16


def usable(vectors: DataFrame, id_: str, vector: str, scale: int) -> DataFrame:
    """Vectors whose components are all finite; ``long`` ones have a scaled length of ``LIMIT`` or more."""
    x = col(vector)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    df = vectors.where(x.isNotNull() & col(id_).isNotNull() & good)
    df = df.select(col(id_).cast("long").alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x"))
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * scale * v * scale)
    return df.withColumn("long", squares >= LIMIT * LIMIT / 2)


def scaled(df: DataFrame, scale: int) -> DataFrame:
    """The vectors that are not long, with components floor(scale * x) and their squared length."""
    df = df.where(~F.col("long")).select("id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v"))
    return df.withColumn("squares", F.aggregate("v", F.lit(0).cast("double"), lambda a, v: a + v.cast("double") * v.cast("double")))


def _matrix(column, width: int, kind=np.int64) -> np.ndarray:
    """Rows of a list column, with zeros after the end of shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    flat, size = np.asarray(column.values), np.diff(ends)
    out = np.zeros((len(size), width), kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], size)] = flat[ends[0] : ends[-1]]
    return out


def _squares(width: int):
    """Sums of products of components over each batch, the input of the rotation."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(width * width)), "sum": pa.array(total.ravel())})

    return run


class Search:
    """A block of queries with the best candidates so far of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, k: int):
        self.ids, self.vectors, self.axes, self.k = ids, vectors, axes, k
        turned = vectors @ axes
        self.head = turned[:, :HEAD]
        self.length = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.rest = np.sqrt((turned[:, HEAD:] ** 2).sum(1))
        self.least = np.full(len(ids), -np.inf)
        self.score = np.zeros(0, np.int64)
        self.query = np.zeros(0, np.int64)
        self.found = np.zeros(0, np.int64)

    def look(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Add candidates, longest first."""
        length = np.sqrt((x.astype(float) ** 2).sum(1))
        order = np.argsort(-length)
        for a in range(0, len(order), BLOCK):
            self._block(ids[order[a : a + BLOCK]], x[order[a : a + BLOCK]], length[order[a : a + BLOCK]])

    def _block(self, ids, x, length) -> None:
        slack = 1e-9 * self.length * length[0] + 1e-6
        some = np.flatnonzero(self.length * length[0] + slack >= self.least)
        if not len(some):
            return
        turned = x @ self.axes
        rest = np.sqrt((turned[:, HEAD:] ** 2).sum(1))
        bound = self.head[some] @ turned[:, :HEAD].T + np.outer(self.rest[some], rest)
        q, c = np.nonzero(bound + slack[some, None] >= self.least[some, None])
        q = some[q]
        own = self.ids[q] != ids[c]
        q, c = q[own], c[own]
        # Sums below 2 ** 53 are exact as doubles.
        exact = np.abs(x).max(initial=0) * float(np.abs(self.vectors).max(initial=0)) * x.shape[1] < 2.0**53
        if len(q) * 8 > len(some) * len(ids) and exact:
            score = (self.vectors[some].astype(float) @ x.astype(float).T)[np.searchsorted(some, q), c].astype(np.int64)
        else:
            score = np.concatenate([np.einsum("ij,ij->i", self.vectors[q[i : i + 65536]], x[c[i : i + 65536]]) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0, np.int64)
        good = score >= self.least[q]
        self.query = np.concatenate([self.query, q[good]])
        self.found = np.concatenate([self.found, ids[c[good]]])
        self.score = np.concatenate([self.score, score[good]])
        order = np.lexsort((self.found, -self.score, self.query))
        place = np.arange(len(order)) - np.searchsorted(self.query[order], self.query[order])
        order = order[place < self.k]
        self.query, self.found, self.score = self.query[order], self.found[order], self.score[order]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.query[full]] = np.maximum(self.least[self.query[full]], self.score[full])


def _look(block, width: int):
    def run(batches):
        ids, vectors, axes, least, k = block.value
        search = Search(ids, vectors, axes, k)
        search.least = least.copy()
        for batch in batches:
            search.look(np.asarray(batch.column("id")), _matrix(batch.column("v"), width))
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[search.query], pa.int64()), "vec_id": pa.array(search.found, pa.int64()), "score": pa.array(search.score, pa.int64())})

    return run


def _floors(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as doubles, and the lengths; infinite where a double does not hold them."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
        return y, np.sqrt((y * y).sum(1))


def _integers(x: np.ndarray, y: np.ndarray, scale: int) -> np.ndarray:
    """The components of one vector as Python integers."""
    return np.array([int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(x.tolist(), y.tolist())], object)


class Exact:
    """A block of queries with the best candidates so far of each, for vectors of any length.

    Doubles tell, within their error, who can be among the best; those are
    scored with Python integers. Equal vectors are scored once.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: int, k: int):
        order = np.argsort(ids)
        self.ids, self.x, self.scale, self.k = ids[order], x[order], scale, k
        self.y, self.length = _floors(self.x, scale)
        self.least = np.full(len(ids), -np.inf)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.whole: dict[int, np.ndarray] = {}

    def look(self, ids: np.ndarray, x: np.ndarray, scale: int) -> None:
        for a in range(0, len(ids) if len(self.ids) else 0, BLOCK):
            self._block(ids[a : a + BLOCK], x[a : a + BLOCK], scale)

    def _block(self, ids, x, scale) -> None:
        x, group = np.unique(x, axis=0, return_inverse=True)
        group = group.ravel()
        order = np.lexsort((ids, group))
        members = np.split(ids[order], np.searchsorted(group[order], np.arange(1, len(x))))
        y, length = _floors(x, scale)
        with np.errstate(over="ignore", invalid="ignore"):
            near = self.y @ y.T
            slack = 2.3e-16 * (x.shape[1] + 8) * np.outer(self.length, length)
            low, high = near - slack, near + slack
        lost = ~(np.isfinite(low) & np.isfinite(high))
        low[lost], high[lost] = -np.inf, np.inf
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        own = self.ids[at] == ids
        low[at[own], group[own]] = -np.inf
        if len(x) >= self.k:
            self.least = np.maximum(self.least, np.partition(low, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero(high >= self.least[:, None])
        for i in set(q.tolist()) - self.whole.keys():
            self.whole[i] = _integers(self.x[i], self.y[i], self.scale)
        whole = {j: _integers(x[j], y[j], scale) for j in set(c.tolist())}
        for i, j in zip(q.tolist(), c.tolist()):
            score, mine = int(self.whole[i].dot(whole[j])), int(self.ids[i])
            if len(self.best[i]) >= self.k and -score > self.best[i][self.k - 1][0]:
                continue
            found = members[j][members[j] != mine][: self.k]
            self.best[i] = sorted(self.best[i] + [(-score, int(f)) for f in found])[: self.k]
        for i in set(q.tolist()):
            if len(self.best[i]) == self.k:
                self.least[i] = max(self.least[i], _below(-self.best[i][-1][0]))


def _below(score: int) -> float:
    """A double that is not above the integer."""
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return np.finfo(float).max if score > 0 else -np.inf


def _reach(score: int) -> str:
    """A text that sorts scores outside 64 bits before and after the others."""
    if -(2**63) <= score < 2**63:
        return INSIDE
    digits = str(abs(score))
    if score > 0:
        return f"2{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


INSIDE = "1"


def _look_exactly(block, width: int, scale: int):
    """Candidates with components floor(scale * v)."""

    def run(batches):
        search = Exact(*block.value)
        for batch in batches:
            search.look(np.asarray(batch.column("id")), _matrix(batch.column("v"), width, float), scale)
        rows = [(int(i), f, -s) for i, best in zip(search.ids, search.best) for s, f in best]
        reach = [_reach(s) for _, _, s in rows]
        score = [s if r == INSIDE else None for (_, _, s), r in zip(rows, reach)]
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()),
            "score": pa.array(score, pa.int64()), "reach": pa.array(reach, pa.string()),
        })

    return run


def _blocks(asked: DataFrame):
    """Queries as Arrow tables of about ``QUERIES_AT_ONCE`` rows."""
    blocks = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    for b in range(blocks):
        yield asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()


def _ids(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("id").combine_chunks())


def _usual(rows: DataFrame, asked: DataFrame, count: int, width: int, k: int):
    """Queries and candidates of ordinary length: one DataFrame for each block of queries."""
    spark = rows.sparkSession
    shape = "query_id long, vec_id long, score long"
    parts = max(1, -(-count // 16384))
    stored = durable(rows.repartitionByRange(parts, F.desc("squares"), F.xxhash64("id")).sortWithinPartitions(F.desc("squares")))
    sums = stored.mapInArrow(_squares(width), "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
    square = np.zeros(width * width)
    for r in sums:
        square[r["at"]] = r["sum"]
    axes = np.linalg.eigh(square.reshape(width, width))[1][:, ::-1]
    bound = stored.select("squares").orderBy(F.desc("squares")).limit(SEEDS).agg(F.min("squares")).first()[0]
    first = stored.where(F.col("squares") >= F.lit(bound)).limit(SEEDS).select("id", "v").toArrow()
    seeds = _ids(first), _matrix(first.column("v"), width)
    found = []
    for some in _blocks(asked):
        search = Search(_ids(some), _matrix(some.column("v"), width), axes, k)
        search.look(*seeds)
        block = spark.sparkContext.broadcast((search.ids, search.vectors, axes, search.least, k))
        found.append(stored.select("id", "v").mapInArrow(_look(block, width), shape).withColumn("reach", F.lit(INSIDE)))
    return stored, found


def _exactly(rows: DataFrame, asked: DataFrame, width: int, k: int, row_scale: int, asked_scale: int) -> list[DataFrame]:
    """Queries and candidates of which one side is long: one DataFrame for each block of queries."""
    shape = "query_id long, vec_id long, score long, reach string"
    found = []
    for some in _blocks(asked):
        block = rows.sparkSession.sparkContext.broadcast((_ids(some), _matrix(some.column("v"), width, float), asked_scale, k))
        found.append(rows.mapInArrow(_look_exactly(block, width, row_scale), shape))
    return found


def largest(vectors: DataFrame, queries, id_: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """For each row that the condition ``queries`` names, the ``k`` other rows of largest inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x); scores are exact integers, equal ones
    ordered by smaller id; all rows if there are fewer than ``k``. Candidates
    are sorted by length over the cluster and searched longest first, with
    queries in blocks of 4096 (which bounds what is broadcast) and one pass for
    each block. The longest candidates of all give every query a first
    threshold. A query skips a block whose longest vector cannot reach its
    threshold, and a candidate whose sum over the first rotated axes plus the
    product of both remainders cannot; such a bound is never below the score.

    Products of scaled vectors shorter than 2 ** 31 fit 64 bits. Longer vectors
    take part as queries and as candidates, too: their products are Python
    integers. The order is exact at any length; a score outside 64 bits shows
    as NULL.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id. Shorter vectors count as followed by zeros.
    Rows with the query's id are its own; of queries that repeat an id, one is
    asked. No rows give none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_, vector, scale)
    facts = rows.agg(F.max(F.size("x")).alias("width"), F.count_if(~F.col("long")).alias("usual"), F.count_if("long").alias("long")).first()
    width = int(facts.width or 0)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = durable(usable(vectors.where(queries), id_, vector, scale).dropDuplicates(["id"]))
    usual = scaled(asked, scale).select("id", "v")
    stored, found = _usual(scaled(rows, scale), usual, facts.usual, width, k) if facts.usual else (None, [])
    if facts.long:
        parts = max(1, -(-facts.long // 16384))
        long = durable(rows.where("long").select("id", F.col("x").alias("v")).repartition(parts, F.xxhash64("id")))
        long_asked = asked.where("long").select("id", F.col("x").alias("v"))
        found += _exactly(long, usual, width, k, scale, 1) + _exactly(long, long_asked, width, k, scale, scale)
        if stored is not None:
            found += _exactly(stored.select("id", F.col("v").cast("array<double>").alias("v")), long_asked, width, k, 1, scale)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reach"), F.desc("score"), "vec_id"))
    found = reduce(DataFrame.union, found)
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op6_inner_products", sql="""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op6_inner_products(spark, folder):
    """Every hundredth id against all rows, the ten largest."""
    return largest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
