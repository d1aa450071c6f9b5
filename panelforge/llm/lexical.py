"""Ranked lexical search: impact lists over shards of the documents, stopped by best positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from panelforge.llm.base import Words, col, flat, from_planes, pieces, planes, query, slices, starts_of, table
from panelforge.llm.contamination import letters_and_digits
from panelforge.session import durable

SLICE = 1 << 20
# A bit map of fixed size keeps terms of no item out of the index; one bit a term, by its hash.
BITS = 1 << 20
SHARD, BLOCK = 32 << 20, 4 << 20
FIRST_DEPTH = 32
SEED = 11


def _counted(text: str, wanted=None):
    """Terms of each row as hashes with their numbers of places; with a bit map, only terms that it holds."""

    def run(batches):
        words = Words(letters_and_digits(), SEED)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column(text))
            n, terms, tfs = [], [], []
            for a, b in slices(offsets, SLICE):
                hashes, _, _, of = words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
                n.append(np.diff(of))
                row = np.repeat(np.arange(b - a), np.diff(of))
                if wanted is not None:
                    keep = wanted.value[(hashes % np.uint64(BITS)).astype(np.int64)]
                    hashes, row = hashes[keep], row[keep]
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                first = starts_of(row, hashes)
                many = np.diff(np.append(first, len(row)))
                at = np.searchsorted(row[first], np.arange(b - a + 1))
                for i in range(b - a):
                    own = slice(at[i], at[i + 1])
                    terms.append(planes(hashes[first[own]]))
                    tfs.append(many[own].astype("<u4").tobytes())
            out = batch.select([c for c in batch.schema.names if c != text])
            yield (
                out.append_column("n", pa.array(np.concatenate(n), pa.int64()))
                .append_column("terms", pa.array(terms, pa.binary()))
                .append_column("tfs", pa.array(tfs, pa.binary()))
            )

    return run


def _pairs(batches):
    """One row for each term of each row: (key, term, tf)."""
    for batch in batches:
        hashes = [from_planes(x.as_py()) for x in batch.column("terms")]
        many = [len(h) for h in hashes]
        tf = [np.frombuffer(x.as_py(), "<u4") for x in batch.column("tfs")]
        none = np.zeros(0, np.uint64)
        key = batch.column("key").take(pa.array(np.repeat(np.arange(len(many)), many)))
        yield pa.RecordBatch.from_arrays(
            [key, pa.array(np.concatenate([none, *hashes]).view(np.int64)), pa.array(np.concatenate([none, *tf]).astype(np.int64))],
            ["key", "term", "tf"],
        )


def queries_of(items: DataFrame, item: str, text: str) -> DataFrame:
    """One row for each term of each item: ``(key, term, tf)``; the texts of an id are one item, equal ones once."""
    one = items.select(col(item).alias("key"), col(text).alias("t")).distinct()
    one = one.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("t"))
    kind = one.schema["key"].dataType.simpleString()
    counted = one.mapInArrow(_counted("t"), f"key {kind}, n long, terms binary, tfs binary")
    return counted.mapInArrow(_pairs, f"key {kind}, term long, tf long")


class Shard:
    """The impact lists of a shard: for each term its rows by falling impact, and the impact of any row."""

    def __init__(self, terms: list[bytes], tfs: list[bytes], m: np.ndarray):
        terms = [from_planes(x).view(np.int64) for x in terms]
        tf = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, "<u4").astype(np.int64) for x in tfs]])
        many = np.array([len(t) for t in terms], np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *terms])
        row = np.repeat(np.arange(len(many)), many)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        by_row = np.lexsort((row, term))
        self.row, self.impact = row[by_row], impact[by_row]
        term = term[by_row]
        first = starts_of(term)
        self.terms, self.start = term[first], np.append(first, len(term))
        # Within each list: where the row of a place by row stands by impact, and the other way round.
        self.sorted = np.lexsort((self.row, -self.impact, np.repeat(np.arange(len(first)), np.diff(self.start))))
        self.place = np.empty(len(term), np.int64)
        self.place[self.sorted] = np.arange(len(term))

    def list_of(self, term: int) -> tuple[int, int]:
        k = int(np.searchsorted(self.terms, term))
        found = k < len(self.terms) and self.terms[k] == term
        return (int(self.start[k]), int(self.start[k + 1])) if found else (0, 0)


def best_positions(shard: Shard, terms, weights, ids: np.ndarray, k: int):
    """The k rows of largest score, ties to smaller ids, and how many rows were read from the lists.

    The lists are read side by side from the largest impact down. Each row
    seen is at once looked up in every list (direct access), which gives its
    whole score and marks its position in every list as seen. The best position of a
    list is the last of its positions seen without a gap from the first, so
    no unseen row can score more than the impacts at the best positions add
    up to; reading stops when that falls strictly below the k-th score.
    """
    lists = [(a, b, int(w)) for (a, b), w in ((shard.list_of(t), w) for t, w in zip(terms, weights)) if b > a and w > 0]
    none = np.zeros(0, np.int64)
    if not lists:
        return none, none, 0
    seen = [np.zeros(b - a + 1, bool) for a, b, _ in lists]
    best = [0] * len(lists)
    rows, scores, read, depth = none, none, 0, 0
    while True:
        until = depth * 2 or FIRST_DEPTH
        new = np.unique(np.concatenate([shard.row[shard.sorted[a + depth : min(b, a + until)]] for a, b, _ in lists]))
        read += sum(max(0, min(b, a + until) - a - depth) for a, b, _ in lists)
        depth = until
        new = new[~np.isin(new, rows)]
        score = np.zeros(len(new), np.int64)
        for i, (a, b, w) in enumerate(lists):
            own = shard.row[a:b]
            at = np.minimum(np.searchsorted(own, new), b - a - 1)
            there = own[at] == new
            score += np.where(there, w * shard.impact[a:b][at], 0)
            seen[i][shard.place[a:b][at[there]] - a] = True
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, score])
        threshold = 0
        for i, (a, b, w) in enumerate(lists):
            best[i] += int(np.argmin(seen[i][best[i] :]))  # the last place is never seen and ends the search
            if best[i] < b - a:
                # Unseen rows stand after the best position: none has more than the impact of the next.
                threshold += w * int(shard.impact[shard.sorted[a + best[i]]])
        kth = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -1
        if threshold < kth or all(p == b - a for p, (a, b, _) in zip(best, lists)):
            break
    order = np.lexsort((ids[rows], -scores))[:k]
    order = order[scores[order] > 0]
    return rows[order], scores[order], read


def _search(k: int, schema: pa.Schema):
    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and items.num_rows:
            shard = Shard(docs["terms"].to_pylist(), docs["tfs"].to_pylist(), docs["m"].to_numpy())
            named = docs["id"].combine_chunks()
            order = pc.rank(named, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy()
            for item, terms, weights in zip(*[items[c].to_pylist() for c in ("item", "t", "w")]):
                rows, scores, _ = best_positions(shard, terms, weights, order, k)
                out += [(item, named[int(r)].as_py(), int(s)) for r, s in zip(rows, scores)]
        return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def ranked(docs: DataFrame, items: DataFrame, id_: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents for each item: ``(item_id, rank, doc_id, score)``.

    One pass counts the terms of every whole text. Numbers of rows, of terms
    and of rows a term are taken over all documents. The documents are dealt
    into shards of about ``shard`` bytes of text, the items into blocks of
    about ``block`` bytes, and each pair of a shard and a block is searched in
    one task by :func:`best_positions`; the best of all shards are then ranked.

    Null and empty texts have no terms and are never found; a null document id stands
    after all others among equal scores; documents that share an id are ranked
    each on its own. The texts of items that share an id are one item, equal
    ones taken once; an item without terms finds nothing. Empty tables give no
    rows. Other columns are not looked at. A length or number that leaves 64
    bits raises an error. Two terms are taken for one if their hashes of 64
    bits agree.
    """
    spark = docs.sparkSession
    asked = durable(queries_of(items, item, item_text))
    bits = asked.select(F.col("term").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("b")).distinct()
    wanted = np.zeros(BITS, bool)
    wanted[[r.b for r in bits.collect()]] = True  # at most BITS rows, whatever the items
    kind = docs.schema[id_].dataType.simpleString()
    base = docs.select(col(id_).alias("id"), col(text).alias("_t"))
    total = base.agg(F.sum(F.octet_length("_t")).alias("s"), F.count("*").alias("n")).first()
    shards = max(1, -(-int(total["s"] or 0) // shard))
    counted = durable(base.mapInArrow(_counted("_t", spark.sparkContext.broadcast(wanted)), f"id {kind}, n long, terms binary, tfs binary"))
    sums = counted.agg(F.count_if(F.col("n") > 0).alias("N"), F.sum("n").alias("L")).first()
    many, length = int(sums["N"]), int(sums["L"] or 0)
    if not length:
        return spark.createDataFrame([], f"item_id {asked.schema['key'].dataType.simpleString()}, rank int, doc_id {kind}, score long")
    df = counted.withColumnRenamed("id", "key").where("octet_length(tfs) > 0").mapInArrow(_pairs, f"key {kind}, term long, tf long")
    df = durable(df.groupBy("term").agg(F.count("*").alias("df")).join(asked.select("term").distinct(), "term", "left_semi"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * many + 2) / (2 * F.col("df") + 1))).cast("long")
    of_item = asked.join(df, "term").select("key", "term", (weight * F.col("tf")).alias("w")).where("w > 0")
    of_item = of_item.groupBy(F.col("key").alias("item")).agg(F.collect_list("term").alias("t"), F.collect_list("w").alias("w"))
    of_item = durable(of_item)
    blocks = pieces(of_item, F.size("t") * 16, block)
    m = F.expr(f"25L + (75L * n * {many}L) div {length}L")
    lists = counted.where("octet_length(tfs) > 0").select("id", "terms", "tfs", m.alias("m"), F.pmod(F.xxhash64("id", "terms", F.monotonically_increasing_id()), F.lit(shards)).alias("s"))
    lists = lists.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = of_item.withColumns({"b": F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"), "s": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))})
    schema = StructType([
        StructField("item_id", asked.schema["key"].dataType), StructField("doc_id", docs.schema[id_].dataType), StructField("score", LongType()),
    ])
    n = max(shards * blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = lists.repartition(n, "s", "b").groupBy("s", "b").cogroup(both.repartition(n, "s", "b").groupBy("s", "b")).applyInArrow(_search(k, to_arrow_schema(schema)), schema)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


@query("op11_search", sql=r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS many, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY ALL),
p AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(many) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term),
sc AS (
  SELECT item_id, row, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * many) // words)))) AS BIGINT) AS score
  FROM q JOIN wt USING (term) JOIN tf USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""")
def op11_search(spark, folder):
    """Ten documents for each test item."""
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
