"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelforge.llm.base import col, query, table, without
from panelforge.session import durable

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def sized(docs: DataFrame, id_: str, source: str, text: str) -> DataFrame:
    """Words of each row, and its place in the shuffle: a digest of the id, in 4096 buckets of equal width."""
    digest = F.md5(F.concat(F.lit("mix-"), F.coalesce(col(id_).cast("string"), F.lit("")))) 
    df = docs.select(
        col(id_).alias("id"),
        col(source).alias("source"),
        F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        digest.alias("place"),
    )
    return df.withColumn("bucket", F.substring("place", 1, 3))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source with its target; ``sizes`` has a source's words in any number of rows.

    Sources sorted by the words per weight at which they are full; the level
    that spends the budget on those not full is the largest that any split of
    this order gives. One row per source meets in one task here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full", F.col("source").asc_nulls_last())
    before, onwards = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per_source = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "budget": F.sum("source_size").over(everything) * F.lit(float(share))})
    ranked = ranked.withColumn("full", F.col("cap") / F.col("weight"))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(onwards))
    ranked = ranked.withColumn("level", F.max("level").over(everything))
    return ranked.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, id_: str = "doc_id", source: str = "source", text: str = "text",
           weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Every copy of every row that the mix could take, with its virtual finish time and what the mix takes of it.

    Rows of a source stand in the order of a digest of their id. A copy's
    finish time is the words of its source up to its end, divided by the
    source's target; the second round through a source follows the first. All
    sources reach their targets at time 1; the copy that a source is then
    serving is cut in two, and its second part finishes later. The copies of
    all sources are dealt into ranges of finish times over all partitions, and
    words are taken in this order until the budget, the sum of the targets, is
    spent: the words of earlier ranges, and a running sum inside each range.

    The words of a source up to a row are made by running sums inside buckets
    of the digest and over the sums of the buckets, so that a source that
    holds most rows is still spread. Columns: id, source, bucket, row (unique
    in its source and bucket), place, size, source_size, target, copy, part,
    words, finish, taken.
    """
    rows = durable(sized(docs, id_, source, text))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(sums, weights, share, most).withColumnRenamed("source", "_source")
    plan = sums.withColumn("before", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
    plan = plan.join(goals, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before", "source_size", "target"
    )
    order = Window.partitionBy("source", "bucket").orderBy("place", "id", "size")
    rows = rows.withColumns({
        "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "row": F.row_number().over(order),
    })
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    rounds = int(-(-most // 1))
    rows = rows.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(rounds)])))
    end = F.col("copy") * F.col("source_size") + F.col("before") + F.col("upto")
    early = F.greatest(F.lit(0), F.least("size", F.floor("target") - F.col("end") + F.col("size"))).cast("long")
    time = F.when(F.col("target") > 0, F.col("end") / F.col("target")).otherwise(F.lit(float("inf")))
    late = F.struct(F.lit(1).alias("part"), (F.col("size") - early).alias("words"), F.greatest(time, F.lit(1.0)).alias("finish"))
    first = F.struct(F.lit(0).alias("part"), early.alias("words"), F.least(time, F.lit(1.0)).alias("finish"))
    rows = rows.withColumn("end", end).withColumn("p", F.explode_outer(F.array(first, late))).where(
        (F.col("p.words") > 0) | ((F.col("p.part") == 0) & (F.col("size") == 0))
    )
    rows = rows.select("id", "source", "bucket", "row", "place", "size", "source_size", "target", "copy", "p.*")
    budget = goals.agg(F.sum(F.floor("target").cast("long"))).scalar()
    return _served(rows, budget)


ORDER = ("finish", "part", "source", "place", "id", "size", "copy")


def _served(rows: DataFrame, budget) -> DataFrame:
    """``rows`` with the words taken of each, in the order of finish times, until the budget is spent."""
    ranged = durable(rows.repartitionByRange(*ORDER).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("range").agg(F.sum("words").alias("all"))
    # One row for each range: as many as partitions.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(sums.select("range", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("start")))
    inside = Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.join(starts, "range").withColumn("upto", F.col("start") + F.sum("words").over(inside))
    taken = F.greatest(F.lit(0), F.least("words", budget - F.col("upto") + F.col("words"))).cast("long")
    return upto.withColumn("taken", taken).drop("range", "start", "upto")


def mix(docs: DataFrame, id_: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix as a stream in the order of finish times, sorted over all partitions and ending with the budget.

    Null texts and texts without words have no words and are never taken; a
    null source is a source of its own, after all others; a null id has its
    place like any other; rows that agree in everything are separate rows. An
    empty table gives an empty mix.
    """
    taken = copies(docs, id_, source, text, weights, share, most).where("taken > 0")
    return taken.drop("bucket", "row", "part", "words").orderBy("finish", F.col("source").asc_nulls_last(), "place", "copy")


def shares(docs: DataFrame, id_: str = "doc_id", source: str = "source", text: str = "text", **kw) -> DataFrame:
    """One row per row of ``docs``: its words, those of its source, the source's target, the words taken."""
    key = ["source", "bucket", "row"]
    return copies(docs, id_, source, text, **kw).groupBy(*key, "id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))


def kept(docs: DataFrame, id_: str = "doc_id", source: str = "source", text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` of which the mix takes words, with the words taken.

    Rows that agree in id and source are in or out together; each then shows the words taken of all of them.
    """
    found = shares(docs, id_, source, text, **kw).groupBy("id", "source").agg(F.sum("taken").alias("taken")).where("taken > 0")
    found = found.select(F.col("id").alias("_id"), F.col("source").alias("_source"), "taken")
    df = without(docs, "taken")
    return df.join(found, col(id_).eqNullSafe(F.col("_id")) & col(source).eqNullSafe(F.col("_source"))).drop("_id", "_source")


@query("op3_mixing", sql="""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, source_size * CAST(2 AS DOUBLE) AS cap, source_size * CAST(2 AS DOUBLE) / weight AS at_full,
    sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget FROM s),
v AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY at_full, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY at_full, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM c),
t AS (SELECT source, source_size, least(cap, max(lvl) OVER () * weight) AS target FROM v),
r AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d)
SELECT doc_id, size, source_size, target,
  greatest(0, least(size, CAST(floor(target) AS BIGINT) - before))
    + greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - before)) AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source""")
def op3_mixing(spark, folder):
    """All documents; sources weigh 3, 1, 2 in turn and share 150% of all words, at most twice their own."""
    got = shares(table(spark, folder, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
