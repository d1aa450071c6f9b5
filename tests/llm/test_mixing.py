import re

from pyspark.sql import functions as F

from panelforge.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (left - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return {**full, **{s: level * weight[s] for s in rest}}
        full.update({s: most * sizes[s] for s in over})


def check(df, **kw):
    rows = df.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(sizes)
    got = mixing.shares(df, **kw).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.shares(df.repartition(3), **kw).collect()))


def test_sources_meet_their_targets(spark, prose):
    docs = [(i, prose(i, 5 + i % 40), "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    check(spark.createDataFrame(docs, "doc_id long, text string, source string"))


def test_stream_is_sorted_and_ends_with_the_budget(spark, prose):
    docs = [(i, prose(i, 30), f"s{i % 4}") for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    finish = [r.finish for r in rows]
    assert finish == sorted(finish) and abs(sum(r.taken for r in rows) - 1.5 * 3000) <= 4


def test_odd_rows(odd_docs, no_docs):
    for df in odd_docs:
        check(df)
        kept = mixing.kept(df.withColumn("TAKEN", F.lit(1)))
        assert kept.columns[-1] == "taken" and 3 not in {r.doc_id for r in kept.collect()}
    assert mixing.shares(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


def test_words_are_taken_in_the_order_of_finish_times(spark, prose):
    """Over all sources and ranges: whole pieces until the budget is spent, none after it."""
    docs = [(i, prose(i, 5 + i % 60), "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = mixing.copies(df).orderBy(*mixing.ORDER).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    taken = [(r.taken, r.words) for r in rows if r.words]
    last = max(i for i, (t, _) in enumerate(taken) if t)
    assert all(t == w for t, w in taken[: last + 1]) and not any(t for t, _ in taken[last + 1 :])
    budget = sum(int(t) for t in {r.source: r.target for r in rows}.values())
    assert sum(t for t, _ in taken) == budget and [r.finish for r in rows] == sorted(r.finish for r in rows)
    assert all(r.finish <= 1 for r in rows if r.taken) and any(r.part for r in rows)
