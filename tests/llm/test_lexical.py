import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import lexical as x
from panelforge.llm.base import planes


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    many, length = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in tf:
            s = 0
            for t, times in q.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
                    m = 25 + 75 * sum(c.values()) * many // length
                    s += times * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda v: (v[0], v[1], v[2] or 0))[:k])]
    return sorted(out, key=repr)


def got(docs, items, **kw):
    return sorted([tuple(r) for r in x.ranked(docs, items, **kw).collect()], key=repr)


@pytest.fixture(scope="module")
def corpus(prose):
    r = random.Random(5)
    docs = [(i, prose(i % 37, r.choice([3, 20, 60, 200])) + (" rare" * (i % 5)) + " the" * (i % 3)) for i in range(400)]
    items = [(i, prose(1000 + i, r.randrange(1, 14)) + r.choice(["", " rare", " THE the the", " nowhere"])) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("shard,block", [(x.SHARD, x.BLOCK), (20_000, x.BLOCK), (40_000, 400)])
def test_equals_scores_of_all_documents(spark, corpus, shard, block):
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 200 and len({w[3] for w in want}) < len(want)  # ties are among them
    assert got(df, bench, shard=shard, block=block) == want


def test_best_positions_stop_early():
    """Two lists that agree on their best rows: a few positions decide, of the many there are."""
    n = 20_000
    rare = np.array([5, 9], np.uint64)
    tfs = [np.array([1 + (i < 12) * (50 - i), 1 + (i < 12) * (40 - i)], "<u4").tobytes() for i in range(n)]
    shard = x.Shard([planes(rare)] * n, tfs, np.full(n, 100 + 0 * n))
    rows, scores, read = x.best_positions(shard, [5, 9, 77], [3, 2, 9], np.arange(n), 10)
    assert rows.tolist() == list(range(10)) and (np.diff(scores) < 0).all() and read <= 4 * x.FIRST_DEPTH
    # Equal scores beyond the first rows: all of a tie must be seen before the smallest ids are known.
    rows, _, read = x.best_positions(shard, [5, 9], [3, 2], -np.arange(n), 13)
    assert rows.tolist()[:12] == list(range(12)) and rows[12] == n - 1 and read == 2 * n


def test_odd_rows(spark, odd_docs, no_docs):
    text = odd_docs[0].first().text
    items = [(1, text), (1, text), (1, "al"), (None, "ben"), (2, None), (3, ""), (4, "!?")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS Score")
    for df in odd_docs:
        df = df.withColumnRenamed(df.columns[-1], "Rank")
        assert got(df, bench) == brute([(r.doc_id, r.text) for r in df.collect()], items)
    assert got(no_docs, bench) == [] and got(odd_docs[0], bench.limit(0)) == []


def test_large_and_named_ids(spark):
    docs = [(2**62 + 1, "aa bb"), (2**62, "aa bb"), (None, "aa bb"), (3, "cc"), (4, "cc dd")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([("q", "aa")], "item_id string, text string")
    assert [r.doc_id for r in sorted(x.ranked(df, bench).collect(), key=lambda r: r["rank"])] == [2**62, 2**62 + 1, None]
    named = df.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert [r.doc_id for r in sorted(x.ranked(named, bench).collect(), key=lambda r: r["rank"])] == [f"d{2**62}", f"d{2**62 + 1}", None]
