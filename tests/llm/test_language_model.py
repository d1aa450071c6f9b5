import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from panelforge.llm import language_model as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def check(df, train, **kw):
    rows = df.collect()
    learnt = [tokens(r.text) for r in rows if train(r)]
    count = collections.Counter(t for d in learnt for t in d)
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(r.doc_id), len(tokens(r.text)), sum(count[t] > 0 for t in tokens(r.text)), n,
         round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(r.text)), 6)) for r in rows
    )
    got = lm.scored(df, F.col("train"), **kw).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    return got


def test_counts_and_base_are_exact(spark, prose):
    docs = [(i, prose(i % 60, 80), zlib.crc32(str(i).encode()) % 7 != 2) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, train boolean")
    for size in ((1 << 10, 1 << 11), (1 << 23, 1 << 24)):
        got = check(df, lambda r: r.train, chunk=size[0], segment=size[1])
        assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_chunks_do_not_change_the_score(spark, prose):
    docs = [(i, prose(i % 30, 60), i % 3 > 0) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, train boolean")
    a, b = ({r.doc_id: r.score for r in lm.scored(df, F.col("train"), chunk=c, segment=1 << 24).collect()} for c in (1 << 9, 1 << 22))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_odd_rows(odd_docs, no_docs):
    for df in odd_docs:
        df = df.withColumn("train", F.col("n_chars") > 5)
        got = check(df, lambda r: bool(r.n_chars and r.n_chars > 5))
        assert all(r.score <= 0 for r in got)
    assert lm.scored(no_docs, F.lit(True)).collect() == []
    check(odd_docs[0].withColumn("train", F.lit(False)), lambda r: False)


def test_filter_gives_back_levels():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, 5000, dtype=np.uint64)
    levels = r.integers(1, 9, 5000).astype(np.uint8)
    f = lm.Filter(keys, levels)
    found = f.levels(keys)
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    assert (f.levels(r.integers(0, 2**63, 5000, dtype=np.uint64)) > 0).mean() < 0.02
    assert (lm.Filter(keys[:0], levels[:0]).levels(keys) == 0).all()
