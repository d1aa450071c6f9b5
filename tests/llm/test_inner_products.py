import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import inner_products as ip


def brute(rows, k=10):
    use = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in use:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in use if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in ip.largest(df, F.col("vec_id") % 100 == 0, **kw).collect())


@pytest.mark.parametrize("kind", ["round", "long", "equal"])
def test_equals_all_products(spark, kind, monkeypatch):
    monkeypatch.setattr(ip, "BLOCK", 64)
    monkeypatch.setattr(ip, "SEEDS", 50)
    monkeypatch.setattr(ip, "QUERIES_AT_ONCE", 4)
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 24)) * (np.arange(1, 25) ** -0.7)
    if kind == "long":
        x *= r.pareto(1.5, (900, 1))
    if kind == "equal":
        x[200:700] = x[3]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    assert got(df) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (100, [1.0, None]), (2, [1.0, float("nan")]), (3, [float("inf"), 1.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0]),
            (200, []), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [9.0, 9.0]), (7, [-0.0005, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    assert got(df.where("vec_id = 0")) == []


@pytest.mark.parametrize("sizes", [[1e5], [1e5, 3e6, 1e9], [1e7, 1e20, 3e38]])
def test_long_vectors_take_part(spark, sizes):
    """Vectors of any finite length are queries and candidates; scores beyond 64 bits are NULL, their order is exact."""
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8))
    for n, size in enumerate(sizes):
        x[[7 + n, 100 * (n % 3), 150 + n], n] = size
        x[[31 + n, 200], n + 1] = -size
        x[40 + 10 * n : 45 + 10 * n] = x[7 + n]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    want = [(*t[:3], t[3] if -(2**63) <= t[3] < 2**63 else None) for t in brute(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert got(df) == want
    alone = [r for r in rows if max(map(abs, r[1])) >= 1e5]
    assert [t[:3] for t in got(df.where(F.exists("embedding", lambda v: F.abs(v) >= 1e5)))] == [t[:3] for t in brute(alone)]


def test_largest_doubles(spark):
    rows = [(0, [1e308, 1.0]), (100, [-1e308, 1.0]), (1, [1e307, 2.0]), (2, [0.5, 0.5]), (3, [-1e308, 3.0]), (4, [1e308, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [t[2] for t in got(df)] == [4, 1, 2, 3, 100, 3, 2, 1, 0, 4]


def test_bounds_skip_work():
    """Short candidates are not looked at once long ones have set the threshold."""
    r = np.random.default_rng(3)
    x = (r.normal(size=(4000, 32)) * 1024).astype(np.int64)
    x[2000:] //= 1000
    search = ip.Search(np.array([-1]), x[:1], np.eye(32), 5)
    seen = []
    real = ip.Search._block
    search._block = lambda ids, y, length: (seen.append(bool((search.length * length[0] >= search.least).any())), real(search, ids, y, length))[1]
    search.look(np.arange(4000), x)
    assert seen[0] and not seen[-1]
