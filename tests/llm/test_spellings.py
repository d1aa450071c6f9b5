import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelforge.llm import spellings as s


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def result(df):
    rows = df.collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def table(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)


def some_words(seed, n, letters="abé", sizes=(4, 5, 6, 7, 9)):
    r = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(r.choice(letters) for _ in range(r.choice(sizes)))
        out[w] = r.choice([5, 6, 30, 31, 150, 160, 800, 4000, 25000])
    return out


@pytest.mark.parametrize("nodes", [1, 8, 8192])
def test_equals_every_pair(spark, nodes):
    n = some_words(nodes, 350)
    want = brute(n)
    assert sum(x[1] is not None for x in want) > 100 and any(x[2] != x[1] for x in want if x[1])
    assert result(s.variants(table(spark, n), nodes=nodes)) == want


def test_a_long_chain_reaches_its_root(spark):
    n = {"a" * (6 + i): 5 ** (i + 1) for i in range(14)}
    got = {r[0]: r[2] for r in result(s.variants(table(spark, n)))}
    assert set(got.values()) == {"a" * 19}


def test_prefixes_are_bounded_and_shared(spark):
    """Two near words share a listed gram, and a word lists at most one more than an edit can change."""
    n = some_words(7, 200, sizes=(6, 7, 8))
    words = table(spark, n).withColumn("padded", F.concat(F.lit(s.FIRST), "word", F.lit(s.LAST))).withColumn("id", F.col("word"))
    for nodes in (2, 50):
        listed = {r.id: {x.gram for x in r.prefix} for r in s.prefixes(words, nodes).collect()}
        sizes = [len(r.prefix) for r in s.prefixes(words, nodes).collect()]
        assert max(sizes) <= s.LONGEST + 1
        assert all(listed[a] & listed[b] for a in n for b in n if a < b and one_edit(a, b))


def test_counts_of_runs(spark, prose, odd_docs, no_docs):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Éclairs", "abcdef", "ABCDEFG", "abc×def", "ab÷cdefg", "straße", "naïvete", "ΑΒΓabcdef", "abcdef9abcdefg"]) for _ in range(60))) for i in range(150)]
    df = spark.createDataFrame(rows + [(None, "abcdef " * 9), (1, None), (1, "")], "doc_id long, text string")
    want = counted([(x.doc_id, x.text) for x in df.collect()])
    got = {x.word: x.n for x in s.vocabulary(df).collect()}
    assert got == want and len(got) >= 10
    for odd in odd_docs:
        odd = odd.withColumnRenamed(odd.columns[-1], "Word")
        assert {x.word: x.n for x in s.vocabulary(odd).collect()} == counted([(x.doc_id, x.text) for x in odd.collect()])
    assert result(s.variants(s.vocabulary(no_docs))) == set()


def test_odd_words(spark):
    long = "ab" * 20_000
    n = {long: 50, long[:-1]: 6, long + "c": 7, "abcdef": 5, "abcdeg": 25}
    df = spark.createDataFrame([*n.items(), (None, 9)], "word string, n long")
    got = {r[0][:9] + str(len(r[0])): r[1:2] + r[3:] for r in result(s.variants(df))}
    assert got["ababababa39999"] == (long, 6, 1, 50) and got["ababababa40001"] == (long, 7, 1, 50)
    assert got["ababababa40000"] == (None, 50, 2, None) and got["abcdef6"] == ("abcdeg", 5, 1, 25) and len(got) == 5
    with pytest.raises(ValueError):
        s.variants(spark.createDataFrame([("abc", 9)], "word string, n long"))
