import collections
import random
import re

import numpy as np

from panelforge.llm import near_duplicates as nd
from panelforge.llm.base import Words, spaced


def bag(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return collections.Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else collections.Counter()


def brute(docs, least=0.8):
    bags = [(i, bag(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            union = sum((a | b).values())
            if union and sum((a & b).values()) / union >= least:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def got(df):
    rows = nd.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
    return {r.doc_id: r.class_id for r in rows}


def edited(text, share, r):
    return " ".join(w if r.random() > share else w + "q" for w in text.split(" "))


def test_equals_all_pairs(spark, prose):
    r = random.Random(3)
    docs = []
    for family in range(12):
        base = prose(family, 150)
        docs += [(family * 20 + k, edited(base, 0.004 * k, r)) for k in range(8)]
    passage = prose(77, 60)
    docs += [(300 + k, prose(500 + k, 60) + " " + passage) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(df) == brute(docs)


def test_chains_link_whole_classes(spark, prose):
    """Each text is close to the next one only; the class is the whole chain."""
    words = prose(8, 400).split(" ")
    docs = [(50 - k, " ".join(words[k * 8 : k * 8 + 200])) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df) == brute(docs)


def test_odd_rows(odd_docs, no_docs):
    for df in odd_docs:
        assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])
        left = nd.without_near_duplicates(df)
        assert left.columns == df.columns and None in {r.doc_id for r in left.collect()}
    assert got(no_docs) == {}


def test_registers_agree_as_often_as_bags_overlap():
    words = Words(spaced(True), 9)
    texts = ["a b c d e f " * 5 + "x", "a b c d e f " * 4 + "x y z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.array([0, len(texts[0]), len(data)])
    s = nd.signatures(*nd.bags(*nd.shingles(words, data, offsets, 1)), 2, 4000)
    a, b = bag(texts[0], 1), bag(texts[1], 1)
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.04
    assert abs(nd.similarity(words, texts[0].encode(), texts[1].encode(), 1) - true) < 1e-12


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "x long, y long")
    assert {(r["id"], r["class"]) for r in nd.classes(df).collect()} == {(x, find(x)) for x in list(root)}


def test_blocks_of_one_hub(spark, prose):
    """A group whose members are unlike its hub but partly like each other, cut into small blocks."""
    r = random.Random(11)
    docs = []
    for family in range(5):
        base = prose(40 + family, 120)
        docs += [(100 * family + k, edited(base, 0.01, r)) for k in range(9)]
    texts = spark.createDataFrame([(i, t.encode()) for i, t in docs], "id long, text binary")
    met = texts.selectExpr("0L AS hub", "id")
    found = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "id long, class long")
    for block in (4, 256):
        more = nd.linked_across(met, found, texts, 5, 0.8, block=block, rows=50).collect()
        want = brute(docs)
        bags = dict((i, bag(t)) for i, t in docs)
        assert all(sum((bags[e.x] & bags[e.y]).values()) >= 0.8 * sum((bags[e.x] | bags[e.y]).values()) for e in more)
        edges = spark.createDataFrame([(e.x, e.y) for e in more] + [(1, 0), (2, 0)], "x long, y long")
        got = {c["id"]: c["class"] for c in nd.classes(edges).collect()}
        assert {i: got.get(i, i) for i, _ in docs} == want
