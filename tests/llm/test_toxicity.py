import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import toxicity as t

BAD = ["zorgle", "plimp", "vexx"] + [f"dreck{e}" for e in ("ung", "heit", "er", "lich", "en", "schaft")]


@pytest.fixture(scope="module")
def corpus(spark, prose):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        words, toxic = prose(i if i % 10 else i % 100, 60).split(" "), int(i % 6 == 0)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs += [(1000 + i, docs[6][1]) for i in range(60)]  # a toxic text that is copied
    labels += [(1000 + i, 1) for i in range(60)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_spans(corpus):
    docs, labels = corpus
    model = t.train(docs, labels.where(~t.held_out()))
    rows = t.scored(docs, model).join(labels, "doc_id").where(t.held_out()).collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    found = [r.text[a:b] for r in rows for a, b in r.toxic_spans]
    assert found and np.mean([all(w.strip(",.") in BAD for w in x.split(" ")) for x in found]) > 0.95


def test_many_candidates_of_copies_leave_room_for_weaker_words(spark, prose):
    """A copied toxic text of 30,000 rare words (some 100,000 candidates) does not displace a word of eight toxic texts."""
    r = random.Random(8)
    rare = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(30000))
    docs = [(i, rare, 1) for i in range(12)] + [(20 + i, prose(i, 30) + " zorgle", 1) for i in range(8)]
    docs += [(100 + i, prose(50 + i, 30), 0) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = t.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    keys = t.parts(t.Words(t.letters_and_digits(), 5), np.frombuffer(b"zorgle", np.uint8), np.array([0, 6]))[0]
    assert np.isin(np.concatenate(keys), model.keys).any()


def test_passes_equal_a_walk_over_all_tokens():
    r = np.random.default_rng(0)
    length = np.array([7, 1, 12, 5, 0])
    marks = [[0, 1, 4], [], [3, 11], [4], []]
    position = np.array([p for m in marks for p in m])
    values = r.random((len(position), 4)) * 3
    of = np.concatenate([[0], np.cumsum([len(m) for m in marks])])
    field = np.array([-2.0, 0.5, 1, 0.2, 0.1, -0.7, 0.3, 0.9])
    marginal, total = t.Chains(position, values, of, length).passes(field)
    step = np.exp(np.array([[0, field[5]], [field[6], field[7]]]))
    for d, n in enumerate(length):
        score = np.full(n, np.exp(field[0]))
        for k, p in enumerate(marks[d]):
            score[p] = np.exp(field[0] + values[of[d] + k] @ field[1:5])
        f, forward = np.array([1.0, 0.0]), []
        for s in score:
            f = f @ step * [1, s]
            forward.append(f)
        assert np.isclose(np.log(f.sum()), total[d])
        b, backward = np.ones(2), []
        for s in score[::-1]:
            backward.append(b)
            b = step @ (b * [1, s])
        for k, p in enumerate(marks[d]):
            both = forward[p] * backward[n - 1 - p]
            assert np.isclose(both[1] / both.sum(), marginal[of[d] + k])


def test_likelihood_is_of_one_labelling():
    chains = t.Chains(np.array([1, 2]), np.ones((2, 4)), np.array([0, 2, 2]), np.array([4, 3]))
    field = np.array([-1.0, 0.1, 0.2, 0.3, 0.4, -0.5, 0.6, 0.7])
    score = field[0] + field[1:5].sum()
    walk = field[5] + score + field[7] + score + field[6]  # clean, toxic, toxic, clean; three clean
    got = chains.likelihood(field, np.array([True, False])) + 1e-6 * field @ field
    assert np.isclose(got * 7, walk - chains.passes(field)[1].sum())


def test_odd_rows(spark, corpus, odd_docs, no_docs):
    docs, labels = corpus
    model = t.train(docs, labels)
    for df in odd_docs:
        got = t.scored(df, model)
        assert len(got.columns) == len({c.lower() for c in got.columns})
        rows = got.collect()
        assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
        assert {r.score for r in rows if not (r.text or "").strip()} == {min(r.score for r in rows)}
    assert t.scored(no_docs, model).collect() == []
    none = t.train(docs, labels.limit(0))
    assert all(r.score <= 1 for r in t.scored(docs.limit(3), none).collect())
    same = t.train(odd_docs[0], spark.createDataFrame([(1, 1), (2, None), (2, 0), (None, 1)], "doc_id long, toxic int"))
    assert t.scored(odd_docs[0], same).where(F.col("score").isNull()).count() == 0
