import random
import re

import pytest

from panelforge.llm import licenses as l


def words(text):
    return re.findall(l.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    """The base columns by looking at every place."""
    out = []
    for i, text in rows:
        w, places, labels = words(text), [], set()
        for label, phrase in l.BASE:
            p = phrase.lower().split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(out, key=repr)


def base(df):
    got = l.scanned(df).collect()
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    return sorted([(r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=repr)


def test_base_places_equal_a_walk(spark, prose):
    r = random.Random(4)
    bits = [p for _, p in l.BASE] + ["MIT  LICENSE", "mit\nlicenSe", "mit.license mit license", "CC-BY-NC", "cc by cc by", "the", "é", "İ mit", "GNU General Public", "mİt license", "apache lIcEnSe"]
    rows = [(i, " ".join(r.choice(bits) if r.random() < 0.4 else prose(i * 50 + k, 3) for k in range(r.randrange(0, 30)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert sum(x[2] > 1 for x in want) > 50
    assert base(df) == want


def test_kelvin_is_not_k(spark):
    rows = [(1, "this Kind of licenK mit license"), (2, "K")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert base(df) == brute(rows)
    notice = [("x", "any kind of word")]
    got = l.scanned(df, base=[("mit", "MIT License")], notices=notice + [("k", "this kind of")]).collect()
    assert {r.id: r["labels"] for r in got} == {1: "mit", 2: ""}


def notice(label, least=10):
    return next(text for name, text in l.NOTICES if name == label and len(l.words_of(text)) >= least)


def test_notices_survive_small_changes(spark, prose):
    mit, bsd = notice("mit"), notice("bsd")
    w = mit.split()
    changed = " ".join([*w[:9], "very", *w[9:]])
    torn = " ".join(w[:10]) + " " + prose(3, 60) + " " + " ".join(w[10:])
    rows = [(1, mit.upper()), (2, prose(1, 50) + " " + changed + " " + prose(2, 50)), (3, torn), (4, " ".join(w[:12])), (5, bsd + "\n" + mit), (6, bsd + " " + bsd),
            (7, "GNU General Public License, version 3"), (8, "GNU General Public License, version 4")]
    got = {r.id: r for r in l.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(1, 9)] == ["mit", "mit", "", "", "bsd,mit", "bsd", "gpl,gpl-3.0", "gpl"]
    assert got[1].score == 1 and 0.8 <= got[2].score < 1 and got[3].score == 0 and got[3].spans == []
    assert [(s.label, s["first"], s["last"]) for s in got[2].spans] == [("mit", 50, 50 + len(w))]
    assert [(s["first"], s["last"]) for s in got[6].spans] == [(0, 20), (21, 41)]


def test_odd_rows(spark, odd_docs, no_docs):
    for df in odd_docs:
        renamed = df.withColumnRenamed(df.columns[-1], "N_words")
        assert base(renamed) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert base(no_docs) == []


def test_very_long_text(spark):
    text = "mit license " * 60_000
    (row,) = l.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (120_000, 60_000, 0, 119_998)


def test_short_template_is_refused(spark, no_docs):
    with pytest.raises(ValueError):
        l.scanned(no_docs, notices=[("x", "word")])


def test_plan_is_native(spark, odd_docs):
    plan = l.scanned(odd_docs[0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
