import random
import re

from panelforge.llm import contamination as c


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(name) if name is not None else "null")
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((str(i), len(w), len(hit), sorted(names)))
    return sorted(out)


def got(docs, items, **kw):
    df = c.marked(docs, items, **kw)
    assert len(df.columns) == len(set(df.columns))
    rows = df.collect()
    assert all(r.contaminated == (r.n_hit > 0) and sum(b - a for a, b in r.hit_spans) == r.n_hit for r in rows)
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in rows)


def test_equals_a_search_for_every_window(spark, prose):
    r = random.Random(2)
    items = [(i, prose(i, r.randrange(0, 40))) for i in range(30)] + [(3, prose(5, 20)), (None, prose(70, 12)), (31, None), (32, "Alra, ben"), (33, "!")]
    docs = []
    for i in range(60):
        text = prose(900 + i, 40)
        if i % 3 == 0:
            source = (items[r.randrange(30)][1] or "").split(" ")
            a = r.randrange(0, max(1, len(source)))
            text += " " + " ".join(source[a : a + r.randrange(5, 25)]).upper() + "! " + prose(i, 10)
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sum(w[2] > 0 for w in want) > 10
    assert got(df, bench) == want
    assert got(df, bench, block=300) == want


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, odd_docs[0].first().text)], "item_id long, text string")
    for df in odd_docs:
        df = df.withColumnRenamed(df.columns[-1], "N_HIT")
        assert got(df, bench) == brute([(r.doc_id, r.text) for r in df.collect()], [(1, bench.first().text)])
    assert got(no_docs, bench) == [] and all(x[2] == 0 for x in got(odd_docs[0], bench.limit(0)))
    assert {r.doc_id for r in c.clean(odd_docs[0], bench).collect()} >= {3, 4, 5, 9, 10}
