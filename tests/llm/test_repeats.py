import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from panelforge.llm import repeats


def brute(docs):
    """Rows (id, text) to (id, bytes, removed, spans, kept) by looking up every 50 bytes."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, b in texts:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            if i is not None:
                least[s] = min(least.get(s, i), i)
    out = []
    for i, b in texts:
        mask = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and least[b[k : k + 50]] < i:
                mask[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mask) if not m)
        out.append((i, len(b), sum(mask), sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask)), kept))
    return sorted(out, key=str)


def got(df, **kw):
    rows = repeats.without_repeats(df, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted([(*r[:4], bytes(r[4])) for r in rows], key=str)


@pytest.mark.parametrize("size", [(1 << 10, 1 << 11), (1 << 23, 1 << 24)])
def test_equals_a_search_for_every_string(spark, prose, size):
    r = random.Random(5)
    shared = [prose(100 + i, 30) for i in range(6)] + ["ab" * 80, "é" * 70, "z" * 200]
    docs = []
    for i in range(80):
        parts = [prose(i, r.randrange(0, 25))] + r.sample(shared, r.randrange(0, 4)) + [prose(1000 + i, r.randrange(0, 9))]
        text = "".join(parts)
        docs.append((i, text[r.randrange(0, 8) : len(text) - r.randrange(0, 8)]))
    docs += [(90, docs[3][1]), (91, docs[3][1]), (-4, docs[5][1]), (2**40, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(df, chunk=size[0], bucket=size[1]) == brute(docs)


def test_odd_rows(odd_docs, no_docs):
    df = odd_docs[0]
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got(df) == want
    assert repeats.without_repeats(df).columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "n_bytes", "n_removed", "n_spans"]
    assert got(no_docs) == []


def test_characters_stay_whole(spark):
    df = spark.createDataFrame([(1, "x" * 49 + "é"), (2, "x" * 49 + "è tail")], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in repeats.without_repeats(df, characters=True).collect()}
    assert kept == {1: "x" * 49 + "é", 2: "è tail"}


def test_suffix_order():
    data = np.frombuffer(b"abcdefgh" * 20, np.uint8)
    start = np.arange(0, 100)
    at, runs = repeats.same_strings(data, start, np.zeros(100, np.uint64))
    strings = [data[s : s + 50].tobytes() for s in start[at]]
    assert strings == sorted(strings) and len(runs) == 8


def test_query_hash(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 60), (2, "b" + "a" * 60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = {x.doc_id: x for x in repeats.op1_repeats(spark, str(tmp_path)).collect()}
    assert r[2].n_removed == 60 and r[2].kept_sha256 == hashlib.sha256(b"b").hexdigest() and r[1].n_removed == 0


def in_process(docs, characters=False):
    """The operator's steps on two chunks and one bucket: rows like those of ``brute``, and the peak memory of the last step."""
    tables = [pa.table({"doc_id": pa.array([i for i, _ in c], pa.int64()), "text": pa.array([t for _, t in c], pa.string()),
                        "_chunk": pa.array([k] * len(c), pa.int32())}) for k, c in enumerate((docs[::2], docs[1::2]))]
    ask, send = repeats._ask("text", "doc_id", 0), repeats._send("text", "doc_id", 0)
    apply = repeats._apply("text", "doc_id", 0, characters)
    said = repeats._settle(pa.concat_tables([ask(t) for t in tables]))
    sent = pa.concat_tables([send(t, said.filter(pc.equal(said["chunk"], k))) for k, t in enumerate(tables)])
    said = pa.concat_tables([said, repeats._sort(sent)])
    rows, peak = [], 0
    for k, t in enumerate(tables):
        mine = said.filter(pc.equal(said["chunk"], k))
        tracemalloc.start()
        out = apply(t, mine)
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        rows += [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in out.to_pylist()]
    return sorted(rows, key=str), peak


@pytest.mark.parametrize("strings", [1, 300, 1 << 20])
def test_slices_agree_with_a_search_for_every_string(prose, monkeypatch, strings):
    monkeypatch.setattr(repeats, "SLICE", min(strings, 1 << 17))
    monkeypatch.setattr(repeats, "STRINGS", strings)
    r = random.Random(6)
    shared = [prose(300 + i, 25) for i in range(4)] + ["ab" * 60, "é" * 70]
    docs = [(i, prose(i, r.randrange(0, 9)) + "".join(s[r.randrange(0, 20) :] for s in r.sample(shared, r.randrange(0, 4)))) for i in range(40)]
    docs += [(50, ""), (51, None), (52, docs[7][1]), (53, "x" * 49), (None, docs[9][1]), (-2, docs[12][1] + "x" * 49)]
    assert in_process(docs)[0] == brute(docs)
    whole = [(*w[:4], w[4].encode()) for w in in_process(docs, characters=True)[0]]
    assert [w[0] for w in whole] == [w[0] for w in brute(docs)] and all(n == len(k) + m for _, n, m, _, k in whole)


@pytest.mark.parametrize("characters", [False, True])
def test_memory_of_a_chunk(prose, characters):
    passages = [prose(500 + i, 40) for i in range(30)]
    r = random.Random(8)
    docs = [(i, prose(i, 3000) + "".join(p[r.randrange(0, 30) :] for p in r.sample(passages, 20))) for i in range(160)]
    rows, peak = in_process(docs, characters)
    assert sum(n for _, _, n, _, _ in rows) > 160 * 1000
    assert peak < 8 * sum(n for _, n, *_ in rows)  # all bytes of both chunks; 5.0 now, 13 and 18 before
