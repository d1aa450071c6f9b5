"""Each stage against brute force on the very rows that the stage before kept, and the run as a whole."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline as pipeline  # noqa: E402
import test_contamination  # noqa: E402
import test_mixing  # noqa: E402
import test_near_duplicates  # noqa: E402
import test_repeats  # noqa: E402

BAD = ["zorgle", "plimp", "vexx", "drubb"]


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    r = random.Random(9)
    path = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, prose(7000 + i, 25)) for i in range(12)]
    passage = prose(8000, 60)
    docs, labels = [], []
    for i in range(400):
        words, toxic = prose(i, 70).split(" "), int(i % 7 == 0)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        text = " ".join(words)
        if i % 11 == 5:
            text += " " + passage
        if i % 13 == 6:
            text += " " + " ".join(items[i % 12][1].split(" ")[3:16])
        docs.append((i, text, "en", f"s{i % 4}" if i % 5 else None, len(text)))
        labels.append((i, 1, toxic))
    for k in range(40):
        i, text, *rest = docs[3 * k]
        docs.append((1000 + k, text if k % 2 else text + " more", *rest))
    docs += [(2000, None, None, "s1", None), (2001, "", "en", "s1", 0), (None, "no id here", "en", "s2", 10), (5, docs[5][1], "en", None, 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == (names if name != "mixing" else [*names, "taken"])
        now = kept[name] = docs.collect()
        key = {(r.doc_id, r.text) for r in now}
        if name == "toxicity":
            assert {r.doc_id for r in before} - {r.doc_id for r in now} == {r.doc_id for r in before if any(b in (r.text or "").split(" ") for b in BAD)}
        if name == "near_duplicates":
            want = test_near_duplicates.brute([(r.doc_id, r.text) for r in before])
            assert sorted(map(str, now)) == sorted(str(r) for r in before if r.doc_id is None or want[r.doc_id] == r.doc_id)
        if name == "repeats":
            want = test_repeats.brute([(r.doc_id, r.text) for r in before])
            assert sorted((str(r.doc_id), (r.text or "").encode()) for r in now) == sorted((str(w[0]), w[4]) for w in want)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in now)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            clean = {w[0] for w in test_contamination.brute([(r.doc_id, r.text) for r in before], items) if not w[2]}
            assert {str(r.doc_id) for r in now} == clean and len(clean) < len(before)
        if name == "mixing":
            sizes = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
            want, taken = test_mixing.brute_targets(sizes), dict.fromkeys(sizes, 0)
            for _, source, words in {(r.doc_id, r.source, r.taken) for r in now}:
                taken[source] += words
            assert all(abs(taken[s] - want[s]) <= 1 for s in want) and key <= {(r.doc_id, r.text) for r in before}
    assert sorted(map(str, pipeline.run(spark, folder).collect())) == sorted(map(str, kept["mixing"]))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
