"""Benchmark decontamination: suffix arrays over shards of the documents, searched for every test window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from panelforge.llm.base import Words, col, flat, pieces, query, ranges, slices, starts_of, table, without

SLICE = 1 << 20
BLOCK = 8 << 20


def letters_and_digits() -> np.ndarray:
    """Words of digits, letters and all bytes from 0x80 on; A-Z count as a-z."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x30:0x3A] = np.arange(0x30, 0x3A)
    kinds[0x61:0x7B] = np.arange(0x61, 0x7B)
    kinds[0x41:0x5B] = np.arange(0x61, 0x7B)
    kinds[0x80:] = np.arange(0x80, 0x100)
    return kinds


class Windows:
    """The distinct windows of a block of test items, packed for comparison with suffixes of documents.

    Words get numbers from 1 on; ``depth`` numbers are packed into as few
    64-bit keys as hold them, so that suffixes compare key by key.
    """

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int):
        self.depth = window
        words = Words(letters_and_digits(), 8)
        data = np.frombuffer(b"".join(x for _, x in items), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in items])]).astype(np.int64)
        hashes, _, _, of = words(data, offsets) if len(items) else (np.zeros(0, np.uint64), None, None, np.zeros(1, int))
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        count = np.diff(of)
        length = np.minimum(count, window)
        many = np.where(count > 0, count - length + 1, 0)
        at, item, length = ranges(of[:-1], many), np.repeat(np.arange(len(items)), many), np.repeat(length, many)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per = 63 // self.bits
        low = self.packed(ids, at, at + length)
        fill = [self.fill(length, k) for k in range(len(low))]
        keys = np.stack([*low, length.astype(np.uint64)]) if len(at) else np.zeros((len(low) + 1, 0), np.uint64)
        order = np.lexsort(keys[::-1])
        first = starts_of(*[k[order] for k in keys])
        group = np.zeros(len(order), int)
        group[first] = 1
        group = np.cumsum(group) - 1
        self.low = [k[order][first] for k in low]
        self.high = [k[order][first] | f[order][first] for k, f in zip(low, fill)]
        self.length = length[order][first]
        self.shortest = int(self.length.min()) if len(first) else window + 1
        names, self.item = np.unique(np.array([n for n, _ in items], dtype=object).astype(str), return_inverse=True) if items else (np.zeros(0, str), np.zeros(0, int))
        self.names = names
        # The items of each distinct window, one window after the other.
        pairs = np.unique(group * max(1, len(names)) + self.item[item[order]]) if len(order) else np.zeros(0, int)
        self.item_of = pairs % max(1, len(names))
        self.item_from = np.searchsorted(pairs // max(1, len(names)), np.arange(len(first) + 1))

    def packed(self, ids: np.ndarray, at: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Keys of the words from ``at`` to ``end``, at most ``depth``; nothing stands as 0."""
        keys = []
        padded = np.append(ids, 0)
        for k in range(0, self.depth, self.per):
            key = np.zeros(len(at), np.uint64)
            for j in range(k, min(k + self.per, self.depth)):
                here = at + j
                word = np.where(here < end, padded[np.minimum(here, len(ids))], 0)
                key = (key << np.uint64(self.bits)) | word.astype(np.uint64)
            keys.append(key)
        return keys

    def fill(self, length: np.ndarray, k: int) -> np.ndarray:
        """In key k, all bits of the places after the window, which a longer suffix may fill with anything."""
        first, last = k * self.per, min((k + 1) * self.per, self.depth)
        free = np.clip(last - np.maximum(length, first), 0, last - first).astype(np.uint64)
        return (np.uint64(1) << (free * np.uint64(self.bits))) - np.uint64(1)


def bound(suffixes: list[np.ndarray], keys: list[np.ndarray], after: bool) -> np.ndarray:
    """For each row of ``keys`` how many sorted suffixes are smaller, or with ``after`` at most as large: binary search."""
    n = len(suffixes[0])
    low, high = np.zeros(len(keys[0]), int), np.full(len(keys[0]), n)
    while n and (low < high).any():
        open_ = low < high
        middle = np.minimum((low + high) // 2, n - 1)
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for s, k in zip(suffixes, keys):
            value = s[middle]
            less |= equal & (value < k)
            equal &= value == k
        less |= equal & after
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def search(words: Words, test: Windows, data: np.ndarray, offsets: np.ndarray):
    """Over one shard: words per text, hit words (a mask over all), and pairs of text and item."""
    hashes, _, _, of = words(data, offsets)
    n = len(hashes)
    hit = np.zeros(n + 1, np.int64)
    none = np.zeros(0, int)
    if not n or not len(test.length):
        return of, np.zeros(n, bool), none, none
    place = np.minimum(np.searchsorted(test.vocabulary, hashes), len(test.vocabulary) - 1)
    known = test.vocabulary[place] == hashes
    ids = np.where(known, place + 1, 0)
    # Where the run of known words ends that each word is in; texts end runs.
    stop = np.where(known, n, np.arange(n))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    stop = np.minimum(stop, of[1:][text])
    at = np.flatnonzero(stop - np.arange(n) >= test.shortest)
    if not len(at):
        return of, np.zeros(n, bool), none, none
    keys = test.packed(ids, at, stop[at])
    order = np.lexsort(keys[::-1])
    suffixes, at = [k[order] for k in keys], at[order]
    low, high = bound(suffixes, test.low, False), bound(suffixes, test.high, True)
    found = np.flatnonzero(high > low)
    many = (high - low)[found]
    place, which = at[ranges(low[found], many)], np.repeat(found, many)
    np.add.at(hit, place, 1)
    np.add.at(hit, place + test.length[which], -1)
    pairs = np.unique(text[place] * len(test.length) + which)
    row, which = pairs // len(test.length), pairs % len(test.length)
    many = np.diff(test.item_from)[which]
    both = np.unique(np.repeat(row, many) * len(test.names) + test.item_of[ranges(test.item_from[:-1][which], many)])
    return of, np.cumsum(hit[:-1]) > 0, both // len(test.names), both % len(test.names)


def _marked(test, text: str, last: bool):
    """A pass over the documents for one block of items; hits of earlier blocks come in as a bit mask."""

    def run(batches):
        block, words = test.value, Words(letters_and_digits(), 8)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column(text))
            before = batch.column("_hits").to_pylist()
            named = batch.column("_items").to_pylist()
            counts, hits, bits, runs = [], [], [], []
            for a, b in slices(offsets, SLICE):
                of, mask, row, item = search(words, block, data[offsets[a] : offsets[b]], offsets[a : b + 1])
                for i in range(b - a):
                    own = mask[of[i] : of[i + 1]]
                    if before[a + i] is not None:
                        own = own | (np.unpackbits(np.frombuffer(before[a + i], np.uint8), count=len(own)) > 0)
                    counts.append(len(own))
                    hits.append(int(own.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))) if hits[-1] else np.zeros(0, int)
                    runs.append(edge.reshape(-1, 2).tolist())
                    bits.append(None if last else np.packbits(own).tobytes())
                for i, k in zip(row, item):
                    named[a + i].append(str(block.names[k]))
            out = batch.select([c for c in batch.schema.names if c not in ("_hits", "_items")])
            for name, column in (
                ("_hits", pa.array(bits, pa.binary())), ("_items", pa.array(named, pa.list_(pa.string()))),
                ("n_words", pa.array(counts, pa.int64())), ("n_hit", pa.array(hits, pa.int64())),
                ("hit_spans", pa.array(runs, pa.list_(pa.list_(pa.int64())))),
            ):
                if name in out.schema.names:
                    out = out.drop_columns([name])
                out = out.append_column(name, column)
            yield out

    return run


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
           item_text: str = "text", window: int = 10, block: int = BLOCK) -> DataFrame:
    """``docs`` with what they share with the test items.

    A window is ``window`` words in a row of an item, or all words of an item
    that has fewer. Added: n_words, n_hit (words inside an occurrence of a
    window), hit_spans (runs of hit words, by number of word), items (names of
    the items with occurring windows, sorted), contaminated.

    A shard of documents becomes a suffix array over the numbers of its words
    as deep as a window; every window is looked up by binary search. The
    items are cut into blocks of about ``block`` bytes of text, each passed
    over once with only its own windows broadcast, whatever the benchmark's size.

    A null or empty text has no words and no hits; an item without words has
    no window; an item without an id is named ``null``; repeated items count
    once; without items nothing is hit. Columns of ``docs`` with these names go.
    """
    spark = docs.sparkSession
    df = without(docs, "_hits", "_items", "n_words", "n_hit", "hit_spans", "items", "contaminated")
    items = benchmark.select(F.coalesce(col(item).cast("string"), F.lit("null")).alias("i"), col(item_text).cast("binary").alias("t")).where("t is not null").distinct()
    n = pieces(items, F.octet_length("t"), block)
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    df = df.withColumns({"_hits": F.lit(None).cast("binary"), "_items": F.array().cast("array<string>")})
    base = [f for f in df.schema.fields if f.name not in ("_hits", "_items")]
    long = LongType()
    added = [
        StructField("_hits", BinaryType()), StructField("_items", ArrayType(StringType())), StructField("n_words", long),
        StructField("n_hit", long), StructField("hit_spans", ArrayType(ArrayType(long))),
    ]
    for b in range(n):
        block_rows = [(r.i, bytes(r.t)) for r in items.where(F.col("b") == b).collect()]
        test = spark.sparkContext.broadcast(Windows(sorted(block_rows), window))
        df = df.mapInArrow(_marked(test, text, b == n - 1), StructType([*base, *added]))
        df = df if b == n - 1 else df.drop("n_words", "n_hit", "hit_spans")
    return df.withColumns({"items": F.array_sort(F.array_distinct("_items")), "contaminated": F.col("n_hit") > 0}).drop("_hits", "_items")


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that hold no window of a test item."""
    return marked(docs, benchmark, **kw).where("not contaminated").select(*[col(c) for c in docs.columns])


@query("op8_decontamination", sql=r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: w[k:k + 9])) AS g FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
m AS (SELECT p.doc_id, p.k, p.n, iw.item_id FROM p JOIN iw ON iw.n = p.n AND iw.g = array_to_string(p.w[p.k:p.k + p.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, coalesce(t.s, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op8_decontamination(spark, folder):
    """All documents against all items, ten words."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    got = marked(docs, table(spark, folder, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
