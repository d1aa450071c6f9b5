"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The filter keeps, of each pair of neighbouring tokens, the logarithm of its
count: pair x of level j is stored as the entries (x, 1) ... (x, j), and a
reader probes level after level until one is missing. It grows with the
corpus, so it is not sent whole to each worker: it is cut by hash into
segments of bounded size. Texts go in chunks; a chunk sends each segment its
distinct pairs once, the segment sums the counts of the training part, builds
its filter and answers with the levels that probes find. Single tokens take the
same way, with exact counts. Chunks and segments follow the input in number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from panelforge.llm.base import (
    Words, ascending, col, flat, from_ascending, from_planes, mixed, pieces, planes, query, slices, spaced, starts_of,
    table, without,
)

CHUNK, SEGMENT, SLICE = 8 << 20, 16 << 20, 1 << 18
END, BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
TOKEN, PAIR = 1, 2


class Filter:
    """A Bloom filter of (key, level) entries; each entry sets ``probes`` bits."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, probes: int = 8):
        self.probes = probes
        # An entry takes probes / ln 2 bits, which leaves about half of the bits unset.
        self.size = np.uint64(max(64, int(levels.sum() * probes / np.log(2)) + 1))
        bits = np.zeros(int(self.size), bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for probe in range(probes):
                bits[self.place(keys[levels >= level], level, probe)] = True
        self.bits = np.packbits(bits)

    def place(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        a = mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
        return ((a + np.uint64(probe) * (mixed(a) | np.uint64(1))) % self.size).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels of each key are there, counted from the first."""
        found, left, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(left):
            level += 1
            for probe in range(self.probes):
                at = self.place(keys[left], level, probe)
                left = left[(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
            found[left] = level
        return found


def tokens(words: Words, data: np.ndarray, offsets: np.ndarray):
    """Hashes of all tokens, an end token after each text's words, and the n + 1 offsets of the texts."""
    hashes, _, _, of = words(data, offsets)
    n = len(of) - 1
    out = np.full(len(hashes) + n, END)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(of))] = hashes
    return out, of + np.arange(n + 1)


def pairs(token: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it in its text."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[of[:-1]] = BEGIN
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + token)


class Chunk:
    """Tokens and pairs of a chunk of texts: the distinct ones in order, counts in training texts, and which is where."""

    def __init__(self, docs: pa.Table, text: str):
        data, offsets = flat(docs.column(text))
        words = Words(spaced(lower=True), 7)
        found = [tokens(words, data[offsets[a] : offsets[b]], offsets[a : b + 1]) for a, b in slices(offsets, SLICE)]
        size = np.concatenate([np.diff(of) for _, of in found])
        self.of = np.concatenate([[0], np.cumsum(size)])
        token = np.concatenate([t for t, _ in found])
        train = np.repeat(np.asarray(docs.column("_train")), size)
        self.kinds = {}
        for kind, keys in ((TOKEN, token), (PAIR, pairs(token, self.of))):
            order = np.argsort(keys)
            keys = keys[order]
            at = starts_of(keys)
            which = np.empty(len(order), np.int64)
            which[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
            self.kinds[kind] = keys[at], np.add.reduceat(train[order].astype(np.int64), at), which


def by_segment(keys: np.ndarray, bits: int):
    segment = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = starts_of(segment)
    for a, b in zip(at, np.append(at[1:], len(keys))):
        yield int(segment[a]), int(a), int(b)


_ASK = {"segment": pa.int32(), "chunk": pa.int32(), "kind": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
_SAID = {"chunk": pa.int32(), "segment": pa.int32(), "kind": pa.int32(), "found": pa.binary()}


def _schema(fields):
    return StructType([StructField(n, BinaryType() if t == pa.binary() else IntegerType()) for n, t in fields.items()])


def _table(rows, fields):
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields))


def _ask(text: str, bits: int):
    def run(docs: pa.Table) -> pa.Table:
        chunk, c = docs.column("_chunk")[0].as_py(), Chunk(docs, text)
        return _table([(s, chunk, kind, ascending(keys[a:b]), planes(counts[a:b].view(np.uint64)))
                       for kind, (keys, counts, _) in c.kinds.items() for s, a, b in by_segment(keys, bits)], _ASK)

    return run


def summed(keys: np.ndarray, counts: np.ndarray):
    """Distinct keys in order, their sums, and for each row its place among them."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    at = starts_of(sorted_)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
    return sorted_[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0], which


def _answer(asks: pa.Table) -> pa.Table:
    """Sum what the chunks count; give exact counts of tokens, and of pairs what the filter of this segment knows."""
    rows = []
    chunks, kinds = asks.column("chunk").to_pylist(), np.asarray(asks.column("kind"))
    segment = asks.column("segment")[0].as_py()
    for kind in (TOKEN, PAIR):
        some = np.flatnonzero(kinds == kind)
        if not len(some):
            continue
        keys = [from_ascending(asks.column("keys")[int(i)].as_py()) for i in some]
        counts = [from_planes(asks.column("counts")[int(i)].as_py()).view(np.int64) for i in some]
        distinct, total, which = summed(np.concatenate(keys), np.concatenate(counts))
        if kind == PAIR:
            seen = total > 0
            level = np.zeros(len(total), np.uint8)
            level[seen] = 1 + np.log2(total[seen]).astype(np.uint8)
            total = Filter(distinct[seen], level[seen]).levels(distinct)
        a = 0
        for i, k in zip(some, keys):
            own = total[which[a : a + len(k)]]
            rows.append((chunks[i], segment, kind, own.tobytes() if kind == PAIR else planes(own.view(np.uint64))))
            a += len(k)
    return _table(rows, _SAID)


def _score(text: str, bits: int, n: int, v: int, trust: float):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        c = Chunk(docs, text)
        known = {TOKEN: np.zeros(len(c.kinds[TOKEN][0]), np.int64), PAIR: np.zeros(len(c.kinds[PAIR][0]), np.uint8)}
        where = {(k, s): (a, b) for k in known for s, a, b in by_segment(c.kinds[k][0], bits)}
        for segment, kind, found in zip(*(said.column(x).to_pylist() for x in ("segment", "kind", "found"))):
            a, b = where[kind, segment]
            known[kind][a:b] = from_planes(found).view(np.int64) if kind == TOKEN else np.frombuffer(found, np.uint8)
        count = known[TOKEN][c.kinds[TOKEN][2]]
        level = known[PAIR][c.kinds[PAIR][2]]
        first = c.of[:-1]
        before = np.empty_like(count)
        before[1:] = count[:-1]
        # As many training texts begin as end.
        end = np.flatnonzero(c.kinds[TOKEN][0] == END)
        before[first] = known[TOKEN][end[0]]
        base = (count + 1) / (n + v + 1)
        pair = np.where(level > 0, 2.0 ** (level.astype(float) - 1), 0.0)
        pair = np.minimum(pair, np.minimum(before, count))
        chance = (pair + trust * base) / (before + trust)
        out = docs.drop_columns(["_chunk", "_train", text])
        for name, column, kind in (
            ("n_tokens", np.diff(c.of), pa.int64()), ("n_known", np.add.reduceat((count > 0).astype(np.int64), first), pa.int64()),
            ("base_score", np.add.reduceat(np.log10(base), first), pa.float64()), ("score", np.add.reduceat(np.log10(chance), first), pa.float64()),
        ):
            out = out.append_column(name, pa.array(column, kind))
        return out

    return run


def _vocabulary(text: str, bits: int):
    """Distinct tokens of the training texts of each batch, by segment."""

    def run(batches):
        words = Words(spaced(lower=True), 7)
        for batch in batches:
            data, offsets = flat(batch.column(text))
            found = [tokens(words, data[offsets[a] : offsets[b]], offsets[a : b + 1])[0] for a, b in slices(offsets, SLICE)]
            if found:
                token = np.concatenate(found)
                keys, counts, _ = summed(token, np.ones(len(token), np.int64))
                yield from _table([(s, 0, TOKEN, ascending(keys[a:b]), planes(counts[a:b].view(np.uint64))) for s, a, b in by_segment(keys, bits)], _ASK).to_batches()

    return run


def _sizes(asks: pa.Table) -> pa.Table:
    keys = np.concatenate([from_ascending(x.as_py()) for x in asks.column("keys")])
    counts = np.concatenate([from_planes(x.as_py()).view(np.int64) for x in asks.column("counts")])
    return pa.table({"n": [int(counts.sum())], "v": [len(np.unique(keys))]})


def scored(docs: DataFrame, train, id_: str = "doc_id", text: str = "text", trust: float = 500.0,
           chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """``docs`` less the text, with log10 probabilities of its tokens; ``train``: which rows the model learns from.

    Tokens are words between white space, A-Z as a-z, then an end token.
    Added: n_tokens, n_known (tokens of the training rows), train_tokens,
    base_score (add-one probabilities of single tokens) and score. A token's
    probability after another is (q + trust * base) / (c + trust): c is the
    exact count of the token before, q the count of both, rounded down to a
    power of 2 by the filter, and ``trust`` the weight of the single token.
    False finds of the filter (one pair in 256) are held to the smaller of the
    two tokens' counts.

    A null or empty text is its end token alone; null ``train`` is false.
    Without training rows every count is 0. Columns of these names go.
    """
    df = without(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score", "_chunk", "_train")
    df = df.withColumn("_train", F.coalesce(train, F.lit(False)))
    size = F.coalesce(F.octet_length(col(text)), F.lit(0)) + F.lit(1)
    total = pieces(df, size, 1)
    n, bits = max(1, -(-total // chunk)), int(-(-total // segment) - 1).bit_length()
    seen = df.where("_train").select(col(text)).mapInArrow(_vocabulary(text, bits), _schema(_ASK))
    sizes = seen.groupBy("segment").applyInArrow(_sizes, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    train_tokens, distinct = int(sizes[0] or 0), int(sizes[1] or 0)
    rest = [f for f in df.schema.fields if f.name not in ("_train", text)]
    place = F.pmod(F.xxhash64(col(id_), col(text)), F.lit(n)).cast("int")
    groups = df.withColumn("_chunk", place).repartition(n, "_chunk").groupBy("_chunk")
    said = groups.applyInArrow(_ask(text, bits), _schema(_ASK)).groupBy("segment").applyInArrow(_answer, _schema(_SAID))
    out = StructType([*rest, StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    got = groups.cogroup(said.repartition(n, "chunk").groupBy("chunk")).applyInArrow(_score(text, bits, train_tokens, distinct, trust), out)
    return got.withColumn("train_tokens", F.lit(train_tokens).cast("long"))


@query("op7_language_model")
def op7_language_model(spark, folder):
    """All documents, learnt from those whose crc32 modulo 7 is not 2."""
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    docs = table(spark, folder, "documents").select("doc_id", "text", (part == 2).alias("held_out"))
    got = scored(docs, ~F.col("held_out"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
