"""Removal of repeated passages: prefix-free parsing, dictionary and parse combined into suffix order.

**Parsing.** A rolling hash over 16 bytes puts a trigger at the smallest hash
of every stretch of 50 bytes, so that each string of 50 bytes holds one and
equal strings hold it at the same place. Triggers cut a text into phrases; a
phrase, here, is the run of string starts that share a trigger, with the bytes
up to the end of its last string. No phrase is inside another of its trigger.

**Parse.** Each text becomes the sequence of (trigger, phrase) it goes
through. The dictionary has each phrase once, with the smallest document id
that has it; a copy of a passage is settled there without looking at its bytes.

**Suffix order.** Only phrases that share a trigger can share a string of 50
bytes. Where documents reach one trigger by different phrases, the suffixes of
those dictionary phrases are sorted to a depth of 50 bytes (eight bytes a
round, as far as suffixes are still tied), and ties get the smallest id.

Texts go in chunks, and triggers in buckets, of bounded size and a number that
follows the input. A chunk asks each bucket once for each distinct phrase, so a
passage that is in a third of all documents reaches a bucket once per chunk.
What takes several numbers a byte is done by slices of a chunk or a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from panelforge.llm.base import (
    ascending, byte_values, col, flat, from_ascending, from_planes, mixed, pieces, planes, query, ranges, slices,
    starts_of, table, without,
)

WINDOW, GRAM = 50, 16
CHUNK, BUCKET, SLICE, STRINGS = 8 << 20, 16 << 20, 1 << 17, 1 << 20
_BYTES = (byte_values(11) >> np.uint64(32)).astype(np.uint32)
_U8 = np.dtype("<u8")


def _smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each ``width`` values in a row is, the first if tied."""
    low = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(hashes) - width + 1
    low = np.minimum(low[:n], low[width - size : width - size + n])
    return low & np.uint64(0xFFFFFFFF)


def _rolling(data: np.ndarray) -> np.ndarray:
    h, size, factor = _BYTES[data], 1, 0x9E3779B1
    while size < GRAM:
        h = h[:-size] * np.uint32(pow(factor, size, 2**32)) + h[size:]
        size *= 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


class Parse:
    """The phrases of a chunk of texts: where their strings start, their trigger and phrase hashes, and the text's id."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, use: np.ndarray):
        parts = [self.slice(data, offsets, a, b) for a, b in slices(offsets, SLICE)]
        first, last, trigger, phrase = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(
            zip(*parts) if parts else [[]] * 4, (np.int64, np.int64, np.uint64, np.uint64)))
        text = np.searchsorted(offsets, first, side="right") - 1
        if not use.all():
            mine = use[text]
            first, last, trigger, phrase, text = (x[mine] for x in (first, last, trigger, phrase, text))
        self.first, self.last, self.id = first, last, ids[text]
        # The distinct phrases by trigger, each with its smallest id; ``of`` says which one a phrase is.
        order = _sorted(trigger, phrase, self.id)
        trigger, phrase = trigger[order], phrase[order]
        at = starts_of(trigger, phrase)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        self.trigger, self.phrase, self.least = trigger[at], phrase[at], self.id[order[at]]
        self.example = order[at]

    @staticmethod
    def slice(data, offsets, a, b):
        lo, hi = offsets[a], offsets[b]
        none = np.zeros(0, np.int64)
        if hi - lo < WINDOW:
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        part = data[lo:hi]
        n = len(part) - WINDOW + 1
        where = _smallest(_rolling(part), WINDOW - GRAM + 1)
        ends = offsets[a + 1 : b + 1] - lo
        bad = np.zeros(len(part) + 1, np.int8)  # starts of strings that would leave their text
        np.add.at(bad, np.maximum(ends - WINDOW + 1, offsets[a:b] - lo), 1)
        np.add.at(bad, ends, -1)
        good = np.cumsum(bad[:n], dtype=np.int8) == 0
        new = np.ones(n + 1, bool)
        new[1:n] = (where[1:] != where[:-1]) | (good[1:] != good[:-1])
        first = np.flatnonzero(new[:n] & good)
        last = np.flatnonzero(new[1:] & good)
        eight = np.ndarray((len(part) - 7,), _U8, np.ascontiguousarray(part), 0, (1,))
        at = where[first].astype(np.int64)
        trigger = mixed(mixed(eight[at]) + eight[at + 8] * np.uint64(0x9E3779B97F4A7C15))

        def string(start):
            h = np.zeros(len(start), np.uint64)
            for j in (0, 8, 16, 24, 32, 40, 42):
                h = mixed(h + eight[start + j] + np.uint64(0x2545F4914F6CDD1D))
            return h

        phrase = mixed(string(first) * np.uint64(3) + string(last) + (last - first).astype(np.uint64))
        return first + lo, last + lo, trigger, phrase

    def by_bucket(self, bits: int):
        """Bucket and range of the distinct phrases whose triggers start with its bits."""
        if not len(self.trigger):
            return
        bucket = (self.trigger >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.trigger), np.int64)
        at = starts_of(bucket)
        for a, b in zip(at, np.append(at[1:], len(bucket))):
            yield int(bucket[a]), int(a), int(b)


def _sorted(trigger, phrase, id_):
    """Order by trigger, phrase and id; few triggers are tied, and only those are looked at twice."""
    order = np.argsort(trigger)
    t = trigger[order]
    same = t[1:] == t[:-1]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    some = order[tied]
    order[tied] = some[np.lexsort((id_[some], phrase[some], trigger[some]))]
    return order


def _parse(docs: pa.Table, text: str, id_: str):
    data, offsets = flat(docs.column(text))
    column = docs.column(id_).combine_chunks()
    use = np.asarray(column.is_valid())
    ids = np.asarray(column.cast(pa.int64()).fill_null(0), dtype=np.int64)
    return data, offsets, Parse(data, offsets, ids, use)


def _table(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields))


_ASK = {"bucket": pa.int32(), "chunk": pa.int32(), "trigger": pa.binary(), "phrase": pa.binary(), "id": pa.binary()}
_SAID = {"chunk": pa.int32(), "bucket": pa.int32(), "kind": pa.int32(), "code": pa.binary(), "id": pa.binary()}
_SEND = {"bucket": pa.int32(), "chunk": pa.int32(), "trigger": pa.binary(), "id": pa.binary(), "length": pa.binary(), "bytes": pa.binary()}


def _schema(fields: dict[str, pa.DataType]) -> StructType:
    return StructType([StructField(n, BinaryType() if t == pa.binary() else IntegerType()) for n, t in fields.items()])


def _ask(text: str, id_: str, bits: int):
    """A chunk's distinct phrases, a row for each bucket."""

    def run(docs: pa.Table) -> pa.Table:
        chunk, (_, _, p) = docs.column("_chunk")[0].as_py(), _parse(docs, text, id_)
        rows = [(k, chunk, ascending(p.trigger[a:b]), planes(p.phrase[a:b]), planes(p.least[a:b].view(np.uint64))) for k, a, b in p.by_bucket(bits)]
        return _table(rows, _ASK)

    return run


EARLIER, SHARED = 1, 2


def _settle(asks: pa.Table) -> pa.Table:
    """For each asked phrase: has a smaller id the same phrase, or the same trigger another phrase.

    Chunks of whose phrases neither holds get no row.
    """
    chunks = asks.column("chunk").to_pylist()
    bucket = asks.column("bucket")[0].as_py()
    parts = [(from_ascending(t.as_py()), from_planes(p.as_py()), from_planes(i.as_py()).view(np.int64)) for t, p, i in zip(
        asks.column("trigger"), asks.column("phrase"), asks.column("id"))]
    trigger, phrase, id_ = (np.concatenate(x) for x in zip(*parts))
    order = _sorted(trigger, phrase, id_)
    t, i = trigger[order], id_[order]
    at = starts_of(t, phrase[order])
    least = i[at]
    many = np.diff(np.append(at, len(order)))
    by_trigger = starts_of(t[at])
    reach = np.diff(np.append(by_trigger, len(at)))
    differ = np.repeat(np.minimum.reduceat(least, by_trigger) < np.maximum.reduceat(least, by_trigger), reach)
    least, differ = np.repeat(least, many), np.repeat(differ, many)
    code = np.empty(len(order), np.uint8)
    first = np.empty(len(order), np.int64)
    code[order] = np.where(least < i, EARLIER, np.where(differ, SHARED, 0))
    first[order] = least
    rows, a = [], 0
    for chunk, (own, _, _) in zip(chunks, parts):
        c = code[a : a + len(own)]
        if c.any():
            rows.append((chunk, bucket, 1, c.tobytes(), planes(first[a : a + len(own)][c == EARLIER].view(np.uint64))))
        a += len(own)
    return _table(rows, _SAID)


def _codes(p: Parse, said: pa.Table, bits: int):
    """Code and smallest id of each distinct phrase of a chunk, from the rows of kind 1; the rows of kind 2 by bucket."""
    code, least, late = np.zeros(len(p.trigger), np.uint8), p.least.copy(), {}
    where = {k: (a, b) for k, a, b in p.by_bucket(bits)}
    for bucket, kind, c, i in zip(*(said.column(n).to_pylist() for n in ("bucket", "kind", "code", "id"))):
        if kind == 2:
            late[bucket] = c
            continue
        a, b = where[bucket]
        code[a:b] = np.frombuffer(c, np.uint8)
        least[a:b][code[a:b] == EARLIER] = from_planes(i).view(np.int64)
    return code, least, late, where


def _send(text: str, id_: str, bits: int):
    """The bytes of the phrases whose trigger other documents reach by other phrases."""

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        if not docs.num_rows or not said.num_rows:
            return _table([], _SEND)
        chunk, (data, _, p) = docs.column("_chunk")[0].as_py(), _parse(docs, text, id_)
        code, _, _, where = _codes(p, said, bits)
        rows = []
        for bucket, (a, b) in where.items():
            mine = a + np.flatnonzero(code[a:b] == SHARED)
            if len(mine):
                start = p.first[p.example[mine]]
                length = p.last[p.example[mine]] - start + WINDOW
                rows.append((bucket, chunk, ascending(p.trigger[mine]), planes(p.least[mine].view(np.uint64)),
                             planes(length.view(np.uint64)), data[ranges(start, length)].tobytes()))
        return _table(rows, _SEND)

    return run


def same_strings(data: np.ndarray, start: np.ndarray, group: np.ndarray, width: int = WINDOW):
    """Suffix order of the strings at ``start`` inside their groups, to a depth of ``width``.

    Returns the strings that equal another of their group, in order, and where
    each run of equal ones starts. Every round sorts by eight more bytes what
    is still tied, most significant byte first, so runs stand in the order of
    their bytes.
    """
    eight = np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), 0, (1,))
    at, rank = np.arange(len(start)), group
    for j in [None, *range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        keys = (rank,) if j is None else (eight[start[at] + j].astype(np.uint64), rank)
        order = np.lexsort(keys)
        at, keys = at[order], [k[order] for k in keys]
        first = starts_of(*keys)
        size = np.diff(np.append(first, len(at)))
        tied = np.repeat(size > 1, size)
        rank = np.repeat(np.arange(len(first)), size)[tied]
        at = at[tied]
    return at, starts_of(rank)


def _sort(sent: pa.Table) -> pa.Table:
    """For each string of a sent phrase: does a document with a smaller id have it."""
    chunks, bucket = sent.column("chunk").to_pylist(), sent.column("bucket")[0].as_py()
    parts = [(from_ascending(t.as_py()), from_planes(i.as_py()).view(np.int64), from_planes(n.as_py()).view(np.int64), np.frombuffer(x.as_py(), np.uint8))
             for t, i, n, x in zip(*(sent.column(c) for c in ("trigger", "id", "length", "bytes")))]
    trigger, id_, length, data = (np.concatenate(x) for x in zip(*parts))
    begin = np.cumsum(length) - length
    many = length - WINDOW + 1
    place = np.cumsum(many) - many
    earlier = np.zeros(int(many.sum()), bool)
    order = np.argsort(trigger)
    groups = np.append(starts_of(trigger[order]), len(order))
    for a, b in slices(np.append(0, np.cumsum(many[order]))[groups], STRINGS):
        some = order[groups[a] : groups[b]]
        of = np.repeat(some, many[some])
        equal, runs = same_strings(data, ranges(begin[some], many[some]), trigger[of])
        if len(equal):
            own = id_[of][equal]
            least = np.repeat(np.minimum.reduceat(own, runs), np.diff(np.append(runs, len(equal))))
            earlier[ranges(place[some], many[some])[equal]] = least < own
    rows, a = [], 0
    for chunk, (_, _, n, _) in zip(chunks, parts):
        b = a + int((n - WINDOW + 1).sum())
        if earlier[a:b].any():
            rows.append((chunk, bucket, 2, np.packbits(earlier[a:b]).tobytes(), b""))
        a = b
    return _table(rows, _SAID)


def _removed(p: Parse, said: pa.Table, bits: int, size: int) -> np.ndarray:
    """A mask over the bytes of a chunk."""
    code, least, late, where = _codes(p, said, bits)
    copy = p.id > least[p.of]
    edge = np.zeros(size + 1, np.int8)
    edge[p.first[copy]] += 1
    edge[p.last[copy] + 1] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).view(bool)  # where the strings to remove start
    if late:
        # The strings of each sent phrase, as bits from ``place`` on.
        length = (p.last - p.first + 1)[p.example]
        place, flags, used = np.full(len(p.trigger), -1, np.int64), [], 0
        for bucket, c in late.items():
            a, b = where[bucket]
            mine = a + np.flatnonzero(code[a:b] == SHARED)
            n = int(length[mine].sum())
            place[mine] = used + np.cumsum(length[mine]) - length[mine]
            flags.append(np.unpackbits(np.frombuffer(c, np.uint8), count=n))
            used += n
        flags = np.concatenate(flags).view(bool)
        mine = np.flatnonzero((place[p.of] >= 0) & ~copy)
        many = length[p.of[mine]]
        for a, b in slices(np.append(0, np.cumsum(many)), SLICE):
            some, n = mine[a:b], many[a:b]
            mask[ranges(p.first[some], n)[flags[ranges(place[p.of[some]], n)]]] = True
    wide = 1
    while wide < WINDOW:  # from starts to all bytes of the strings, none of which leaves its text
        more = min(wide, WINDOW - wide)
        mask[more:] |= mask[:-more]
        wide += more
    return mask


def whole_characters(data: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask without the bytes of characters that it covers in part."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts):
        return mask
    size = np.diff(np.append(starts, len(data)))
    return np.repeat(np.add.reduceat(mask.astype(np.int64), starts) == size, size)


def _covered(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask covers."""
    return np.diff(np.append(0, np.cumsum(mask))[offsets])


def _apply(text: str, id_: str, bits: int, characters: bool):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        data, offsets, p = _parse(docs, text, id_)
        mask = _removed(p, said, bits, len(data))
        del p
        removed, spans = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
        for a, b in slices(offsets, SLICE):
            at = offsets[a : b + 1] - offsets[a]
            part = mask[offsets[a] : offsets[b]]
            if characters:
                part[:] = whole_characters(data[offsets[a] : offsets[b]], part)
            removed[a:b] = _covered(part, at)
            begin = part.copy()
            begin[1:] &= ~part[:-1]
            inner = at[:-1][at[:-1] < len(part)]
            begin[inner] = part[inner]
            spans[a:b] = _covered(begin, at)
        keep = data[~mask]
        ends = (offsets - np.append(0, np.cumsum(removed))).astype(np.int32)
        kept = pa.Array.from_buffers(pa.string() if characters else pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(keep.tobytes())])
        out = docs.drop_columns(["_chunk"])
        for name, column in (("kept", kept), ("n_bytes", np.diff(offsets)), ("n_removed", removed), ("n_spans", spans)):
            out = out.append_column(name, column if name == "kept" else pa.array(column, pa.int64()))
        return out

    return run


def without_repeats(docs: DataFrame, id_: str = "doc_id", text: str = "text", characters: bool = False,
                    chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with ``kept``, the text less every byte in a string of 50 bytes that also starts in a row of smaller id.

    Also n_bytes, n_removed and n_spans (maximal removed runs). ``kept`` is
    binary; with ``characters`` it is a string, and a character goes only if
    all its bytes do. Strings are judged on the input.

    A null text is empty; texts under 50 bytes stay whole. Rows with one id
    remove nothing from each other. A row without an id loses nothing and
    removes nothing. Columns of ``docs`` with these names go; no rows give none.
    """
    df = without(docs, "kept", "n_bytes", "n_removed", "n_spans", "_chunk")
    size = F.octet_length(col(text))
    total = pieces(df, size, 1)
    n, bits = max(1, -(-total // chunk)), max(0, int(-(-total // bucket) - 1).bit_length())
    schema = df.schema
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(col(id_), col(text)), F.lit(n)).cast("int")).repartition(n, "_chunk")
    groups = df.groupBy("_chunk")
    said = groups.applyInArrow(_ask(text, id_, bits), _schema(_ASK)).groupBy("bucket").applyInArrow(_settle, _schema(_SAID))
    by_chunk = said.repartition(n, "chunk").groupBy("chunk")
    sent = groups.cogroup(by_chunk).applyInArrow(_send(text, id_, bits), _schema(_SEND))
    late = sent.groupBy("bucket").applyInArrow(_sort, _schema(_SAID))
    answers = said.union(late).repartition(n, "chunk").groupBy("chunk")
    long = LongType()
    out = StructType([*schema.fields, StructField("kept", StringType() if characters else BinaryType()), StructField("n_bytes", long),
                      StructField("n_removed", long), StructField("n_spans", long)])
    return groups.cogroup(answers).applyInArrow(_apply(text, id_, bits, characters), out)


@query("op1_repeats")
def op1_repeats(spark, folder):
    """All documents, 50 bytes."""
    got = without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
