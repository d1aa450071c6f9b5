"""What the operators of this folder share: the registry, tables, and helpers for texts in Arrow columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str):
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add; upper and lower case are the same to Spark."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def pieces(df: DataFrame, size, target: int) -> int:
    """Into how many pieces of about ``target`` bytes the rows go; ``size`` is a column of bytes.

    The number follows the input, so that a piece fits a task at any size.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    return int(max(1, -(-int(total) // target)))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts or bytes one after the other, and the n + 1 offsets of the rows; null is empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    data, ends, start = [], [np.zeros(1, np.int64)], 0
    for part in parts:
        if not len(part):
            continue
        if part.null_count:
            part = part.fill_null("" if pa.types.is_string(part.type) or pa.types.is_large_string(part.type) else b"")
        kind = np.int64 if pa.types.is_large_binary(part.type) or pa.types.is_large_string(part.type) else np.int32
        offsets = np.frombuffer(part.buffers()[1], kind)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        raw = part.buffers()[2]
        if raw is not None:
            data.append(np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]])
        ends.append(offsets[1:] - offsets[0] + start)
        start = int(ends[-1][-1])
    return (np.concatenate(data) if data else np.zeros(0, np.uint8)), np.concatenate(ends)


def slices(offsets: np.ndarray, most: int):
    """Ranges of whole rows of about ``most`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """An odd random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def planes(values: np.ndarray) -> bytes:
    """64-bit values as eight planes of bytes: planes of equal bytes shrink when Spark compresses the row."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def ascending(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as planes of their differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def from_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, in arrays sorted together."""
    n = len(keys[0])
    first = np.zeros(n, bool)
    if n:
        first[0] = True
        for k in keys:
            first[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(first)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Words:
    """Words of a run of texts, found and hashed without leaving numpy.

    ``kinds`` maps a byte to 0 where it separates words and else to the byte
    it counts as. A word's hash is a polynomial over random values of its
    bytes, taken as a difference of running sums.
    """

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, kinds: np.ndarray, seed: int, room: int = 1 << 16):
        self.kinds = kinds
        self.values = byte_values(seed)
        self.grow(room)

    def grow(self, room: int) -> None:
        up = np.full(room, self.FACTOR, np.uint64)
        up[0] = 1
        self.up = np.cumprod(up)
        down = np.full(room, pow(self.FACTOR, -1, 2**64), np.uint64)
        down[0] = 1
        self.down = np.cumprod(down)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """Hashes, starts and ends of the words, and the n + 1 offsets of the texts among them."""
        offsets = offsets - offsets[0]
        n = len(data)
        if n + 1 > len(self.up):
            self.grow(2 * n + 2)
        kinds = self.kinds[data]
        inside = kinds != 0
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        marks = offsets[1:-1]
        before[marks[marks < n]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[marks[(marks > 0)] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[kinds] * self.up[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        return hashes, starts, ends, np.searchsorted(starts, offsets)


def spaced(lower: bool) -> np.ndarray:
    """Words of anything but white space; A-Z count as a-z if ``lower``."""
    kinds = np.arange(256, dtype=np.uint8)
    if lower:
        kinds[65:91] += 32
    kinds[[0x20, *range(0x09, 0x0E)]] = 0
    return kinds
