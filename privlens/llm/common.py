"""Shared plumbing: the cluster's shared folder, lineage cuts, Arrow text buffers and hashing.

Text work is done on whole Arrow batches with numpy: a batch is one UTF-8 buffer plus offsets, so
tokenising and hashing cost a few array passes and no Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from privlens.sources.shared import discard, materialize, shared_dir

__all__ = ["Words", "configure", "discard", "materialize", "shared_dir", "slices", "spare", "utf8", "with_fields", "xxh64"]

#: Bytes of text handled by one round of numpy work; bounds the memory of a Python worker.
SLICE_BYTES = 4 << 20


def configure(spark: SparkSession) -> None:
    """Session settings the operators rely on: small Arrow batches, and shuffle files that go when a query ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def spare(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def with_fields(df: DataFrame, keep: list[str], ddl: str) -> StructType:
    """The schema of ``df``'s columns ``keep`` and of the fields in ``ddl``."""
    return StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(ddl).fields])


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte buffer and ``len + 1`` offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges ``(a, b)`` of about ``limit`` bytes; one longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some rows, joined by single spaces.

    ``buf`` holds every row's words, each followed by one space; word ``i`` is ``buf[start[i]:end[i]]``
    and row ``r`` has the words ``first[r]:first[r + 1]``.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(buf)
        if lower:
            buf = _LOWER[buf]
        # a row's end ends its last word: rows are set apart by one space each
        rows = len(offsets) - 1
        padded = np.full(n + rows, 0x20, np.uint8)
        padded[np.arange(n) + np.repeat(np.arange(rows), np.diff(offsets))] = buf
        ends = offsets[1:] + np.arange(rows)
        space = _SPACE[padded]
        after = np.empty_like(space)
        after[:1] = True
        after[1:] = space[:-1]
        keep = ~space | ~after
        at = np.cumsum(keep)
        starts = np.flatnonzero(~space & after)
        stops = np.flatnonzero(space & ~after)
        self.buf = padded[keep]
        self.buf[at[stops] - 1] = 0x20
        self.start = at[starts] - 1
        self.end = at[stops] - 1
        self.first = np.concatenate(([0], np.searchsorted(starts, ends, "right")))

    def __len__(self) -> int:
        return len(self.start)


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``buf[start:end]``, vectorised over spans; spans of 32 bytes and more go one by one through xxhash."""
    out = np.empty(len(start), np.uint64)
    length = (end - start).astype(np.int64)
    long = np.flatnonzero(length >= 32)
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        one = xxhash.xxh64_intdigest
        out[long] = [one(view[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist())]
    rest = np.flatnonzero(length < 32)
    if not len(rest):
        return out
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    words = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    p, left = start[rest].astype(np.int64), length[rest].copy()
    h = left.astype(np.uint64) + (np.uint64(seed) + P5)
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        if not len(on):
            break
        k = _rot(lanes[p[on]] * P2, 31) * P1
        h[on] = _rot(h[on] ^ k, 27) * P1 + P4
        p[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    h[on] = _rot(h[on] ^ (words[p[on]].astype(np.uint64) * P1), 23) * P2 + P3
    p[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        h[on] = _rot(h[on] ^ (padded[p[on]].astype(np.uint64) * P5), 11) * P1
        p[on] += 1
        left[on] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    out[rest] = h
    return out
