"""Helpers that every corpus operator uses: shared storage, safe joins, packed text buffers.

Texts reach Python as Arrow batches. ``chunks`` cuts a batch into runs of whole documents of a
bounded number of bytes, so that the NumPy temporaries stay small whatever the batch size; a text
longer than the bound is a chunk of its own and is still processed whole.

Spark uses a Python worker again for later tasks, of other stages too. What allocators keep of freed
memory would add up there, so functions over batches are wrapped in ``lean``.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.storage import release
from lodestone.plans.storage import stored as materialize

#: Bytes of text that are turned into NumPy arrays at a time.
CHUNK_BYTES = 1 << 20
#: Rows of 8-byte keys up to which one side of a join may be broadcast (about 70 bytes each in memory, so 280 MB); beyond, Spark shuffles.
BROADCAST_ROWS = 4_000_000

_HASH_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_HASH_INVERSE = pow(_HASH_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Hand memory that this process has freed, but that its allocators keep, back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run):
    """The function over batches; freed memory goes back to the system before its first batch and after its last."""

    def over(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return over


def join_small(left: DataFrame, right: DataFrame, on: str, how: str, rows: int | None = None) -> DataFrame:
    """Join with a table of keys: broadcast if its counted rows are few, else a shuffled join."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, on, how)


def text_of(column: str = "text") -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string array; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    offs = offs.astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, most: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) for runs of whole texts of about ``most`` bytes."""
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        _powers[:] = []
        for base in (_HASH_BASE, _HASH_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = True
_WORD[128:] = True
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def spans(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes; no run crosses a text's border."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    border = offs[:-1][offs[:-1] < n]
    before[border] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    after[border[border > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def tokens(data: np.ndarray, offs: np.ndarray, solid: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of words (letters and digits), or of runs without white space."""
    starts, ends = spans((_SOLID if solid else _WORD)[data], offs)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    power, inverse = _power_table(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return starts, ends, mix64((total[ends] - total[starts]) * inverse[starts])


def owner(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte position, the row of the text that holds it."""
    return np.searchsorted(offs, at, side="right") - 1


def segments(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of each row's run in a sorted list of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def sorted_groups(batches):
    """Tables of whole groups, from batches sorted by their first column; a group is never cut."""
    rest: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if rest and keys[0] == key and keys[-1] == key:
            rest.append(batch)
            continue
        last = int(np.searchsorted(keys, keys[-1], side="left")) if (keys[:-1] <= keys[1:]).all() else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        if rest or last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks()
        rest, key = [batch.slice(last)], keys[-1]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


__all__ = ["BROADCAST_ROWS", "CHUNK_BYTES", "chunks", "give_back", "join_small", "lean", "materialize", "mix64", "owner", "release", "segments", "sorted_groups", "spans", "text_of", "tokens", "utf8"]
