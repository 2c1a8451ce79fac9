"""Arrow batches as flat numpy arrays: text bytes, segments, hashes of byte spans.

Every helper works on slices of a bounded number of bytes, so that a batch with
very long texts needs no more memory than one with short ones.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

#: Text bytes that are worked on at once, and bytes that are hashed at once.
SLICE_BYTES, HASHED_BYTES = 1 << 19, 1 << 17
#: Longer byte spans are hashed by BLAKE2b: sums of powers modulo 2**64 meet on patterns of some hundred bytes, whatever the base.
LONG_SPAN = 64

#: Tables that workers keep between tasks, by the operator that uses them.
KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """The worker's tables of one operator."""
    return KEPT.setdefault(name, {})


def _enter(name: str) -> None:
    for other, tables in KEPT.items():
        if other != name:
            tables.clear()


def give_back() -> None:
    """Give freed memory back to the machine: a worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def lean(name: str, run):
    """``run`` over a task's batches, without the tables of other operators before it and with freed memory given back after it."""

    def task(batches):
        _enter(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def texts(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of rows + 1, null mask) of a string column; null reads as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    null = np.asarray(values.is_null())
    values = values.fill_null("").cast(pa.large_string())
    _, offsets, data = values.buffers()
    marks = np.frombuffer(offsets, np.int64)[values.offset: values.offset + len(values) + 1]
    size = int(marks[-1]) if len(marks) else 0
    flat = np.frombuffer(data, np.uint8)[:size] if data is not None and size else np.zeros(0, np.uint8)
    return flat, marks, null


def with_fields(schema: StructType, **kinds: str) -> StructType:
    """A new schema with further fields."""
    out = StructType(list(schema.fields))
    for name, kind in kinds.items():
        out = out.add(StructType.fromDDL(f"`{name}` {kind}")[0])
    return out


def free_names(taken, *names: str) -> list[str]:
    """The names, each with underscores until no column has it."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def row_slices(marks: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``limit`` bytes together; a longer row is alone in its run."""
    n, low = len(marks) - 1, 0
    while low < n:
        high = int(np.searchsorted(marks, marks[low] + limit, side="right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high


#: One fixed odd multiplier and one fixed random value for each byte.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64, kept for the next call."""
    held = _POWERS.get(int(base))
    if held is None or len(held) <= n:
        out = np.full(1 << max(10, int(n).bit_length()), base, np.uint64)
        out[0] = 1
        held = _POWERS[int(base)] = np.multiply.accumulate(out)
    return held[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A running sum of ``value(byte) * base**i`` gives every span in two lookups."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n)[:n], out=total[1:])
    spans = (total[ends] - total[starts]) * _powers(_INVERSE, n)[starts]
    return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` successive 64-bit values (none if there are fewer)."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ items[i: i + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    return mix(out + np.uint64(width))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, every other byte as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_spans(data: np.ndarray, marks: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row + 1) of the maximal runs of bytes with ``inside[byte]``.

    ``marks`` are the row offsets in ``data``; a run never crosses a row.
    """
    n = len(data)
    keep = inside[data]
    before = np.zeros(n + 1, bool)
    before[1:] = keep
    edge = np.zeros(n + 1, bool)
    edge[marks] = True
    starts = np.flatnonzero(keep & (~before[:n] | edge[:n]))
    after = np.zeros(n + 1, bool)
    after[:n] = keep
    ends = np.flatnonzero(keep & (~after[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, marks)


def byte_set(pattern_outside: str) -> np.ndarray:
    """Mask over bytes that are not in the given characters (all below 256)."""
    out = np.ones(256, bool)
    out[[ord(c) for c in pattern_outside]] = False
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of successive byte spans; equal bytes give equal hashes wherever they stand.

    Short spans are hashed together by stretches of HASHED_BYTES, so memory does
    not follow the text; the few longer than LONG_SPAN one by one.
    """
    out = np.empty(len(starts), np.uint64)
    long = ends - starts > LONG_SPAN
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]: ends[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(~long)
    first, last = starts[short], ends[short]
    low = 0
    while low < len(short):
        high = max(low + 1, int(np.searchsorted(last, first[low] + HASHED_BYTES, side="right")))
        a, b = int(first[low]), int(last[high - 1])
        out[short[low:high]] = _short_hashes(data[a:b], first[low:high] - a, last[low:high] - a)
        low = high
    return out
