"""What the operators of this subpackage share: columnar text access and batch sizes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that Spark puts into one Arrow batch, so that a worker holds a few MB at a time.
ARROW_ROWS = 1000
#: Text bytes that an operator handles in one go; a single longer text is handled alone.
SLICE_BYTES = 2 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Plans made from here on hand Python at most ARROW_ROWS rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands Python at most so many rows at once; afterwards the session is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release() -> None:
    """Give freed memory back to the system: workers serve many tasks, and an executor counts what all of them keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # not the C library that has it
        return


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches, which gives memory back when it is done."""

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidy


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and the len + 1 row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first, last = int(starts[0]), int(starts[-1])
    if data is None or last == first:
        return np.zeros(0, np.uint8), starts - first
    return np.frombuffer(data, np.uint8)[first:last], starts - first


def pieces(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about limit bytes of text each."""
    starts = text_column(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(starts, starts[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def words(data: np.ndarray, starts: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or of what the bytes of ``between`` part) and the row of each."""
    solid = ~between[data]
    if not solid.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    before[inner] = False
    after[inner - 1] = False
    begin, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def word_values(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as an Arrow column over the same bytes: every even value is a word, every odd one what lies between two."""
    offsets = np.empty(2 * len(begin), np.int64)
    offsets[::2], offsets[1::2] = begin, end
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(offsets) - 1), [None, pa.py_buffer(offsets if len(offsets) else np.zeros(1, np.int64)), pa.py_buffer(data)])


def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(1 << 16, base)), np.cumprod(np.full(1 << 16, inverse))


_POWER, _INVERSE = _powers()
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of a well-known hash)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by differences of a running polynomial sum."""
    with np.errstate(over="ignore"):
        low = len(_POWER) - 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.multiply(_BYTE[data], np.resize(_POWER, len(data)), out=total[1:])
        np.cumsum(total, out=total)
        within = (total[end] - total[begin]) * _INVERSE[begin & low]
        # powers repeat every 65536 bytes: words that cross that border are hashed apart
        for i in np.flatnonzero((begin & ~low) != ((end - 1) & ~low)):
            own = data[begin[i] : end[i]]
            within[i] = (_BYTE[own] * _POWER[np.arange(len(own)) & low]).sum(dtype=np.uint64) * _INVERSE[0]
    return mix(within ^ (end - begin).astype(np.uint64))


_PLACES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each row, in order, and their rows; a row with 1 to k - 1 words has one, of them all."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(counts) - counts
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(n_rows), per)
    if not len(row):
        return np.zeros(0, np.uint64), row
    begin = spread(first, per)
    width = max(0, len(hashes) - k + 1)
    # sums of all runs of k words, whichever row they are of; of these, each row takes its own
    total = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total[:width] += hashes[i : i + width] * _PLACES[i]
        short = np.flatnonzero((counts > 0) & (counts < k))
        total[first[short]] = counts[short].astype(np.uint64) << np.uint64(32)
        for i in range(k - 1):
            own = short[counts[short] > i]
            total[first[own]] += hashes[first[own] + i] * _PLACES[i]
    return mix(total[begin]), row


def least_of_runs(values: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """The least value of each run that shingles() hashes."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(counts) - counts
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    least = values.copy()
    width = max(0, len(values) - k + 1)
    for i in range(1, k):
        np.minimum(least[:width], values[i : i + width], out=least[:width])
    short = np.flatnonzero((counts > 0) & (counts < k))
    least[first[short]] = values[first[short]]
    for i in range(1, k - 1):
        own = short[counts[short] > i]
        least[first[own]] = np.minimum(least[first[own]], values[first[own] + i])
    return least[spread(first, per)]


def distinct_sets(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the n_rows + 1 starts."""
    # a quick sort by value, then a radix sort by row
    order = np.argsort(values)
    order = order[np.argsort(rows[order].astype(np.uint16) if n_rows <= 1 << 16 else rows[order], kind="stable")]
    values, rows = values[order], rows[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[fresh], rows[fresh]
    return values, np.searchsorted(rows, np.arange(n_rows + 1))
