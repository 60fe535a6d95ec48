"""Best-fit packing with Martello-Toth dominance reduction, over counts of lengths.

Items of one length are interchangeable, so the instance is a table of at most ``capacity``
(length, count) pairs, whatever the number of documents. The driver packs that table into
patterns with multiplicities; executors then number the pieces of each length and look up
their places. No document data reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import pieces, small_batches
from millrace.session import settle

CAPACITY = 1024
END_ID = 2
#: The numbering of one length's pieces is dealt to so many tasks.
BUCKETS = 1024

_ENCODERS: dict[str, object] = {}


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """text -> ids as numpy, as the tokenizer file's own library gives them without added special tokens.

    The library tiktoken applies the same ranks several times faster; it stands in where the
    .tiktoken file of the vocabulary lies beside the .json one. A test holds both to the same ids.
    """
    if path not in _ENCODERS:
        import base64
        import os

        import public_tokenizers

        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if path.endswith("byte_bpe_50k.json") and os.path.exists(ranks_path):
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
            _ENCODERS[path] = lambda text: own.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    return _ENCODERS[path]


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document's ids and end id.

    Only a longer document is cut: its first piece holds what capacity does not divide, so
    every other piece is full. Null and empty texts are the end id alone. No shuffle.
    """
    small_batches(df.sparkSession)
    path = path or public_path()
    own = df.select(df[key].alias("_key"), df[text].cast("string").alias("_text"))
    tail = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in pieces(batch, "_text"):
                row, number, start, length, crc = [], [], [], [], []
                for r, value in enumerate(part.column("_text").to_pylist()):
                    ids = np.concatenate([encode(value), tail]) if value else tail
                    raw, n = memoryview(ids.astype("<u4").tobytes()), len(ids)
                    at, p = 0, 0
                    while at < n:
                        to = at + (min(n, capacity) if n <= capacity else (n % capacity or capacity) if at == 0 else capacity)
                        row.append(r)
                        number.append(p)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(raw[4 * at : 4 * to]))
                        at, p = to, p + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["_key", "piece", "start", "length", "ids_crc32"],
                )

    kind = own.schema["_key"].dataType.simpleString()
    return own.mapInArrow(run, f"_key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_key", key)


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with multiplicities that use up the counts; each pattern's sum is at most capacity.

    ``reduce`` fixes what it can prove; the rest goes to the fullest bin that takes it, longest
    first, whole classes at a time.
    """
    fixed, left = reduce(counts, capacity)
    return fixed + best_fit(left, capacity)


def reduce(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(patterns fixed for good with their multiplicities, counts that remain): dominance after Martello and Toth.

    For each length j a bin with j and a, or with j, a and b, is fixed where it dominates every
    feasible bin that holds j: a is the largest companion, b the largest that fits beside both.
    {j, a} dominates where a fills the bin or no feasible pair of companions outweighs it;
    {j, a, b} dominates where in each feasible pair the smaller is at most b or both together
    are at most a. Bins that take three companions or more are not decided. Passes over all
    lengths are repeated until one fixes nothing.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("a length is below 1 or above the capacity")
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left and (pattern := _dominant(j, left, capacity)):
                times = min(left[s] // pattern.count(s) for s in pattern)
                fixed.append((pattern, times))
                for s in pattern:
                    left[s] -= times
                for s in set(pattern):
                    if not left[s]:
                        del left[s]
                changed = True
    return fixed, left


def _dominant(j: int, left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """The bin with j that dominates all others with j, or None where none of up to two companions does."""
    room = capacity - j
    others = np.sort(np.array([s for s, n in left.items() if s <= room for _ in range(min(n - (s == j), 3))], np.int64))
    if not len(others):
        return (j,)
    a = int(others[-1])
    if a == room:
        return j, a
    if others[:3].sum() <= room and len(others) > 2:
        return None
    if _best_pair(others, room) <= a:
        return j, a
    rest = others[:-1]
    beside = rest[rest <= room - a]
    if not len(beside):
        return None
    b = int(beside[-1])
    return (j, a, b) if _best_pair(others[others > b], room) <= a else None


def _best_pair(sizes: np.ndarray, room: int) -> int:
    """The largest sum of two of the sorted sizes that is at most room; 0 where no two fit."""
    at = np.arange(len(sizes))
    partner = np.minimum(np.searchsorted(sizes, room - sizes, "right"), at) - 1
    fits = partner >= 0
    return int((sizes[fits] + sizes[partner[fits]]).max()) if fits.any() else 0


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in descending order, class by class: all bins with one residual and pattern move together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    residuals = np.zeros(capacity + 1, bool)

    def add(room: int, pattern: tuple[int, ...], times: int) -> None:
        bins.setdefault(room, []).append((pattern, times))
        residuals[room] = True

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            open_ = np.flatnonzero(residuals[s:])
            if len(open_):
                room = s + int(open_[0])
                pattern, times = bins[room].pop()
                if not bins[room]:
                    residuals[room] = False
                used = min(n, times)
                if used < times:
                    add(room, pattern, times - used)
                add(room - s, (*pattern, s), used)
                n -= used
            else:
                per = capacity // s
                whole, rest = divmod(n, per)
                if whole:
                    add(capacity - per * s, (s,) * per, whole)
                if rest:
                    add(capacity - rest * s, (s,) * rest, 1)
                n = 0
    return [b for group in bins.values() for b in group]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length: the first rank of each run, its first sequence, and the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for s in pattern:
            runs.setdefault(s, []).append((ranks.get(s, 0), sequence, offset))
            ranks[s] = ranks.get(s, 0) + times
            offset += s
        sequence += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (key, piece, start, length, ids_crc32, sequence_id, offset).

    The driver gets at most capacity pairs of length and count; what it sends back is bounded
    by the number of patterns, which depends on the lengths and not on the documents. A length
    that a third of all pieces have is numbered in BUCKETS tasks. Equal rows are numbered
    apart. An empty table gives no rows.
    """
    cut = settle(
        token_pieces(df, key, text, path, capacity, end_id).withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(BUCKETS))), "pieces"
    )
    sizes = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = places(solve(counts, capacity))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    order = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(order).cast("long") - 1).join(before, ["length", "_bucket"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for s, a, b in zip(values.tolist(), first, [*first[1:], len(order)], strict=True):
                at = order[a:b]
                ranks, sequences, offsets = table[s]
                run_ = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at] = sequences[run_] + rank[at] - ranks[run_]
                offset[at] = offsets[run_]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = ranked.schema[key].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
