"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts anywhere else.

Exact, and in parts that fit a task. (1) Winnowing: each window of LENGTH bytes has one
anchor, the GRAM-byte string in it with the least hash, so equal windows have equal anchors
at equal distances. The windows of one anchor occurrence form a context. (2) Aligned ranges
of a context's windows share a core; ranges whose core occurs once hold no repeat, so only
contexts with a repeated core go on, each different one once, with its number of occurrences.
(3) The contexts of an anchor meet in a block. A suffix array gives the block's
Burrows-Wheeler transform; intervals are extended backwards breadth first, which yields the
common prefixes of neighbouring suffixes by increasing value, and stops at LENGTH. Suffixes
that are then still unparted agree in LENGTH bytes. (4) Repeated windows go back to all
occurrences of their context and are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import _BYTE, mix, pieces, small_batches, spread, text_column
from millrace.session import scratched, settle

LENGTH, GRAM, RANGE = 400, 32, 64
#: Bytes of contexts in a block, in the mean, and contexts of an anchor from which its windows are dealt one by one.
BLOCK_BYTES, HOT = 512 << 10, 2048
ENTRIES = 2_000_000
#: A longer text is scanned in parts of so many windows.
PART = 8 << 20

_BASE = 0x9E3779B97F4A7C15
_STEP = 4096


def _table(base: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(_STEP - 1, np.uint64(pow(base, e, 1 << 64))))]) for e in (1, _STEP))


_UP, _DOWN = _table(_BASE), _table(pow(_BASE, -1, 1 << 64))


def _power(table: tuple[np.ndarray, np.ndarray], i: np.ndarray) -> np.ndarray:
    return table[1][i // _STEP] * table[0][i % _STEP]


def contexts(data: np.ndarray, starts: np.ndarray, length: int, gram: int, reach: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor's hash, anchor's place, core hashes, the context of each core) within the texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64), none
    at = np.arange(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_UP, at[:-1]))])
    hashes = mix((total[gram:] - total[:-gram]) * _power(_DOWN, at[: n - gram + 1]))
    mask = np.uint64((1 << 24) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    width, done = length - gram + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    last = np.repeat(starts[1:] - length, np.diff(starts))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) <= last)
    if not len(window):
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64), none
    anchor = (least[window] & mask).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
    first, count, anchor = window[begin], np.diff(np.append(begin, len(window))), anchor[begin]
    low, high = (anchor - first - count + 1) // reach, (anchor - first) // reach
    ranges = high - low + 1
    owner, number = np.repeat(np.arange(len(first)), ranges), spread(low, ranges)
    a = anchor[owner] - number * reach
    core = mix((total[a - reach + 1 + length] - total[a]) * _power(_DOWN, a) ^ mix(number.astype(np.uint64)))
    return first, count, hashes[anchor], anchor, core, owner


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) of codes in which every suffix differs from all others; ranks of k symbols give those of 3 k."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    k, order = 1, None
    while order is None or rank[order[-1]] < n - 1:
        size = int(rank.max()) + 2
        key, parts = rank + 1, 1
        while parts < 4 and size ** (parts + 1) < 1 << 63:
            nxt = np.zeros(n, np.int64)
            nxt[: max(0, n - parts * k)] = rank[parts * k :] + 1
            key = key * size + nxt
            parts += 1
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        k *= parts
    return order, rank


def classes(codes: np.ndarray, length: int, separators: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class of each of its entries): entries of one class agree in their first length symbols.

    Codes below ``separators`` occur once each. An interval of the transform that is found at
    depth d ends at a border whose common prefix is d - 1; its extensions by the symbols before
    it end at borders with common prefix d, unless those were found before. Only the last place
    of a symbol in an interval tells the extension's end, and only the first its beginning.
    """
    n = len(codes)
    order, rank = suffix_array(codes)
    before = codes[order - 1]
    back = rank[order - 1]  # the transform's last-to-first mapping
    forth = np.empty(n, np.int64)
    forth[back] = np.arange(n)
    # the next and the previous place with the same symbol before it
    same = codes[order][1:] == codes[order][:-1]
    following, preceding = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[forth[:-1][same]] = forth[1:][same]
    preceding[forth[1:][same]] = forth[:-1][same]
    known = np.zeros(n + 1, bool)
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    known[starts] = True
    known[n] = True
    low, high = starts, np.append(starts[1:], n) - 1
    text = before >= separators
    for _ in range(1, length):
        if not len(low):
            break
        sizes = high - low + 1
        at = spread(low, sizes)
        at_low, at_high = np.repeat(low, sizes), np.repeat(high, sizes)
        ok = text[at]
        begins = np.sort(back[at[ok & (preceding[at] < at_low)]])
        ends = np.sort(back[at[ok & (following[at] > at_high)]])
        fresh = ~known[ends + 1]
        low, high = begins[fresh], ends[fresh]
        known[high + 1] = True
    return order, np.cumsum(known[:n]) - 1


def repeated_runs(items: list[bytes], groups: np.ndarray, lefts: np.ndarray, counts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Of each item the byte runs covered by windows that occur at least twice in its group, at one distance from the anchor."""
    sizes = np.array([len(x) for x in items], np.int64)
    s = len(items)
    codes = np.empty(int(sizes.sum()) + s, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    own = np.ones(len(codes), bool)
    own[ends] = False
    codes[own] = np.frombuffer(b"".join(items), np.uint8).astype(np.int64) + s
    codes[ends] = np.arange(s)
    order, group = classes(codes, length, s)
    item = np.searchsorted(ends, order, "left")
    offset = order - (ends[item] - sizes[item])
    whole = np.flatnonzero(offset + length <= sizes[item])
    item, offset, group = item[whole], offset[whole], group[whole]
    far = lefts[item] - offset
    by = np.lexsort((far, groups[item], group))
    item, offset, group, far = item[by], offset[by], group[by], far[by]
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (groups[item][1:] != groups[item][:-1]) | (far[1:] != far[:-1])]) if len(by) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    many = np.add.reduceat(counts[item], at) > 1 if len(at) else np.zeros(0, bool)
    found = np.repeat(many, np.diff(np.append(at, len(by))))
    item, offset = item[found], offset[found]
    by = np.lexsort((offset, item))
    item, offset = item[by], offset[by]
    out: list[list[tuple[int, int]]] = [[] for _ in items]
    if len(by):
        cut = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (offset[1:] > offset[:-1] + length)]))
        for i, a, b in zip(item[cut].tolist(), offset[cut].tolist(), offset[np.append(cut[1:], len(item)) - 1].tolist(), strict=True):
            out[i].append((a, b + length))
    return out


def _scan(df: DataFrame, length: int, gram: int, reach: int, buckets: int) -> DataFrame:
    """Written rows: occurrences (rid, uid, digest, start, size, far) of contexts; and (uid) of contexts with a repeated core."""
    types = {"bucket": pa.int32(), "rid": pa.int64(), "uid": pa.int64(), "digest": pa.int64(), "start": pa.int64(), "size": pa.int32(), "far": pa.int32()}
    types |= {"cores": pa.binary(), "uids": pa.binary(), "flags": pa.binary()}

    def record(**columns: object) -> pa.RecordBatch:
        size = len(columns["bucket"])
        arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(types))

    def wanted(uid: np.ndarray) -> Iterator[pa.RecordBatch]:
        uid = np.unique(uid)
        for a in range(0, len(uid), 100_000):
            u = uid[a : a + 100_000]
            yield record(bucket=(np.arange(len(u)) % buckets).astype(np.int32), uid=u.view(np.int64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            core, uid = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            if not len(core):
                return
            order = np.argsort(core)
            core, uid = core[order], uid[order]
            first = np.concatenate([[True], core[1:] != core[:-1]])
            at = np.flatnonzero(first)
            several = np.diff(np.append(at, len(core))) > 1
            yield from wanted(uid[~first])
            core, uid = core[at], uid[at]
            bucket = (core % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            packed = [[x[order[cuts[b] : cuts[b + 1]]].tobytes() for b in some] for x in (core, uid, several)]
            yield record(bucket=some, cores=packed[0], uids=packed[1], flags=packed[2])

        # occurrences only pass through the next step, so they are dealt evenly, however often a context occurs
        def part_of(data: np.ndarray, starts: np.ndarray, rids: pa.Array, shift: int) -> Iterator[pa.RecordBatch]:
            first, count, anchor, place, core, owner = contexts(data, starts, length, gram, reach)
            if not len(first):
                return
            row = np.searchsorted(starts, first, "right") - 1
            size, far, raw = count + length - 1, place - first, data.tobytes()
            digest = np.frombuffer(b"".join(hashlib.blake2b(raw[a : a + s], digest_size=8).digest() for a, s in zip(first.tolist(), size.tolist(), strict=True)), np.uint64)
            uid = mix(mix(anchor) + digest * np.uint64(3) + far.astype(np.uint64))
            yield record(
                bucket=(np.arange(len(uid)) % buckets).astype(np.int32), rid=rids.take(pa.array(row)), uid=uid.view(np.int64), digest=digest.view(np.int64),
                start=first - starts[row] + shift, size=size.astype(np.int32), far=far.astype(np.int32),
            )
            held.append((core, uid[owner]))
            if sum(len(h[0]) for h in held) > ENTRIES:
                yield from flush()

        for batch in batches:
            for part in pieces(batch, "text"):
                data, starts = text_column(part.column("text"))
                if len(data) <= PART + length:
                    yield from part_of(data, starts, part.column("rid"), 0)
                else:
                    for i in range(part.num_rows):
                        for a in range(int(starts[i]), int(starts[i + 1]), PART):
                            own = data[a : min(a + PART + length - 1, int(starts[i + 1]))]
                            yield from part_of(own, np.array([0, len(own)]), part.column("rid").slice(i, 1), a - int(starts[i]))
        yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            packed = np.array(batch.column("cores").is_valid())
            plain = batch.filter(pa.array(~packed))
            if plain.num_rows:
                yield plain
            for row in zip(*(batch.filter(pa.array(packed)).column(c).to_pylist() for c in ("cores", "uids", "flags")), strict=True):
                held.append(tuple(np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.uint64, bool), strict=True)))
        if held:
            core, uid, flag = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(core)
            core, uid, flag = core[order], uid[order], flag[order]
            at = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
            counts = np.diff(np.append(at, len(core)))
            yield from wanted(uid[np.repeat((counts > 1) | np.logical_or.reduceat(flag, at), counts)])

    schema = "bucket int, rid long, uid long, digest long, start long, size int, far int, cores binary, uids binary, flags binary"
    found = df.mapInArrow(scan, schema).repartition(buckets, "bucket").mapInArrow(gather, schema)
    return settle(found.select("rid", "uid", "digest", "start", "size", "far"), "contexts")


def _blocks(items: DataFrame, length: int, n_blocks: int) -> DataFrame:
    """(uid, digest, runs) of items (anchor, uid, digest, far, n, body) that hold repeated windows, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        filled, last = 0, None

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            found = repeated_runs(
                rows.column("body").to_pylist(), rows.column("anchor").to_numpy(), rows.column("far").to_numpy().astype(np.int64), rows.column("n").to_numpy(), length
            )
            some = [i for i, r in enumerate(found) if r]
            runs = pa.array([[{"a": a, "b": b} for a, b in found[i]] for i in some], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            at = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("uid").combine_chunks().take(at), rows.column("digest").combine_chunks().take(at), runs], names=["uid", "digest", "runs"])

        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                # a group is never parted; a block ends between groups
                if filled > BLOCK_BYTES and anchor[a] != last:
                    yield from done()
                    filled = 0
                part = batch.slice(a, b - a)
                held.append(part)
                filled += int(part.column("size").to_numpy().sum())
                last = anchor[a]
        if held:
            yield from done()

    dealt = items.repartition(n_blocks, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "uid long, digest long, runs array<struct<a: int, b: int>>")


@scratched
def repeated_spans(df: DataFrame, rid: str, text: str, length: int = LENGTH, gram: int = GRAM, reach: int = RANGE, hot: int = HOT) -> DataFrame:
    """(rid, spans) of the texts with bytes that a repeated window covers; spans may touch and overlap."""
    spark = df.sparkSession
    small_batches(spark)
    own = df.select(F.col(rid).alias("rid"), F.col(text).alias("text"))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _scan(own, length, gram, reach, buckets)
    wanted = rows.where(F.col("rid").isNull()).select("uid").distinct()
    found = settle(rows.where(F.col("rid").isNotNull()).join(wanted, "uid", "left_semi"), "occurrences")
    once = found.groupBy("uid", "digest", "size", "far").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start")).alias("at"))
    asked = once.groupBy(F.col("at.rid").alias("_rid")).agg(F.collect_list(F.struct("uid", "digest", "size", "far", "n", F.col("at.start").alias("start"))).alias("_asked"))
    bodies = own.join(asked, F.col("rid") == F.col("_rid")).dropDuplicates(["rid"]).select(F.col("text").cast("binary").alias("_body"), "_asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "digest", "size", "far", "n"]
        for batch in batches:
            for body, asked_ in zip(batch.column("_body"), batch.column("_asked").to_pylist(), strict=True):
                view = body.as_buffer()
                parts = [view.slice(x["start"], x["size"]).to_pybytes() for x in asked_]
                # the anchor's own bytes name the group
                anchor = [int.from_bytes(hashlib.blake2b(p[x["far"] : x["far"] + gram], digest_size=8).digest(), "little", signed=True) for p, x in zip(parts, asked_, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64())] + [pa.array([x[c] for x in asked_], pa.int32() if c in ("size", "far") else pa.int64()) for c in names] + [pa.array(parts, pa.binary())],
                    names=["anchor", *names, "body"],
                )

    item = "anchor long, uid long, digest long, size int, far int, n long, body binary"
    items = settle(bodies.mapInArrow(cut, item), "bodies")
    groups = items.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"))
    total = items.agg(F.sum("size")).first()[0] or 0
    n_blocks = max(buckets, 1 + total // (8 * BLOCK_BYTES))
    crowded = groups.where(F.col("m") > hot).select("anchor")
    judged = _blocks(items.join(crowded, "anchor", "left_anti"), length, n_blocks)
    if not crowded.isEmpty():
        judged = judged.union(_crowded(items.join(crowded, "anchor", "left_semi"), length, n_blocks))
    judged = settle(judged, "runs")
    spans = found.join(judged, ["uid", "digest"]).select("rid", "start", F.explode("runs").alias("r"))
    spans = spans.select("rid", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b"))
    return spans.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _crowded(items: DataFrame, length: int, n_blocks: int) -> DataFrame:
    """The same for anchors with very many contexts: each window is an item of its own, in the group of its digest, so a group has one body, with its count."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, uid, digest, far, n, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "uid", "digest", "far", "n", "body")), strict=True):
                at = range(len(body) - length + 1)
                keys = [int.from_bytes(hashlib.blake2b(body[i : i + length] + (far - i).to_bytes(8, "little") + anchor.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True) for i in at]
                k = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([uid] * k, pa.int64()), pa.array([digest] * k, pa.int64()), pa.array(list(at), pa.int32()), pa.array([n] * k, pa.int64())],
                    names=["key", "uid", "digest", "i", "n"],
                )

    each = settle(items.mapInArrow(windows, "key long, uid long, digest long, i int, n long"), "windows")
    several = each.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("uid", "digest", "i")).alias("at")).where("n > 1")
    asked = several.select("key", "n", F.col("at.uid").alias("uid"), F.col("at.digest").alias("digest"), F.col("at.i").alias("i"))
    bodies = asked.join(items.select("uid", "digest", "body"), ["uid", "digest"]).select(
        F.col("key").alias("anchor"), F.col("key").alias("uid"), F.lit(0).cast("long").alias("digest"), F.lit(length).alias("size"), F.lit(0).alias("far"), "n",
        F.substring("body", F.col("i") + 1, F.lit(length)).alias("body"),
    )
    judged = _blocks(bodies.dropDuplicates(["anchor"]), length, n_blocks).select(F.col("uid").alias("key"))
    back = each.join(judged, "key").groupBy("uid", "digest").agg(F.array_sort(F.collect_list("i")).alias("at"))
    return back.select("uid", "digest", F.transform("at", lambda i: F.struct(i.alias("a"), (i + length).alias("b"))).alias("runs"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of every row.

    Texts are judged as whole UTF-8; null is empty. Removed is each byte that a string of
    ``length`` bytes covers which also starts anywhere else, in the same text or another.
    spans are the maximal removed runs, kept the remaining bytes (null unless keep_text, as
    they need not be UTF-8). Equal rows count as separate texts, so both lose what they share;
    null keys are handled as any other. An empty table gives no rows.
    """
    if not 1 <= gram <= length - RANGE:
        raise ValueError("gram must leave room for a range of windows")
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_rid", F.xxhash64("_key", "_text"))
    spans = repeated_spans(rows.where(F.octet_length("_text") >= length), "_rid", "_text", length, gram, hot=hot)
    joined = rows.join(spans.withColumnRenamed("rid", "_of"), F.col("_rid") == F.col("_of"), "left").select("_key", F.col("_text").cast("binary").alias("_text"), "spans")
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, digest, merged_all, kept_all = [], [], [], [], []
            for body, found in zip(batch.column("_text"), batch.column("spans").to_pylist(), strict=True):
                raw = body.as_buffer()
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in found or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                h, at, kept = hashlib.sha256(), 0, []
                for a, b in [*merged, [raw.size, raw.size]]:
                    h.update(memoryview(raw)[at:a])
                    if keep_text:
                        kept.append(raw.slice(at, a - at).to_pybytes())
                    at = b
                n_bytes.append(raw.size)
                n_removed.append(sum(b - a for a, b in merged))
                digest.append(h.hexdigest())
                merged_all.append([{"a": a, "b": b} for a, b in merged])
                kept_all.append(b"".join(kept) if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(m) for m in merged_all], pa.int64()), pa.array(digest, pa.string()), pa.array(merged_all, span), pa.array(kept_all, pa.binary())],
                names=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    out = joined.mapInArrow(run, f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: bigint, b: bigint>>, kept binary")
    return out.withColumnRenamed("_key", key)
