"""Groups of sets that share an index entry: their way through the shuffle, and their comparison inside tasks.

An index gives each set some entries, 64-bit hashes of which 48 bits are kept; sets with a
common entry form its group. Entries travel packed, a few bytes each. Groups of at most SMALL
sets are formed by the bucket of their entries; of larger ones each task hands on its part, so
that a frequent entry never gathers in one place. Groups are then compared in units of at most
two blocks, by sketches that bound the difference of two sets from below, and only pairs that
the sketches let pass are handed on, a few for each set and round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import mix, released, spread

#: Sets of a group that is formed by its bucket; larger groups are formed by a shuffle of their own.
SMALL = 16
#: Sets of a block; a unit of comparison holds two blocks at most.
BLOCK = 2048
#: Entries and (set, tag) owners that a task holds before it hands them on.
ENTRIES, OWNERS = 500_000, 1 << 16
#: Pairs that a task compares at once.
PAIRS = 200_000
#: Bits of an entry that are kept.
BITS = 48

PACKED = {"bucket": pa.int32(), "base": pa.int64(), "width": pa.int32(), "steps": pa.binary(), "owners": pa.binary(), "sets": pa.binary(), "infos": pa.binary(), "extras": pa.binary(), "flags": pa.binary()}
GROUPED = {"grp": pa.int64(), "set": pa.int64(), "info": pa.int32(), "extra": pa.int32(), "hot": pa.bool_()}


def record(types: dict[str, pa.DataType], n: int, /, **columns: object) -> pa.RecordBatch:
    """A batch of n rows with the given columns and nulls for the others."""
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


class Index:
    """Entries of the sets of a task, handed on packed and by bucket."""

    def __init__(self, types: dict[str, pa.DataType], buckets: int, small: int = SMALL) -> None:
        self.types, self.buckets, self.small = types, buckets, small
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.extras: list[np.ndarray] = []
        self.sets: list[np.ndarray] = []
        self.infos: list[np.ndarray] = []
        self.entries = self.owners = 0

    def add(self, entry: np.ndarray, owner: np.ndarray, sets: np.ndarray, infos: np.ndarray, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Entry i belongs to owner[i], an index of sets and infos. Owners may be more than one flush takes."""
        for low in range(0, len(sets), OWNERS // 4):
            high = min(low + OWNERS // 4, len(sets))
            own = slice(None) if high - low == len(sets) else np.flatnonzero((owner >= low) & (owner < high))
            if self.owners + high - low > OWNERS or self.entries > ENTRIES:
                yield from self.flush()
            self.keys.append((entry[own] >> np.uint64(64 - BITS) << np.uint64(16)) | (owner[own] - low + self.owners).astype(np.uint64))
            self.extras.append(np.zeros(len(self.keys[-1]), np.uint8) if extra is None else extra[own])
            self.sets.append(sets[low:high])
            self.infos.append(infos[low:high].astype(np.int32))
            self.entries += len(self.keys[-1])
            self.owners += high - low

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.entries:
            self.clear()
            return
        key, extra, sets, infos = (np.concatenate(x) for x in (self.keys, self.extras, self.sets, self.infos))
        self.clear()
        if extra.any():
            order = np.argsort(key)
            key, extra = key[order], extra[order]
        else:
            key.sort()
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        key, extra = key[fresh], extra[fresh]
        entry, owner = key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype(np.uint16)
        at = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        counts = np.diff(np.append(at, len(entry)))
        large = counts > self.small
        stay = np.ones(len(entry), bool)
        flag = np.zeros(len(entry), bool)
        if large.any():
            # what many sets here share goes on by itself; one of them tells the bucket
            own = np.repeat(large, counts)
            yield from self.grouped(entry[own], sets[owner[own]], infos[owner[own]], extra[own], True)
            stay = ~own
            stay[at[large]] = flag[at[large]] = True
        entry, owner, extra, flag = entry[stay], owner[stay], extra[stay], flag[stay]
        bounds = (np.arange(self.buckets + 1, dtype=object) << BITS) // self.buckets
        cuts = np.searchsorted(entry, np.array([min(int(b), (1 << BITS) - 1) for b in bounds[:-1]], np.uint64)).tolist() + [len(entry)]
        for b in range(self.buckets):
            own = slice(cuts[b], cuts[b + 1])
            n = cuts[b + 1] - cuts[b]
            if not n:
                continue
            step = np.diff(entry[own], prepend=entry[own][:1])
            width = max(1, (int(step.max()).bit_length() + 7) // 8)
            used = np.zeros(len(sets), bool)
            used[owner[own]] = True
            number = (np.cumsum(used) - 1).astype(np.uint16)
            yield record(
                self.types, 1, bucket=[b], base=[int(entry[cuts[b]])], width=[width], steps=[np.ascontiguousarray(step.view(np.uint8).reshape(n, 8)[:, :width]).tobytes()],
                owners=[number[owner[own]].tobytes()], sets=[sets[used].tobytes()], infos=[infos[used].tobytes()], extras=[extra[own].tobytes()], flags=[np.packbits(flag[own]).tobytes()],
            )

    def grouped(self, grp: np.ndarray, sets: np.ndarray, infos: np.ndarray, extra: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(grp), 50_000):
            cut = slice(a, a + 50_000)
            n = len(grp[cut])
            yield record(
                self.types, n, bucket=(np.arange(a, a + n) % self.buckets).astype(np.int32), grp=grp[cut].view(np.int64), set=sets[cut], info=infos[cut], extra=extra[cut].astype(np.int32), hot=np.full(n, hot),
            )

    def gather(self, packed: list[dict], by_members: bool) -> Iterator[pa.RecordBatch]:
        """The groups among a bucket's packed rows. by_members: groups of the same sets are named alike, and count once."""
        if not packed:
            return
        entries, owners, sets, infos, extras, flags, shift = [], [], [], [], [], [], 0
        for row in packed:
            n = len(row["extras"])
            step = np.zeros((n, 8), np.uint8)
            step[:, : row["width"]] = np.frombuffer(row["steps"], np.uint8).reshape(n, row["width"])
            entries.append(np.uint64(row["base"]) + np.cumsum(step.view(np.uint64).reshape(n), dtype=np.uint64))
            owners.append(np.frombuffer(row["owners"], np.uint16).astype(np.int32) + np.int32(shift))
            sets.append(np.frombuffer(row["sets"], np.int64))
            infos.append(np.frombuffer(row["infos"], np.int32))
            extras.append(np.frombuffer(row["extras"], np.uint8))
            flags.append(np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=n).astype(bool))
            shift += len(sets[-1])
        entry, owner, own_set, info, extra, flag = (np.concatenate(x) for x in (entries, owners, sets, infos, extras, flags))
        del entries, owners, sets, infos, extras, flags
        order = np.argsort(entry)
        ranked = entry[order]
        same = ranked[1:] == ranked[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | flag[order]
        at = order[several]
        entry, owner, extra, flag = entry[at], owner[at], extra[at], flag[at]
        member, info = own_set[owner], info[owner]
        order = np.lexsort((extra, member, entry))
        entry, member, info, extra, flag = (x[order] for x in (entry, member, info, extra, flag))
        if not len(entry):
            return
        flagged = np.logical_or.reduceat(flag, np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])))
        fresh = np.concatenate([[True], (entry[1:] != entry[:-1]) | (member[1:] != member[:-1])])
        entry, member, info, extra = entry[fresh], member[fresh], info[fresh], extra[fresh]
        at = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        counts = np.diff(np.append(at, len(entry)))
        large = flagged | (counts > self.small)
        own = np.repeat(large, counts)
        yield from self.grouped(entry[own], member[own], info[own], extra[own], True)
        few = ~large & (counts > 1)
        name = entry[at]
        if by_members:
            with np.errstate(over="ignore"):
                name = mix(np.add.reduceat(mix(member.view(np.uint64)), at) + counts.astype(np.uint64))
            first = np.zeros(len(at), bool)
            first[np.flatnonzero(few)[np.unique(name[few], return_index=True)[1]]] = True
            few &= first
        own = np.repeat(few, counts)
        yield from self.grouped(np.repeat(name, counts)[own], member[own], info[own], extra[own], False)


def cells_of(sizes: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets of these sizes."""
    share = np.where(sizes > 512, 0.6, 1.0)
    return np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(sizes, 1) * share)), 6, 16).astype(np.int64))


def odd_sketches(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Of each set the parity of the number of its values in each cell. Sketches of two sets, folded to one size,
    differ in no more bits than the sets differ in elements."""
    sizes = np.diff(at)
    cells = cells_of(sizes)
    ends = np.cumsum(cells)
    where = np.repeat(ends - cells, sizes) + (values & np.repeat(cells - 1, sizes).astype(np.uint64)).astype(np.int64)
    bits = np.packbits(np.bincount(where, minlength=int(ends[-1]) if len(ends) else 0).astype(np.uint8) & 1)
    offsets = np.concatenate([[0], ends // 8])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(bits.tobytes())])


class Sketches:
    """Sketches of a batch of sets, in one matrix a size."""

    def __init__(self, column: pa.Array) -> None:
        raw = column.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) and raw.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.length = np.diff(offsets)
        self.row = np.zeros(len(raw), np.int64)
        self.tables: dict[int, np.ndarray] = {}
        for size in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == size)
            self.row[own] = np.arange(len(own))
            self.tables[size] = data[spread(offsets[own], np.full(len(own), size))].view(np.uint64).reshape(len(own), size // 8)
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def at(self, size: int, to: int) -> np.ndarray:
        if (size, to) not in self.folded:
            x = self.tables[size]
            while x.shape[1] * 8 > to:
                half = x.shape[1] // 2
                x = x[:, :half] ^ x[:, half:]
            self.folded[size, to] = x
        return self.folded[size, to]

    def apart(self, i: np.ndarray, other: Sketches, j: np.ndarray) -> np.ndarray:
        """Lower bounds of the differences of set i[.] here and set j[.] there."""
        out = np.zeros(len(i), np.int64)
        kind = self.length[i] * (1 << 20) + other.length[j]
        for code in np.unique(kind).tolist():
            own = np.flatnonzero(kind == code)
            a, b = divmod(code, 1 << 20)
            to = min(a, b)
            x, y = self.at(a, to), other.at(b, to)
            step = max(1, (16 << 20) // to)
            for s in range(0, len(own), step):
                part = own[s : s + step]
                out[part] = np.bitwise_count(x[self.row[i[part]]] ^ y[other.row[j[part]]]).sum(1, dtype=np.int64)
        return out


def can_link(apart: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b that differ in at least so many elements can have the similarity."""
    return (apart * (100 + percent) <= (a + b) * (100 - percent)) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches of sets (set, n, sketch) do not rule out; exact, as both only bound the difference from below."""
    sides = [sets.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b")]
    asked = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.arange(batch.num_rows)
            apart = Sketches(batch.column("sa")).apart(at, Sketches(batch.column("sb")), at)
            yield batch.select(["a", "b"]).filter(pa.array(can_link(apart, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)))

    return asked.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(released(run), "a long, b long")


#: Words of 64 bits that tell which hashes are wanted.
WORDS_LOG = 18


def wanted_rows(rows: DataFrame, wanted: DataFrame, hashed: str) -> DataFrame:
    """The rows whose 64-bit hash is among those of wanted, and some others: a set bit a hash, in 2 ** WORDS_LOG words.

    The words are broadcast, which their number bounds to a few MB, whatever the tables' sizes; so of
    wide rows that a join will drop, most never reach its shuffle.
    """
    word, bit = F.shiftrightunsigned(F.col(hashed), 64 - WORDS_LOG), F.col(hashed).bitwiseAND(63).cast("int")
    one = F.expr("shiftleft(1L, _bit)")
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    held = rows.withColumn("_at", word).withColumn("_bit", bit).join(F.broadcast(bits), F.col("_at") == F.col("_word"))
    return held.where(F.col("_bits").bitwiseAND(one) != 0).drop("_at", "_bit", "_word", "_bits")


def in_blocks(block: int = BLOCK) -> Column:
    """Of a group: how many blocks its sets make."""
    return F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")


def units(groups: DataFrame) -> DataFrame:
    """groups (grp, set, blocks, ...) with unit and part: groups of more than a block are dealt into blocks, and each two blocks meet in a unit."""
    dealt = groups.withColumn("part", F.pmod(F.xxhash64("set", "grp"), F.col("blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("unit", F.xxhash64("grp", F.least("part", "_other"), F.greatest("part", "_other"))).drop("_other")


def alone(groups: DataFrame) -> DataFrame:
    """The same for groups of at most a block."""
    return groups.withColumn("part", F.lit(0)).withColumn("unit", F.col("grp"))


def whole_units(batches: Iterator[pa.RecordBatch], least: int = 4 * BLOCK) -> Iterator[pa.Table]:
    """The rows of a task, sorted by unit, in tables of whole units: of several while they have no more than ``least`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        # a unit ends where the next begins
        unit = batch.column("unit").to_numpy()
        fresh = np.flatnonzero(unit[1:] != unit[:-1]) + 1
        if held and held[-1].column("unit")[-1].as_py() != unit[0]:
            fresh = np.concatenate([[0], fresh])
        if rows + batch.num_rows > least and len(fresh):
            cut = int(fresh[-1])
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def compared(members: DataFrame, percent: int, turn: int, order: list[str], positional: bool = False) -> DataFrame:
    """(a, b, grp): pairs that sketches let pass and that are not settled; rows with only grp of groups with more of
    them; and in the first turn rows with only a of all sets in pairs that sketches let pass.

    members: (unit, grp, part, set, n, sketch, mark, done, extra) and what ``order`` names. Within a unit
    each set asks those before it, nearest first. The first turn hands on its first answer, the next ones
    its next seven, its next 56 and so on, but for sets with the same mark, and none if it is done. Sets of two
    parts are only compared across these. positional: extra is the place of the shared token in its set, which bounds the overlap.
    """
    low, high = 8 ** (turn - 1) if turn else 0, 8**turn

    def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        unit, grp, ids, n, mark, part, extra = (rows.column(c).to_numpy() for c in ("unit", "grp", "set", "n", "mark", "part", "extra"))
        done = rows.column("done").to_numpy(zero_copy_only=False)
        sketches = Sketches(rows.column("sketch").combine_chunks() if rows.num_rows else pa.array([], pa.binary()))
        at = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        sizes = np.diff(np.append(at, len(unit)))
        start = np.repeat(at, sizes)
        two = np.repeat(np.minimum.reduceat(part, at) != np.maximum.reduceat(part, at), sizes)
        before = np.arange(len(unit)) - start
        ends = np.cumsum(before)
        a, more, seen = 0, [], []
        while a < len(unit):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            asks = np.arange(a, b)[~done[a:b]]
            i, j = np.repeat(asks, before[asks]), spread(start[asks], before[asks])
            ok = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (~two[i] | (part[i] != part[j]))
            if positional:
                ok &= np.minimum(n[i] - extra[i], n[j] - extra[j]) * (100 + percent) >= percent * (n[i] + n[j])
            i, j = i[ok], j[ok]
            apart = sketches.apart(i, sketches, j)
            ok = can_link(apart, n[i], n[j], percent)
            i, j, apart = i[ok], j[ok], apart[ok]
            by = np.lexsort((j, apart, i))
            i, j = i[by], j[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
            open_ = mark[i] != mark[j]
            now = open_ & (rank >= low) & (rank < high)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[now]]), pa.array(ids[j[now]]), pa.array(grp[i[now]])], names=["a", "b", "grp"])
            more.append(grp[i[open_ & (rank >= high)]])
            if not turn:
                seen.append(np.unique(ids[np.concatenate([i, j])]))
            a = b
        left = np.unique(np.concatenate(more)) if more else np.zeros(0, np.int64)
        for own, n_th in ((np.unique(np.concatenate(seen)) if seen else left[:0], 0), (left, 2)):
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(own) if c == n_th else pa.nulls(len(own), pa.int64()) for c in range(3)], names=["a", "b", "grp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches):
            yield from judged(rows)

    columns = ["unit", "grp", "part", "set", "n", "sketch", "mark", "done", "extra"]
    dealt = members.repartition("unit").sortWithinPartitions("unit", *order)
    return dealt.select(*columns).mapInArrow(released(run), "a long, b long, grp long")
