"""Split assignment, the split lock and leakage between splits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import SplitConflict, UnknownRepo
from millrace.functions.text import jaccard, token_set
from millrace.llm.common import batches_of, released, spread
from millrace.llm.groups import BLOCK, PAIRS, Sketches, can_link, odd_sketches, units, wanted_rows, whole_units
from millrace.llm.ngrams import entries
from millrace.operators.components import components, local_components
from millrace.session import forget, settle

SPLITS = ("train", "val", "test")


def assign_splits(df: DataFrame, repo: str, assignments: dict[str, str], by_repo: bool = True) -> DataFrame:
    """df with split; rows of repositories in "ood" are left out, an unknown repository is an error.

    The assignments are a small table of the caller's, part of the plan.
    """
    if not by_repo:
        raise ValueError("splits are by repository only")
    pairs = [x for k, v in sorted(assignments.items()) for x in (F.lit(k), F.lit(v))]
    placed = df.withColumn("split", F.try_element_at(F.create_map(*pairs), F.col(repo)))
    unknown = placed.where(F.col("split").isNull()).select(repo).distinct().limit(5).collect()
    if unknown:
        raise UnknownRepo(", ".join(sorted(str(r[0]) for r in unknown)))
    return placed.where(F.col("split") != "ood")


def split_lock(df: DataFrame, repo: str, split: str) -> DataFrame:
    """One row: (by_repo canonical JSON, split_hash); a repository in two splits is an error."""
    pairs = df.groupBy(repo).agg(F.min(split).alias("split"), F.max(split).alias("other"))
    clash = pairs.where("split <> other").limit(1).collect()
    if clash:
        raise SplitConflict(str(clash[0][0]))
    body = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col(repo), F.lit('": "'), F.col("split"), F.lit('"')))), ", ")
    return pairs.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("by_repo")).withColumn("split_hash", F.sha2("by_repo", 256))


def priority(split: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), split)


def token_classes(df: DataFrame, key: str, text: str, split: str) -> DataFrame:
    """(id, split, class, w) of every row with tokens: w are the 64-bit hashes of its different tokens; rows of equal token sets are of one class, named by a 128-bit digest."""
    rows = df.select(F.col(key).alias("id"), F.col(split).alias("split"), F.array_sort(token_set(F.col(text))).alias("t")).where(F.size("t") > 0)
    # tokens hold no white space, so the joined text is the set
    return rows.select("id", "split", F.md5(F.array_join("t", " ").cast("binary")).alias("class"), F.array_distinct(F.transform("t", lambda t: F.xxhash64(t))).alias("w"))


def _across(low, high, other_low, other_high):
    """Whether some split of the one comes before some split of the other, either way round."""
    return (low < other_high) | (other_low < high)


def _by_words(sets: DataFrame, threshold: float) -> DataFrame:
    """(class, other) of sets that may be so similar, for any threshold.

    Token sets are ordered by corpus rarity; similar sets share one of their first
    n - ceil(n * threshold) + 1 tokens. Sets meet by such a token and by a band of sizes, and
    only neighbouring bands hold sizes within the threshold, so a frequent token's sets are
    dealt out by size; what they can still share after that token must suffice.
    """
    words = sets.select("class", "low", "high", F.size("w").alias("n"), F.explode("w").alias("t"))
    counts = words.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ranked = words.join(counts, "t").withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("f", "t")))
    prefix = (F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & (F.col("f") > 1)
    # sizes of one band differ by less than the threshold's ratio; without one, all are of one band
    band = F.floor(F.ln("n") / F.lit(math.log(1 / threshold))) if threshold > 0 else F.lit(0)
    index = settle(ranked.where(prefix).select("t", "class", "low", "high", "n", "at", band.cast("long").alias("band")), "prefixes")
    bands = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1) if threshold > 0 else F.array("band")
    other = index.select("t", F.explode(bands).alias("band"), F.col("class").alias("other"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    near = index.join(other, ["t", "band"]).where((F.col("class") < F.col("other")) & (F.least("n", "n_b") >= threshold * F.greatest("n", "n_b") - 1e-9))
    near = near.where(_across(F.col("low"), F.col("high"), F.col("low_b"), F.col("high_b")))
    near = near.where(1 + F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= threshold / (1 + threshold) * (F.col("n") + F.col("n_b")) - 1e-9)
    return settle(near.select("class", "other").distinct(), "candidates")


#: Token hashes whose index entries a task makes at once, and rows of a batch of sets.
HASHES_HELD, SETS_HELD = 1 << 19, 2000
#: Buckets whose entries are counted; their counts, 512 kB, go to all tasks.
BUCKETS_LOG = 16


def _named() -> Column:
    """Half of a class's digest, which stands for it in the index."""
    return F.conv(F.substring("class", 1, 16), 16, -10).cast("long").alias("set")


def _joined(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of sets that may have a similarity of percent / 100 with another: such pairs are of one component.

    The index of the n-gram join: linked sets agree in a whole segment of the universe of
    hashes, which few others do. The allocation has as many segments to spare as a set may drop
    of its most frequent ones: the rarest common entry stays in both, in whatever order, so that
    of counts by bucket will do. Groups of sets with a common entry are compared where they are,
    by sketches, and hand on a forest of what these let pass: pairs, which may be many more than
    sets and meet in many groups, are never shuffled.
    """
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("w")).to_numpy().astype(np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HASHES_HELD, "right")))
                part, size = batch.slice(start, stop - start), sizes[start:stop]
                values = part.column("w").flatten().to_numpy().view(np.uint64)
                values = values[np.lexsort((values, np.repeat(np.arange(len(size)), size)))]
                at = np.concatenate([[0], np.cumsum(size)])
                entry, owner, tag = entries(values, at, percent)
                order = np.lexsort((entry, tag, owner))
                entry, owner, tag = entry[order], owner[order], tag[order]
                fresh = np.concatenate([[True], (entry[1:] != entry[:-1]) | (tag[1:] != tag[:-1]) | (owner[1:] != owner[:-1])]) if len(entry) else np.zeros(0, bool)
                entry, owner, tag = entry[fresh], owner[fresh], tag[fresh]
                offsets = pa.array(np.searchsorted(owner, np.arange(len(size) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(entry.view(np.int64)), pa.array(tag.astype(np.int8)))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("set", "low", "high")), pa.array(size.astype(np.int32)), odd_sketches(values, at), *lists], names=["set", "low", "high", "n", "sketch", "entries", "tags"])
                start = stop

    with batches_of(sets.sparkSession, SETS_HELD):
        indexed = settle(sets.select(_named(), "low", "high", "w").mapInArrow(index, "set long, low int, high int, n int, sketch binary, entries array<bigint>, tags array<tinyint>"), "entries")
    bucket = F.shiftrightunsigned("entry", 64 - BUCKETS_LOG).alias("bucket")
    often = np.zeros(1 << BUCKETS_LOG, np.int64)
    for row in indexed.select(F.explode("entries").alias("entry")).select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        often[row["bucket"]] = row["n"]
    counts = sets.sparkSession.sparkContext.broadcast(often)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, tag = (batch.column(c).flatten().to_numpy() for c in ("entries", "tags"))
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("entries")).to_numpy())
            scheme, drops = owner * 64 + tag, tag % 32
            order = np.lexsort((entry, -counts.value[entry.view(np.uint64) >> np.uint64(64 - BUCKETS_LOG)], scheme))
            scheme, drops = scheme[order], drops[order]
            rank = np.arange(len(order)) - np.searchsorted(scheme, scheme, "left")
            own = order[(drops == 0) | (rank >= drops)]
            rows = batch.select(["set", "low", "high"]).take(pa.array(owner[own]))
            yield pa.RecordBatch.from_arrays([pa.array(entry[own]), *rows.columns], names=["entry", "set", "low", "high"])

    # groups of the same sets are named alike and count once; those of one split hold no pair
    whole = Window.partitionBy("entry")
    marks = [F.bit_xor(F.xxhash64("set", F.lit(i))).over(whole) for i in (1, 2)]
    sized = {"size": F.count(F.lit(1)).over(whole), "first": F.min("low").over(whole), "last": F.max("high").over(whole), "x": marks[0], "y": marks[1]}
    with batches_of(sets.sparkSession, SETS_HELD):
        one = indexed.select("entries", "tags", "set", "low", "high").mapInArrow(rare, "entry long, set long, low int, high int")
        met = one.withColumns(sized).where("size > 1 AND first < last")
        members = settle(met.select(F.xxhash64("x", "y", "size").alias("grp"), "set", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).distinct(), "groups")
    sketched = settle(indexed.select("set", "low", "high", "n", "sketch"), "sketches")
    forget(indexed)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches):
            rows = rows.combine_chunks()
            ids, sketches = rows.column("set").to_numpy(), Sketches(rows.column("sketch").combine_chunks())
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i, j in _askable(rows, sketches, percent):
                # of the pairs a forest goes on, so that their number does not
                nodes, roots = local_components(np.concatenate([a, ids[i]]), np.concatenate([b, ids[j]]))
                a, b = nodes[nodes != roots], roots[nodes != roots]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = units(members.join(sketched, "set")).repartition("unit").sortWithinPartitions("unit")
    with batches_of(sets.sparkSession, SETS_HELD):
        links = settle(dealt.select("unit", "part", "set", "low", "high", "n", "sketch").mapInArrow(released(linked), "a long, b long"), "forests")
    forget(members)
    forget(sketched)
    labels = components(links, "a", "b")
    forget(links)
    return labels


def _askable(rows: pa.Table, sketches: Sketches, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (unit, part, low, high, n) of one unit that lie in different splits and that sizes and sketches let pass, some at a time.

    Rows come by unit. Units of two parts only hold pairs across these.
    """
    unit, part, low, high, n = (rows.column(c).to_numpy() for c in ("unit", "part", "low", "high", "n"))
    at = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    sizes = np.diff(np.append(at, len(unit)))
    start = np.repeat(at, sizes)
    two = np.repeat(np.minimum.reduceat(part, at) != np.maximum.reduceat(part, at), sizes)
    before = np.arange(len(unit)) - start
    ends = np.cumsum(before)
    a = 0
    while a < len(unit):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        asks = np.arange(a, b)
        i, j = np.repeat(asks, before[asks]), spread(start[asks], before[asks])
        ok = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (~two[i] | (part[i] != part[j])) & _across(low[i], high[i], low[j], high[j])
        i, j = i[ok], j[ok]
        ok = can_link(sketches.apart(i, sketches, j), n[i], n[j], percent)
        yield i[ok], j[ok]
        a = b


def _overlaps(values: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values the sets i[.] and j[.] share. Set s are the different values at[s]:at[s + 1]."""
    names, named = np.unique(values, return_inverse=True)
    keys = np.repeat(np.arange(len(at) - 1), np.diff(at)) * len(names) + named
    keys.sort()
    size, out = np.diff(at), np.zeros(len(i), np.int64)
    ends, s = np.cumsum(size[i]), 0
    while s < len(i):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + HASHES_HELD, "right")))
        own = size[i[s:e]]
        asked = named[spread(at[i[s:e]], own)] + np.repeat(j[s:e] * len(names), own)
        hit = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
        out[s:e] = np.add.reduceat(hit, np.cumsum(own) - own, dtype=np.int64)
        s = e
    return out


def _scored(sets: DataFrame, labels: DataFrame, threshold: float, percent: int) -> DataFrame:
    """(class, other, jaccard) of the pairs of one component, given (node, component), that are so similar.

    Components are dealt into blocks, and each two blocks meet in a task; so a set is sent once for each
    block of its component, and no pair is.
    """
    # a component's least node is named by the others only
    labels = labels.union(labels.select("component", "component").distinct())
    sized = settle(labels.join(sets.select(_named(), F.size("w").alias("n")), F.col("node") == F.col("set")).select("set", F.col("component").alias("grp"), "n"), "joined")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / HASHES_HELD)).cast("int").alias("blocks")
    placed = sized.join(sized.groupBy("grp").agg(blocks), "grp").select(F.col("set").alias("_set"), "grp", "blocks").distinct()
    held = wanted_rows(sets.select(_named(), "class", "w", "low", "high"), sized, "set")
    dealt = units(held.join(placed, F.col("set") == F.col("_set"))).repartition("unit").sortWithinPartitions("unit")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches, BLOCK):
            rows = rows.combine_chunks()
            w, names = rows.column("w").combine_chunks(), rows.column("class")
            n = pc.list_value_length(w).to_numpy().astype(np.int64)
            at, values = np.concatenate([[0], np.cumsum(n)]), w.flatten().to_numpy().view(np.uint64)
            for i, j in _askable(rows.append_column("n", pa.array(n)), Sketches(odd_sketches(values, at)), percent):
                both = _overlaps(values, at, i, j)
                alike = both / (n[i] + n[j] - both)
                own = alike >= threshold
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x[own])).combine_chunks() for x in (i, j)] + [pa.array(alike[own])], names=["class", "other", "jaccard"])

    with batches_of(sets.sparkSession, SETS_HELD):
        found = settle(dealt.select("unit", "part", "class", "low", "high", "w").mapInArrow(released(score), "class string, other string, jaccard double"), "similar")
    forget(sized)
    return found


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(class, other, jaccard), both ways round, of classes of different token sets at least so similar that lie in different splits.

    sets: (class, w, low, high), with the places of the first and the last split of each.
    """
    if threshold >= 1:
        # different sets are never wholly similar
        return sets.select("class", F.col("class").alias("other"), F.lit(1.0).alias("jaccard")).limit(0)
    percent = math.floor(threshold * 100 + 1e-9)
    if percent >= 50:
        labels = _joined(sets, percent)
        scored = _scored(sets, labels, threshold, percent)
        forget(labels)
    else:
        pairs = _by_words(sets, threshold)
        # of the sets only those of some pair are sent
        hashed = F.xxhash64("class").alias("_hash")
        wanted = pairs.select(hashed).union(pairs.select(F.xxhash64("other"))).distinct()
        held = settle(wanted_rows(sets.select("class", "w", hashed), wanted, "_hash").select("class", "w"), "wanted")
        left, right = held.select("class", F.col("w").alias("wa")), held.select(F.col("class").alias("other"), F.col("w").alias("wb"))
        scored = pairs.join(left, "class").join(right, "other").withColumn("jaccard", jaccard(F.col("wa"), F.col("wb"))).where(F.col("jaccard") >= threshold)
        scored = settle(scored.select("class", "other", "jaccard"), "similar")
    return scored.unionByName(scored.select(F.col("other").alias("class"), F.col("class").alias("other"), "jaccard"))


def leaks(df: DataFrame, key: str, text: str, split: str, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(members, links): members are (id, split, class), links (class, other, jaccard) of classes that lie in different splits.

    A class that is itself in several splits links to itself with 1. Copies are not expanded
    into pairs: both tables grow with the rows and with the pairs of different texts.
    """
    rows = settle(token_classes(df, key, text, split), "token-sets")
    members = settle(rows.select("id", "split", "class"), "members")
    if threshold > 1:
        forget(rows)
        return members, members.select("class", F.col("class").alias("other"), F.lit(1.0).alias("jaccard")).limit(0)
    place = priority(F.col("split")).cast("int")
    sets = settle(rows.groupBy("class").agg(F.first("w").alias("w"), F.min(place).alias("low"), F.max(place).alias("high")), "sets")
    forget(rows)
    itself = sets.where("low < high").select("class", F.col("class").alias("other"), F.lit(1.0).alias("jaccard"))
    links = settle(similar_classes(sets, threshold).unionByName(itself), "leaks")
    forget(sets)
    return members, links


def detect_leakage(df: DataFrame, key: str, text: str, split: str, threshold: float = 0.85) -> DataFrame:
    """(split_a, a, split_b, b, jaccard) of rows of different splits with token sets at least so similar, a in the earlier split.

    ``leaks`` spelled out row by row; where many copies lie in several splits, use that instead.
    """
    members, links = leaks(df, key, text, split, threshold)
    a = members.select("class", F.col("id").alias("a"), F.col("split").alias("split_a"))
    b = members.select(F.col("class").alias("other"), F.col("id").alias("b"), F.col("split").alias("split_b"))
    found = links.join(a, "class").join(b, "other").where(priority(F.col("split_a")) < priority(F.col("split_b")))
    return found.select("split_a", "a", "split_b", "b", "jaccard")


def leaking_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id) of rows that a similar row of an earlier split forestalls, found by class: no pairs of rows are made."""
    first = members.groupBy(F.col("class").alias("other")).agg(F.min(priority(F.col("split"))).alias("_p"))
    earliest = links.join(first, "other").groupBy("class").agg(F.min("_p").alias("_p"))
    return members.join(earliest, "class").where(priority(F.col("split")) > F.col("_p")).select("id")


def resolve_leakage(df: DataFrame, key: str, leaks: DataFrame) -> DataFrame:
    """df without the later split's member of each leaking pair."""
    return df.join(leaks.select(F.col("b").alias(key)).distinct(), key, "left_anti")


def without_leaks(df: DataFrame, key: str, text: str, split: str, threshold: float = 0.85) -> DataFrame:
    """df without rows that resemble a row of an earlier split, by classes: what ``resolve_leakage`` gives for all pairs."""
    gone = leaking_rows(*leaks(df, key, text, split, threshold))
    return df.join(gone.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def spanning_clusters(df: DataFrame, cluster: str, split: str) -> DataFrame:
    """(cluster, n_splits, members) of clusters with rows in several splits, which are dropped."""
    return df.groupBy(cluster).agg(F.countDistinct(split).alias("n_splits"), F.count(F.lit(1)).alias("members")).where("n_splits > 1")


def numbered_assignments(prefix: str, train: int, val: int, test: int) -> dict[str, str]:
    """prefix0, prefix1, ... dealt to the splits in order."""
    names = ["train"] * train + ["val"] * val + ["test"] * test
    return {f"{prefix}{i}": s for i, s in enumerate(names)}


def union_in_order(parts: dict[str, DataFrame]) -> DataFrame:
    """The splits' rows as one table, with split and its place in the order."""
    return reduce(DataFrame.unionByName, [parts[s].withColumn("split", F.lit(s)).withColumn("split_order", F.lit(i)) for i, s in enumerate(SPLITS) if s in parts])
