"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of its distinct k-word shingles, as 64-bit hashes. Sizes fall into
bands so narrow that linked sets lie in the same or in neighbouring bands; each pair of
neighbouring bands has a scheme. A scheme splits the universe of hashes into m segments. Two
linked sets of the scheme differ in at most H elements, so if each segment may spoil at most
what it costs, some segment agrees: one of cost 1 agrees exactly, one of cost 2 but for one
deletion. Segments are indexed by hash, with their one-deletion neighbourhoods where the
allocation gives them cost 2; equal entries make candidates, and candidates are verified.

Only sets that share an entry are compared. Entries that very many sets share are left out
where a set has others: the allocation adds segments, so that linked sets agree in more than
one, and each set drops as many of its most frequent ones (the rarest common entry stays in
both). Groups are compared in rounds, see connections: as what is asked for is connection, a
pair within a component is not tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from math import exp, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, distinct_sets, mix, pieces, released, shingles, small_batches, spread, text_column, word_hashes, words
from millrace.llm.groups import BLOCK, GROUPED, PACKED, SMALL, Index, alone, compared, in_blocks, odd_sketches, possible, record, units, wanted_rows
from millrace.operators.components import components
from millrace.session import forget, modest, scratched, settle

#: Sets that the allocation expects in a scheme, the weight of false candidates in its cost.
EXPECTED_SETS = 100_000
#: Segments added so that as many frequent entries of a set may go unindexed: one for so many differences, and no more than so many.
DROP_EVERY, DROPS = 8, 30
#: Members that one task compares with a leader.
MEMBERS = 256
#: Rounds in which groups of more than SMALL sets only ask leaders; all their pairs are compared after these.
LEADERS = 2
#: Parts that a component's sets are dealt into to get their least key.
SALTS = 64


@cache
def bands(percent: int) -> tuple[int, ...]:
    """First sizes of the bands: a linked set is at most one band further."""
    firsts = [1]
    while firsts[-1] < 1 << 40:
        firsts.append(firsts[-1] * 100 // percent + 1)
    return tuple(firsts)


@cache
def allocation(band: int, percent: int) -> tuple[int, int, int, int]:
    """(segments, how many of them have cost 2, empty and frequent segments that may go unindexed) of the scheme of bands band and band + 1.

    Least cost of entries and expected false candidates. Costs add up to H + 1 + e + f, so the
    agreeing segments' costs to e + f + 1 at least, and e empty and f frequent segments of cost 1 can be left out.
    """
    firsts = bands(percent)
    low, most = firsts[band], firsts[band + 2] - 1
    apart = 2 * most * (100 - percent) // (100 + percent)
    if not apart:
        return 0, 0, 0, 0
    n = (low + most) / 2
    best = None
    for twos in range(min(3, (apart + 1) // 2) + 1):
        for spare in range(9):
            m = apart + 1 + spare - twos
            empty = m * (1 - 1 / m) ** n if m > 1 else 0.0
            over = max(0.0, 1 - sum(exp(-empty) * empty**i / factorial(i) for i in range(spare + 1)))
            cost = (m - twos) + twos * (1 + n / m) + EXPECTED_SETS * over * over * (spare + 1)
            if best is None or cost < best[0]:
                best = (cost, m, twos, spare)
    drops = min(DROPS, apart // DROP_EVERY)
    return best[1] + drops, best[2], best[3], drops


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and the starts."""
    data, starts = text_column(column)
    data = LOWER[data]
    begin, end, row = words(data, starts)
    hashes, rows = shingles(word_hashes(data, begin, end), row, len(column), k)
    return distinct_sets(hashes, rows, len(column))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums modulo 2 ** 64 of the runs at[i]:at[i + 1]."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def digests(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit identity per set."""
    return mix(sums(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at) ^ mix(np.diff(at).astype(np.uint64)))


def entries(values: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index entries of the sets, the number of the set of each and its tag.

    A tag tells the one of the set's two schemes, and how many of the set's most frequent entries
    in it need no index (0: this one does, as its segment has cost 2).
    """
    size = np.diff(at)
    band = np.searchsorted(np.array(bands(percent)), size, "right") - 1
    found, owners, tags = [], [], []
    weights = mix(values)
    for shift in (0, 1):
        own = np.flatnonzero((size > 0) & (band >= shift))
        if not len(own):
            continue
        plans = {int(b): allocation(int(b), percent) for b in np.unique(band[own] - shift)}
        m, twos, spare, drops = (np.array([plans[int(b)][i] for b in band[own] - shift], np.int64) for i in range(4))
        used = m > 0
        own, m, twos, spare, drops = own[used], m[used], twos[used], spare[used], drops[used]
        scheme = (band[own] - shift).astype(np.uint64)
        lengths = size[own]
        index = spread(at[own], lengths)
        base = np.cumsum(m) - m
        # values ascend within a set, so segments of the high bits are runs
        segment = ((values[index] >> np.uint64(32)) * np.repeat(m, lengths).astype(np.uint64)) >> np.uint64(32)
        where = np.repeat(base, lengths) + segment.astype(np.int64)
        counts = np.bincount(where, minlength=int(m.sum()))
        total = sums(weights[index], np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]))
        number = np.arange(len(counts)) - np.repeat(base, m)
        place = mix((np.repeat(scheme, m) << np.uint64(40)) | number.astype(np.uint64))
        owner = np.repeat(own, m)
        kept = counts > 0
        many = np.bincount(np.repeat(np.arange(len(own)), m)[~kept], minlength=len(own)) > spare
        kept |= np.repeat(many, m)
        cost_two = number < np.repeat(twos, m)
        kept |= cost_two
        tag = 32 * shift + np.where(cost_two, 0, np.repeat(drops, m))
        found.append(mix(total[kept] ^ place[kept]))
        owners.append(owner[kept])
        tags.append(tag[kept])
        deleted = cost_two[where]
        if deleted.any():
            at_ = where[deleted]
            found.append(mix((total[at_] - weights[index][deleted]) ^ place[at_]))
            owners.append(owner[at_])
            tags.append(tag[at_])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners), np.concatenate(tags)


def candidates(df: DataFrame, k: int, percent: int, buckets: int, small: int = SMALL) -> DataFrame:
    """Written rows: (doc, rid, n, set, sketch) of every document; and (grp, set, info, hot) of the groups of sets with a common entry."""
    types = PACKED | GROUPED | {"doc": pa.int64(), "rid": pa.int64(), "n": pa.int64(), "sketch": pa.binary()}
    plain = ["doc", "rid", "n", "sketch", *GROUPED]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(types, buckets, small)
        for batch in batches:
            for part in pieces(batch, "text"):
                values, at = shingle_sets(part.column("text"), k)
                ids = digests(values, at).view(np.int64)
                yield record(types, len(ids), bucket=(ids.view(np.uint64) % np.uint64(buckets)).astype(np.int32), doc=part.column("doc"), rid=part.column("rid"), n=np.diff(at), set=ids, sketch=odd_sketches(values, at))
                entry, owner, tag = entries(values, at, percent)
                owned, owner = np.unique(owner * 64 + tag, return_inverse=True)
                yield from index.add(entry, owner, ids[owned // 64], owned % 64)
        yield from index.flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[dict] = []
        for batch in batches:
            own = pc.is_valid(batch.column("steps"))
            packed += batch.filter(own).select(list(PACKED)).to_pylist()
            yield batch.filter(pc.invert(own)).select(plain)
        for out in Index(types, buckets, small).gather(packed, by_members=True):
            yield out.select(plain)

    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    schemas = [", ".join(f"{c} {names[t]}" for c, t in kind.items()) for kind in (types, {c: types[c] for c in plain})]
    return settle(df.mapInArrow(released(scan), schemas[0]).repartition(buckets, "bucket").mapInArrow(released(gather), schemas[1]), "entries")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of the pairs whose sets link. texts: (set, text), one row per set.

    Each b is a leader: its text meets those of its a's in tasks of about MEMBERS, whatever the
    number of a's, and a task holds the leader's set and one batch.
    """
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(counts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    members = dealt.join(texts.withColumnRenamed("set", "a"), "a").select("b", "part", F.lit(1).alias("rank"), "a", "text")
    leaders = dealt.select("b", "part").distinct().join(texts.withColumnRenamed("set", "b"), "b").select("b", "part", F.lit(0).alias("rank"), F.col("b").alias("a"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                values, at = shingle_sets(piece.column("text"), k)
                links = []
                for i, (b, rank, a) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("b", "rank", "a")), strict=True)):
                    mine = values[at[i] : at[i + 1]]
                    if rank == 0:
                        leader, own = b, mine.copy()
                    elif leader != b:
                        raise ValueError("a leader's text is missing")
                    elif len(mine) and min(len(mine), len(own)) * 100 >= percent * max(len(mine), len(own)):
                        place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                        both = int((own[place] == mine).sum())
                        if both * 100 >= percent * (len(mine) + len(own) - both):
                            links.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = members.unionByName(leaders).repartition("b", "part").sortWithinPartitions("b", "part", "rank")
    return dealt.mapInArrow(released(run), "a long, b long")


def infrequent(rows: DataFrame) -> DataFrame:
    """(grp, set) of rows (grp, set, info) without the entries that their sets may drop: the most frequent of a scheme."""
    rows = rows.distinct()
    sized = rows.join(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "grp")
    drops = F.col("info") % 32
    order = Window.partitionBy("set", "info").orderBy(F.desc("size"), "grp")
    return sized.withColumn("_rank", F.row_number().over(order)).where((drops == 0) | (F.col("_rank") > drops)).select("grp", "set").distinct()


def connections(small: DataFrame, hot: DataFrame, sets: DataFrame, fetch: Callable[[DataFrame], DataFrame], k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, component) of the sets that link with others, given groups (grp, set) of a few and of many, and sets (set, n, sketch).

    fetch(set) returns the (set, text) of those, once, for all sets that sketches let pass. In each
    round a set asks some of the earlier ones of its groups that sketches let pass, nearest first,
    eight times as many as in the round before; what links is contracted, and pairs within a
    component are not asked again. Sets of large groups first ask a leader or two only, so that a
    group of copies costs about a comparison a set. Rounds end when no group holds an untried pair
    of different components.
    """
    labels: DataFrame | None = None
    texts: DataFrame | None = None
    few: DataFrame | None = small
    crowd: DataFrame | None = hot
    more: DataFrame | None = None
    turn = 0

    def marked(groups: DataFrame) -> DataFrame:
        groups = groups.select("grp", "set")
        if labels is None:
            return groups.withColumn("mark", F.col("set"))
        placed = groups.join(labels.withColumnRenamed("node", "_node"), F.col("set") == F.col("_node"), "left")
        return placed.withColumn("mark", F.coalesce("component", "set")).drop("_node", "component")

    def still_open(groups: DataFrame, more: DataFrame | None) -> DataFrame:
        # what rules a group out is settled on one row a group, before its members are joined
        ends = groups.groupBy("grp").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), in_blocks(block)).where("low <> high")
        ends = ends if more is None else ends.join(more, "grp", "left_semi")
        return groups.join(ends.select("grp", "blocks"), "grp")

    def asked(rows: DataFrame, at: int) -> DataFrame:
        rows = rows.join(sets.select("set", "n", "sketch"), "set")
        return compared(rows.withColumn("done", F.lit(False)).withColumn("extra", F.lit(0)), percent, at, ["set"])

    def led(groups: DataFrame) -> DataFrame:
        # written once, as it is read twice
        placed = marked(groups) if labels is None else settle(marked(groups), "marked")
        order = F.struct(F.xxhash64("set", F.lit(turn)).alias("h"), F.col("set").alias("set"), F.col("mark").alias("mark"))
        heads = placed.groupBy("grp").agg(F.min(order).alias("head"))
        pairs = placed.join(heads, "grp").where(F.col("mark") != F.col("head.mark")).select(F.col("set").alias("a"), F.col("head.set").alias("b")).distinct()
        return possible(pairs, sets, percent).withColumn("grp", F.lit(None).cast("long"))

    while few is not None or crowd is not None:
        parts = []
        if few is not None:
            parts.append(asked(alone(marked(few)), turn))
        if turn < LEADERS:
            parts.append(led(hot))
        elif crowd is not None:
            # written once, so that neither its use here nor the next round joins the members anew
            placed = settle(marked(crowd), "marked")
            rest = settle(still_open(placed, more if turn > LEADERS else None), "crowd")
            forget(placed)
            if crowd is not hot:
                forget(crowd)
            parts.append(asked(units(rest), turn - LEADERS))
            crowd = rest
        found = reduce(DataFrame.unionAll, [settle(p, "pairs") for p in parts])
        if texts is None:
            texts = fetch(found.where("a IS NOT NULL").select(F.col("a").alias("set")).union(hot.select("set")).distinct())
        more = found.where("a IS NULL").select("grp").distinct()
        n_pairs, n_more = found.agg(F.count("b"), F.count(F.when(F.col("a").isNull(), 1))).first()
        if n_pairs:
            fresh = settle(verified(found.where("b IS NOT NULL").select("a", "b").distinct(), texts, k, percent), "verified")
            # the components so far stand for the links that made them
            labels = components(fresh if labels is None else labels.toDF("a", "b").unionAll(fresh), "a", "b")
        few = None if few is None or not n_more else small.join(more, "grp", "left_semi")
        if turn >= LEADERS and not n_more:
            crowd = None
        turn += 1
    if labels is None:
        return small.select(F.col("set").alias("node"), F.col("set").alias("component")).limit(0)
    return labels


@modest
@scratched
def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block: int = BLOCK, few: int = SMALL) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the set's size and the smallest key reachable by links.

    Two rows link when 100 * intersection >= percent * union of their sets of k-word shingles;
    with fewer words the whole sequence is the one shingle; rows without words or text have
    size 0 and link with nothing. Rows with equal sets link. Null keys link like any other; a
    component of null keys alone has a null id. All links are found; copies are not expanded into pairs.
    block and few only set how groups are dealt out.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = df.select(df[key].cast("long").alias("doc"), df[text].cast("string").alias("text"))
    own = own.withColumn("rid", F.xxhash64("doc", "text"))
    rows = candidates(own, k, percent, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), few)
    docs = settle(rows.where(F.col("grp").isNull()).select("doc", "n", "set"), "docs")
    sets = settle(rows.where("grp IS NULL AND n > 0").groupBy("set").agg(F.min("doc").alias("least"), F.min(F.struct("doc", "rid")).alias("at"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "sets")
    groups = rows.where(F.col("grp").isNotNull())
    small = settle(groups.where(~F.col("hot")).select("grp", "set").distinct(), "small")
    hot = settle(infrequent(groups.where("hot").select("grp", "set", "info")), "hot")
    forget(rows)
    keyed = own.withColumnRenamed("rid", "_rid").withColumnRenamed("doc", "_doc")

    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = settle(wanted.join(sets, "set").select("set", "at.doc", F.col("at.rid").alias("_rid")), "wanted")
        asked = wanted.withColumnRenamed("_rid", "rid").hint("merge")
        texts = wanted_rows(keyed, wanted, "_rid").join(asked, (F.col("_rid") == F.col("rid")) & F.col("_doc").eqNullSafe(F.col("doc")))
        return settle(texts.select("set", "text").dropDuplicates(["set"]), "texts")

    labels = connections(small, hot, sets, fetch, k, percent, block)
    # a component may hold a large part of all sets: its least key comes from partial minima and goes back salted
    named = settle(labels.join(sets.select("set", F.col("least").alias("doc")), F.col("node") == F.col("set")).select("node", "component", "doc", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")), "named")
    extra = labels.select("component").distinct().join(sets.select("set", F.col("least").alias("doc")), F.col("component") == F.col("set")).select("component", "doc")
    least = named.select("component", "doc").union(extra).groupBy("component").agg(F.min("doc").alias("component_id"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ids = named.join(salted, ["component", "salt"]).select("node", "component_id").union(least.select("component", "component_id"))
    least_doc = sets.select("set", F.col("least").alias("doc")).join(ids, F.col("set") == F.col("node"), "left")
    named_sets = least_doc.select(F.col("set").alias("_set"), F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    out = docs.select("doc", "n", "set").join(named_sets, (F.col("set") == F.col("_set")) & (F.col("n") > 0), "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
