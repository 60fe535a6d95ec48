"""Connected components of a graph given as pairs of 64-bit integers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import scratched, settle


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node reachable from each), by hooking roots and halving paths."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        low, high = np.minimum(px, py), np.maximum(px, py)
        apart = low != high
        if not apart.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's links as one link per node at most, folded batch by batch."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        nodes, roots = local_components(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
        own = nodes != roots
        a, b = nodes[own], roots[own]
    for at in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["u", "v"])


#: Links that one task folds at once, about 16 bytes each.
WHOLE = 1_000_000


@scratched
def components(links: DataFrame, a: str, b: str, whole: int = WHOLE) -> DataFrame:
    """(node, component) of every node with a link: component is the smallest node reachable.

    Each partition first folds its links into stars. If no more than ``whole`` links are left,
    one task folds them all. Otherwise large-star and small-star steps
    alternate until nothing changes, about as often as the logarithm of the longest path; each
    round is written to the shared folder. Neighbours of a node are never gathered: a round
    takes minima with map-side combination and joins them back, which AQE can split where a
    node has many neighbours. Links with a null end are left out; self-links alone give no row.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now, seen = settle(pairs.mapInArrow(_stars, "u long, v long"), "links"), None
    if now.limit(whole + 1).count() <= whole:
        # a forest that one task folds in a few MB needs no rounds
        return now.repartition(1).mapInArrow(_stars, "u long, v long").toDF("node", "component")
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        now = settle(small, "links")


#: Rounds of leaders before all untried pairs of groups that are still apart are listed.
ROUNDS = 4


@scratched
def connect(groups: DataFrame, verify: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of the sets that link with others, given candidate groups (set, entry).

    Any two sets with a common entry are candidates; verify(pairs of (a, b)) returns those
    that link. Not all pairs of a group are tried: each set is held against a leader or two
    of its groups, what links is contracted, and only pairs that a group still leaves in
    different components go on, until none is untried. So no link between components is lost,
    and a group of copies of any size costs about one comparison a member and round.
    """
    links: DataFrame | None = None
    tried: DataFrame | None = None
    labels: DataFrame | None = None
    for turn in range(rounds + 1):
        if labels is None:
            placed = groups.withColumn("component", F.col("set"))
        else:
            placed = groups.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        order = F.struct(F.xxhash64("set", F.lit(turn)).alias("h"), F.col("set").alias("set"), F.col("component").alias("component"))
        ends = placed.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(order).alias("first"), F.max(order).alias("last"))
        open_ = ends.where("low <> high").select("entry", "first", "last")
        if turn < rounds:
            ask = placed.join(open_, "entry")
            one = ask.where(F.col("component") != F.col("first.component")).select(F.col("set").alias("a"), F.col("first.set").alias("b"))
            two = ask.where(F.col("component") != F.col("last.component")).select(F.col("set").alias("a"), F.col("last.set").alias("b"))
            # of the leaders that a set meets in its groups, one
            pairs = one.groupBy("a").agg(F.min("b").alias("b")).union(two.groupBy("a").agg(F.max("b").alias("b"))).distinct()
        else:
            left = placed.join(open_.select("entry"), "entry", "left_semi")
            right = left.select("entry", F.col("set").alias("b"), F.col("component").alias("other"))
            pairs = left.join(right, "entry").where((F.col("set") < F.col("b")) & (F.col("component") != F.col("other"))).select(F.col("set").alias("a"), "b").distinct()
        if tried is not None:
            both = tried.select("a", "b").union(tried.select("b", "a"))
            pairs = pairs.join(both, ["a", "b"], "left_anti")
        pairs = settle(pairs, "pairs")
        if not pairs.isEmpty():
            found = settle(verify(pairs), "verified")
            tried = pairs if tried is None else tried.union(pairs)
            links = found if links is None else links.union(found)
            labels = components(links, "a", "b")
    if labels is None:
        return groups.select(F.col("set").alias("node"), F.col("set").alias("component")).limit(0)
    return labels
