"""The walk through commits: changed definitions of nested files, in order, up to a number of pairs."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from millrace.operators import mining
from millrace.operators.normalise import changed_nodes
from millrace.session import scratched, settle

# Fixed values.
NO_PARENT = "0" * 40

FILES = "array<struct<old_path: string, new_path: string, source_before: string, source: string>>"
#: Commits of the first slice that is walked; later ones are twice as long each.
FIRST_SLICE = 100_000


class ChangedNodes:
    """A table function: the definitions of both sides of a file whose normal forms differ, by name."""

    def eval(self, before: str | None, after: str | None) -> Iterator[tuple[str, str, str]]:
        for node in changed_nodes(before, after):
            yield node["qualname"], node["before"], node["after"]


def changed_nodes_function():
    return F.udtf(ChangedNodes, returnType="node_qualname string, source_before string, source_after string", useArrow=True)


def eligible(commits: DataFrame, cutoff: datetime.datetime = mining.CUTOFF) -> DataFrame:
    """Commits before the cutoff (those without a date as well) that are no merge, no bot's, and without a dropped word."""
    return commits.where(mining.before_cutoff(F.col("author_date"), cutoff) & mining.commit_passes(F.col("merge"), F.col("author"), F.col("message")))


def changed_files(commits: DataFrame) -> DataFrame:
    """One row per file of a commit that is Python by its later path and has both sides, numbered in the commit's order."""
    rest = [c for c in commits.columns if c != "modified_files"]
    files = commits.select(*rest, F.posexplode("modified_files").alias("file_number", "_f"))
    passes = mining.file_passes(F.col("_f.new_path"), F.col("_f.old_path"), F.col("_f.source_before"), F.col("_f.source"))
    path = F.coalesce(F.nullif("_f.new_path", F.lit("")), F.col("_f.old_path"))
    return files.where(passes).select(*rest, "file_number", path.alias("file_path"), F.col("_f.source_before").alias("_before"), F.col("_f.source").alias("_after"))


def pairs_of(commits: DataFrame) -> DataFrame:
    """(the commit's order and repo, commit_sha_before, commit_sha_after, file_path, node_qualname, source_before, source_after, commit_message).

    Files are joined laterally with the table function. Equal sides never reach Python. Parsing
    costs far more than moving a file, so files are dealt evenly first, those of one commit too.
    """
    tasks = int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = changed_files(commits).where(mining.content_passes(F.col("_before"), F.col("_after"))).repartition(tasks, "position", "file_number")
    nodes = changed_nodes_function()(F.col("_before").outer(), F.col("_after").outer())
    parent = F.coalesce(F.nullif(F.try_element_at("parents", F.lit(1)), F.lit("")), F.lit(NO_PARENT))
    return files.lateralJoin(nodes).select(
        "repo", "position", "file_number", parent.alias("commit_sha_before"), F.coalesce("hash", F.lit("")).alias("commit_sha_after"), "file_path", "node_qualname", "source_before", "source_after", F.coalesce("message", F.lit("")).alias("commit_message")
    )


def _position(commits: DataFrame, sha: str) -> int:
    found = commits.where(F.col("hash") == sha).agg(F.min("position")).first()[0]
    if found is None:
        raise KeyError(f"no commit {sha}")
    return found


def _boundary(left: DataFrame, size: int) -> int | None:
    """The position of the size-th commit, or None where there are fewer: sorted by position alone, without the sources."""
    rows: list[Row] = left.select("position").orderBy("position").offset(size - 1).limit(1).collect()
    return rows[0]["position"] if rows else None


@scratched
def walk(commits: DataFrame, max_pairs: int | None = mining.MAX_PAIRS, from_commit: str | None = None, to_commit: str | None = None, cutoff: datetime.datetime = mining.CUTOFF, first_slice: int = FIRST_SLICE) -> DataFrame:
    """The first max_pairs pairs of one repository's history, by commit, file and name.

    commits: repo, position (a unique long, oldest first), hash, parents, author, author_date,
    merge, message, modified_files (FILES). A root commit's parent is 40 zeros; null files,
    sides, names and messages are none. Both ends of the asked commits count; an unknown one is
    an error. How many pairs a commit holds is known only once it is parsed: slices of the
    history, each twice as long as the one before, are parsed by all tasks until there are
    enough pairs, so the rest of a long history is never read. With max_pairs None all pairs
    are wanted: the history is parsed at once, and its pairs are in no order.
    """
    if max_pairs is not None and max_pairs < 1:
        raise ValueError("max_pairs must be positive")
    own = commits
    if from_commit is not None:
        own = own.where(F.col("position") >= _position(commits, from_commit))
    if to_commit is not None:
        own = own.where(F.col("position") <= _position(commits, to_commit))
    if max_pairs is None:
        return pairs_of(eligible(own, cutoff))
    left, size, found, done = eligible(own, cutoff), first_slice, 0, []
    while True:
        end = _boundary(left, size)
        part = settle(pairs_of(left if end is None else left.where(F.col("position") <= end)), "walked")
        done.append(part)
        found += part.count()
        if end is None or found >= max_pairs:
            break
        left, size = left.where(F.col("position") > end), size * 2
    pairs = done[0]
    for other in done[1:]:
        pairs = pairs.unionByName(other)
    return mining.first_pairs(pairs, ["position", "file_number", "node_qualname"], max_pairs)


def as_pair(pairs: DataFrame) -> DataFrame:
    """The columns of a raw pair, without the place in the walk."""
    return pairs.drop("position", "file_number")


def position_of(date: Column, key: Column) -> Column:
    """A unique long that orders commits by date, equal dates by a small key."""
    return F.unix_micros(date) * 1000 + key % 1000
