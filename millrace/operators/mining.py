"""Scanning sources and filtering commits."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
CUTOFF = datetime.datetime(2024, 1, 1)
BOTS = ("dependabot[bot]", "pre-commit-ci[bot]", "github-actions[bot]", "renovate[bot]")
DROPPED_WORDS = ("wip", "temp", "revert", "formatting only", "lint only", "style only", "typo")
EXCLUDED_SEGMENTS = ("vendor", "third_party", "_vendor")
GENERATED_MARK, GENERATED_CHARS = "# DO NOT EDIT", 4096
MAX_PAIRS = 200_000


def excluded_path(path: Column) -> Column:
    """A path with an excluded segment, or of generated protocol code."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(s) for s in EXCLUDED_SEGMENTS])) | F.endswith(path, F.lit("_pb2.py"))


def generated(text: Column) -> Column:
    return F.coalesce(F.contains(F.substring(text, 1, GENERATED_CHARS), F.lit(GENERATED_MARK)), F.lit(False))


def under_roots(path: Column, roots: Column) -> Column:
    """Below one of the roots; no roots means everything."""
    return (F.coalesce(F.size(roots), F.lit(0)) <= 0) | F.exists(roots, lambda r: F.startswith(path, F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/"))))


def python_files(spark: SparkSession, root: str, subset: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of the .py files below root, by their path within it, that lie below one of the subset's roots (all, if
    there is none) and are neither excluded nor generated; files that are not UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    base = F.lit(spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/").toUri().getPath().rstrip("/") + "/")
    rows = files.select(F.substring_index("path", ":", -1).alias("_at"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where(F.col("text").isNotNull())
    # the reader writes file:/x, file:///x or scheme://host/x
    rows = rows.select(F.substring(F.col("_at"), F.instr(F.col("_at"), base) + F.length(base), F.length("_at")).alias("path"), "text")
    return rows.where(~excluded_path(F.col("path")) & ~generated(F.col("text")) & under_roots(F.col("path"), F.array(*[F.lit(r) for r in subset]).cast("array<string>")))


def before_cutoff(date: Column, cutoff: datetime.datetime = CUTOFF) -> Column:
    return date.isNull() | (date < F.lit(cutoff).cast("timestamp_ntz"))


def commit_passes(merge: Column, author: Column, message: Column) -> Column:
    """Neither a merge, nor a bot's, nor with a dropped word anywhere in the message, even inside another word."""
    words = "|".join(w.replace("[", r"\[") for w in DROPPED_WORDS)
    return ~F.coalesce(merge, F.lit(False)) & ~F.coalesce(author, F.lit("")).isin(*BOTS) & ~F.lower(F.coalesce(message, F.lit(""))).rlike(words)


def file_passes(new_path: Column, old_path: Column, before: Column, after: Column) -> Column:
    path = F.coalesce(F.nullif(new_path, F.lit("")), old_path)
    return F.endswith(path, F.lit(".py")) & before.isNotNull() & after.isNotNull()


def content_passes(before: Column, after: Column) -> Column:
    return before.isNotNull() & after.isNotNull() & (before != after)


def first_pairs(df: DataFrame, order: list[str], most: int = MAX_PAIRS) -> DataFrame:
    return df.orderBy(*order).limit(most)


def cutoff_text(cutoff: datetime.datetime = CUTOFF) -> str:
    """The last second before the cutoff, as manifests state it."""
    return (cutoff - datetime.timedelta(seconds=1)).strftime("%Y-%m-%dT%H:%M:%SZ")


def new_keys(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The rows whose key the target does not have yet."""
    return df.join(target.select(key), key, "left_anti")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by map-side maxima."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def upsert(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target with the changes' values where there are some; a change without a row in the target is an error."""
    lost = changes.join(target.select(key), key, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(lost[0][key])
    named = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(named, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(order)))
