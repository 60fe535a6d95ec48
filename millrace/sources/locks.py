"""Pools and audits as JSON records of a folder: written once, and read back with their rules, hashes and gates checked again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import HashMismatch, InvalidRecord
from millrace.operators.audit import with_gates
from millrace.operators.governance import violations
from millrace.sources.loose import load_records

VERSION = "v1"
_NAME = {"type": "string", "pattern": r"^v\d+(\.\d+)?$"}
_COUNT = {"type": "integer", "minimum": 0}
_RATE = {"type": "number", "minimum": 0, "maximum": 1}

# The fields of a pool and of an audit, and what holds for each.
POOL = {"schema_version": _NAME, "benchmark": {"type": "string"}, "pool_size": {"type": "integer", "minimum": 1}, "chunk_ids": {"type": "array", "items": {"type": "string"}}, "pool_hash": {"type": "string", "pattern": "^[0-9a-f]{64}$"}}
AUDIT = {
    "schema_version": _NAME,
    "repo": {"type": "string"},
    "commit_sha": {"type": "string", "pattern": "^[0-9a-f]{40}$"},
    "license_spdx": {"type": "string"},
    "py_files_in_scope": _COUNT,
    "chunk_count": _COUNT,
    "median_chunk_token_len": _COUNT,
    "drop_rate_over_cap": _RATE,
    "drop_rate_parse_fail": _RATE,
    "duplication_rate": _RATE,
    "secret_scanner_hits": _COUNT,
    "compile_ok_rate": _RATE,
    "per_intent_pair_count": {"type": "object", "additionalProperties": _COUNT},
}
_POOL_ROW = "schema_version string, benchmark string, pool_size int, chunk_ids array<string>, pool_hash string"
_AUDIT_ROW = "schema_version string, repo string, commit_sha string, license_spdx string, py_files_in_scope long, chunk_count long, median_chunk_token_len long, drop_rate_over_cap double, drop_rate_parse_fail double, duplication_rate double, secret_scanner_hits long, compile_ok_rate double, per_intent_pair_count map<string, long>"


def _schema(fields: dict) -> dict:
    return {"type": "object", "required": list(fields), "additionalProperties": False, "properties": fields}


def pool_hash(ids):
    """Of the ids in the order they are in, which is ascending in a pool."""
    return F.sha2(F.array_join(ids, ","), 256)


def write_pools(pools: DataFrame, path: str, benchmark: str = "benchmark", ids: str = "chunk_ids") -> None:
    """One line of JSON a pool, its ids ascending and without repeats, with its size and hash. A pool is a bounded sample; nothing is overwritten."""
    own = pools.select(F.col(benchmark).cast("string").alias("benchmark"), F.array_sort(F.array_distinct(F.col(ids).cast("array<string>"))).alias("chunk_ids"))
    own.select(F.lit(VERSION).alias("schema_version"), "benchmark", F.size("chunk_ids").alias("pool_size"), "chunk_ids", pool_hash(F.col("chunk_ids")).alias("pool_hash")).write.json(path)


def _checked(spark: SparkSession, path: str, row: str, fields: dict, lines: bool) -> DataFrame:
    texts = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).where(F.trim("text") != "")
    broken = violations(texts, "file", "text", _schema(fields)).limit(1).collect()
    if broken:
        raise InvalidRecord(f"{broken[0]['file']}: {broken[0]['path']} breaks {broken[0]['rule']}")
    return load_records(spark, path, row, lines)[0]


def load_pools(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """The pools of a folder, a line or (without ``lines``) a file each. An error names the first that breaks a rule or whose hash is not that of its ids."""
    pools = _checked(spark, path, _POOL_ROW, POOL, lines)
    forged = pools.where(pool_hash(F.col("chunk_ids")) != F.col("pool_hash")).select("benchmark").limit(1).collect()
    if forged:
        raise HashMismatch(f"pool {forged[0][0]}: the hash is not that of its ids")
    return pools


def write_audits(audits: DataFrame, path: str) -> None:
    """One line of JSON an audit, with the fields of AUDIT and none of the gates, which follow from them."""
    audits.select(*[F.col(f) for f in AUDIT]).write.json(path)


def load_audits(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """The audits of a folder with their gates taken anew from the figures. An error names the first that breaks a rule."""
    audits = _checked(spark, path, _AUDIT_ROW, AUDIT, lines)
    return with_gates(audits, compile_ok="compile_ok_rate", duplication="duplication_rate", license="license_spdx", secrets="secret_scanner_hits")
