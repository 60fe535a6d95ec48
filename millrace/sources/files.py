"""Rows by file suffix, indexes, splits, manifests with their own hash, checks before a run, front matter, and chunks of a folder of sources."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.errors import HashMismatch, InvalidRecord, PreflightFailure
from millrace.operators.code import chunk_sources
from millrace.operators.mining import python_files
from millrace.operators.normalise import normalise_chunks

# Fixed values.
ZERO_HASH = "0" * 64
FRONT_MATTER = r"\A---\s*\n(.*?)\n---\s*\n"
KEY_VALUE = r"^([A-Za-z_][A-Za-z0-9_]*):\s*(.*?)\s*$"
MANIFEST_VERSION = "v1"
SEQUENCES = "repo string, file_path string, context_ids array<array<int>>, target_ids array<int>, intent_idx tinyint, sequence_id string"
SPLITS = ("train", "val", "test")
BASELINES = ("bm25", "mlm_encoder", "codebert")


def load_rows(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Rows of a .jsonl (blank lines are skipped) or .parquet path; another suffix is an error."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".parquet"):
        return reader.parquet(path)
    raise ValueError(f"neither .jsonl nor .parquet: {path}")


def write_rows(df: DataFrame, path: str, schema: StructType | None = None) -> None:
    """The rows, cast to the schema where one is given, as .jsonl or .parquet; nothing is overwritten."""
    if schema is not None:
        df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    if path.endswith(".jsonl"):
        df.write.option("ignoreNullFields", "false").json(path)
    elif path.endswith(".parquet"):
        df.write.parquet(path)
    else:
        raise ValueError(f"neither .jsonl nor .parquet: {path}")


def manifest_hash(manifest: dict) -> str:
    """Over the canonical JSON of the manifest with its own hash set to zeros."""
    text = json.dumps({**manifest, "manifest_hash": ZERO_HASH}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def make_manifest(repos: list[dict], cutoff: datetime.datetime, chunker_version: str = "v1", tokenizer_hash: str = ZERO_HASH, scanner_version: str = "v1", splits_path: str = "data/splits/v1.lock.json", now: datetime.datetime | None = None) -> dict:
    """A manifest of the repositories. cutoff is exclusive; the manifest names the last second before it."""
    stamp = "%Y-%m-%dT%H:%M:%SZ"
    out = {
        "schema_version": MANIFEST_VERSION, "manifest_hash": ZERO_HASH, "generated_at": (now or datetime.datetime.now(datetime.UTC)).strftime(stamp),
        "chunker_version": chunker_version, "tokenizer_hash": tokenizer_hash, "secrets_scanner_version": scanner_version, "splits_path": splits_path,
        "commit_cutoff_utc": (cutoff - datetime.timedelta(seconds=1)).strftime(stamp), "repos": [dict(r) for r in repos],
    }
    return {**out, "manifest_hash": manifest_hash(out)}


def verified_manifest(text: str) -> dict:
    """A manifest's content; an error if it is no object or its hash is not that of its content."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise InvalidRecord("a manifest is an object")
    if found.get("manifest_hash") != manifest_hash(found):
        raise HashMismatch("the manifest's hash is not that of its content")
    return found


def front_matter(text: str) -> dict[str, str]:
    """The flat key: value lines between the two marks at the beginning; comments and blank lines are skipped, one layer of quotes goes."""
    found = re.match(FRONT_MATTER, text, re.DOTALL)
    if found is None:
        raise InvalidRecord("no front matter")
    out = {}
    for line in (x.strip() for x in found.group(1).splitlines()):
        if not line or line.startswith("#"):
            continue
        pair = re.match(KEY_VALUE, line)
        if pair is None:
            raise InvalidRecord(f"not a flat key: value line: {line}")
        key, value = pair.groups()
        quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'"
        out[key] = value[1:-1] if quoted else value
    return out


def chunk_repo(spark: SparkSession, root: str, subset: tuple[str, ...] = ()) -> DataFrame:
    """(path, qualname, kind, start_line, end_line, source, normalised) of the chunks of a folder's sources; those without a normal form are dropped."""
    return normalise_chunks(chunk_sources(python_files(spark, root, subset), "path", "text"))


def write_sequences(df: DataFrame, path: str) -> None:
    """Sequences with their fixed schema; other columns are left out."""
    write_rows(df, path, StructType.fromDDL(SEQUENCES))


def write_splits(df: DataFrame, folder: str, split: str = "split") -> None:
    """One Parquet folder a split, in one pass; rows without a split go to none of the known ones."""
    df.write.partitionBy(split).parquet(folder)


def load_splits(spark: SparkSession, folder: str, split: str = "split") -> dict[str, DataFrame]:
    """The rows of each split that the folder has; an error where it has none. Only a split's own files are read."""
    rows = spark.read.parquet(folder)
    found = {r[split] for r in rows.select(split).where(F.col(split).isin(*SPLITS)).distinct().collect()}
    if not found:
        raise ValueError(f"no split in {folder}")
    return {s: rows.where(F.col(split) == s).drop(split) for s in SPLITS if s in found}


def write_index(df: DataFrame, folder: str, index_id: str, key: str = "chunk_id", vector: str = "vector", source: str = "source") -> str:
    """The vectors of an exact index, with their keys and sources, under the index's name; an index is never overwritten."""
    path = f"{folder}/index_id={index_id}"
    df.select(F.col(key).alias("chunk_id"), F.col(source).cast("string").alias("source"), F.col(vector).cast("array<float>").alias("vector")).write.parquet(path)
    return path


def load_index(spark: SparkSession, folder: str, index_id: str, checkpoint: str | None = None, manifest: str | None = None) -> DataFrame:
    """(chunk_id, source, vector) of an index named checkpoint-manifest; an error if a half does not begin with the expected prefix."""
    built_by, _, built_on = index_id.partition("-")
    for what, expected, stored in (("checkpoint", checkpoint, built_by), ("manifest", manifest, built_on)):
        if expected is not None and not stored.startswith(expected):
            raise HashMismatch(f"the index is of {what} {stored!r}, not {expected!r}")
    return spark.read.parquet(f"{folder}/index_id={index_id}")


def human_scores(folder: str) -> dict:
    """What the annotators' file states; nulls and a status where it is absent or empty. Agreement is read, not computed."""
    path = Path(folder) / "human_annotations.json"
    found = json.loads(path.read_text()) if path.exists() else {}
    if not found:
        return {"mean_likert": None, "cohen_kappa": None, "status": "no_human_annotations"}
    return {"mean_likert": float(found.get("mean_likert", 0.0)), "cohen_kappa": float(found.get("cohen_kappa", 0.0)), "status": "ok"}


def preflight(manifest_path: str, baselines_path: str | None = None) -> dict[str, bool]:
    """The checks before a training run, all of them done before an error names those that failed.

    The manifest is there and, where it carries repositories and a hash, true to it; audits
    embedded in it pass all gates; the file of baseline figures, where one is asked for, parses.
    """
    manifest = _json(manifest_path)
    valid = manifest is not None
    if isinstance(manifest, dict) and {"manifest_hash", "repos"} <= set(manifest):
        valid = manifest["manifest_hash"] == manifest_hash(manifest)
    audits = manifest.get("audits") if isinstance(manifest, dict) else None
    checks = {
        "manifest_exists_and_valid": valid,
        "audit_gates": valid and _audits_pass(audits),
        "baseline_metrics": baselines_path is None or _json(baselines_path) is not None,
    }
    if failed := [name for name, passed in checks.items() if not passed]:
        raise PreflightFailure(failed)
    return checks


def missing_baselines(folder: str) -> list[str]:
    """The baselines whose results.json the folder lacks; a run starts only where there is none."""
    return [name for name in BASELINES if not (Path(folder) / name / "results.json").exists()]


def _json(path: str) -> object:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, json.JSONDecodeError):
        return None


def _audits_pass(audits: object) -> bool:
    """No audits, or paths of audits, assert nothing; an embedded audit must say that it passes."""
    if not audits:
        return True
    if not isinstance(audits, dict | list):
        return False
    entries = list(audits.values()) if isinstance(audits, dict) else audits
    known = isinstance(audits, dict) or all(isinstance(e, dict | str) for e in entries)
    return known and all(e.get("passes_all_gates", False) for e in entries if isinstance(e, dict))
