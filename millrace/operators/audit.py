"""Per-repository audits and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import GateFailure
from millrace.functions.text import SECRETS, tokens

# Fixed values.
LICENSES = ("PSF-2.0", "BSD-3-Clause", "MIT", "Apache-2.0")
COMPILE_MIN, DUPLICATION_MAX = 0.95, 0.30
GATES = ("compile_gate", "duplication_gate", "license_gate", "secrets_gate")


def audit(df: DataFrame, repo: str) -> DataFrame:
    """One row per repository, in one aggregation.

    df has, per chunk: n_tokens, file_path, parse_failed, over_cap, duplicate, license and
    n_secrets. Rates over no rows are 0; the median token length is cut to a whole number.
    """
    failed, over = F.sum(F.col("parse_failed").cast("int")), F.sum(F.col("over_cap").cast("int"))
    good = F.count(F.lit(1)) - failed
    whole = F.count(F.lit(1))
    out = df.groupBy(repo).agg(
        good.cast("long").alias("chunk_count"),
        F.coalesce(F.median(F.when(~F.col("parse_failed"), F.col("n_tokens"))).cast("long"), F.lit(0)).alias("median_tokens"),
        F.countDistinct(F.nullif(F.col("file_path"), F.lit(""))).alias("file_count"),
        (failed / whole).alias("parse_fail_rate"),
        F.when(good + over > 0, over / (good + over)).otherwise(F.lit(0.0)).alias("over_cap_rate"),
        F.avg(F.col("duplicate").cast("double")).alias("duplication_rate"),
        F.min("license").alias("license"),
        F.sum("n_secrets").cast("long").alias("secrets"),
    )
    out = out.withColumn("compile_ok", 1 - F.col("parse_fail_rate"))
    return with_gates(out)


def with_gates(audits: DataFrame, compile_ok: str = "compile_ok", duplication: str = "duplication_rate", license: str = "license", secrets: str = "secrets") -> DataFrame:
    """audits with the four gates and whether all pass; a null figure does not pass."""
    gates = dict(zip(GATES, (F.col(compile_ok) >= COMPILE_MIN, F.col(duplication) < DUPLICATION_MAX, F.col(license).isin(*LICENSES), F.col(secrets) == 0), strict=True))
    judged = audits.withColumns({name: F.coalesce(passes, F.lit(False)) for name, passes in gates.items()})
    return judged.withColumn("gates_pass", F.col("compile_gate") & F.col("duplication_gate") & F.col("license_gate") & F.col("secrets_gate"))


def token_length(ids: Column, text: Column) -> Column:
    """How many ids a chunk has; without ids its words; null, and so in no median, for a chunk without either."""
    return F.when(ids.isNotNull(), F.size(ids)).when(F.coalesce(text, F.lit("")) != "", F.size(tokens(text)))


def boilerplate(path: Column, source: Column) -> Column:
    """A copied template: a package file of nothing but imports and names, a setup file of nothing but its call, a list of exports, or an exported one-line lambda."""
    body = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?m)^[ \t]*(?:#[^\n]*)?$\n?", "")
    named = r"__(?:all|version|author)__\s*=\s*(?:\[[^\]]*\]|\([^)]*\)|[^\n\[(]+)"
    imported = r"(?:from\s+\S+\s+)?import\s+(?:\([^)]*\)|[^\n(]+)"
    of_package = F.endswith(path, F.lit("__init__.py")) & body.rlike(rf"\A(?:(?:{imported}|{named}|\"<DOC>\")\n*)*\z")
    of_setup = F.endswith(path, F.lit("setup.py")) & body.rlike(rf"\A(?:{imported}\n+)*(?:setuptools\.)?setup\((?s:.*)\)\n*\z")
    exports = body.rlike(r"\A__all__\s*\+?=\s*(?:\[[^\]]*\]|\([^)]*\))\n*\z")
    function = body.rlike(r"\A\w+\s*=\s*lambda\b[^\n]*\n*\z")
    return F.coalesce(of_package, F.lit(False)) | F.coalesce(of_setup, F.lit(False)) | exports | function


def gate_failures(audits: DataFrame, repo: str) -> DataFrame:
    """(repo, gate) of every gate that failed."""
    parts = ", ".join(f"'{g}', {g}" for g in GATES)
    return audits.selectExpr(repo, f"stack({len(GATES)}, {parts}) AS (gate, passed)").where("NOT passed").select(repo, "gate")


def check_all_gates(audits: DataFrame, repo: str) -> None:
    failed = [(r[0], r[1]) for r in gate_failures(audits, repo).orderBy(repo, "gate").collect()]
    if failed:
        raise GateFailure(failed)


def intent_counts(df: DataFrame, repo: str, intent: str) -> DataFrame:
    """(repo, per_intent map) with missing intents as "unknown"."""
    each = df.groupBy(repo, F.coalesce(intent, F.lit("unknown")).alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(repo).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_i", "_n")))).alias("per_intent"))


def secret_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern_name, match_preview): the first 8 characters of every match of every pattern."""
    def hits(name: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({pattern})"), 1)
        return F.transform(found, lambda m: F.struct(F.lit(name).alias("pattern_name"), F.substring(m, 1, 8).alias("match_preview")))

    found = [hits(*s) for s in SECRETS]
    return df.select(key, F.explode(F.concat(*found)).alias("h")).select(key, "h.pattern_name", "h.match_preview")
