"""Record validation, log rules and invariants across tables: each check is a query for violations."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import HashMismatch

# Fixed values.
LEVELS = ("debug", "info", "warn", "error")
EVENTS = (
    "data.mirror.repo",
    "data.chunk.file",
    "data.dedup.cluster",
    "data.audit.repo",
    "train.step",
    "train.eval_probe",
    "train.rank_diagnostic",
    "train.checkpoint.write",
    "train.gate.failed",
    "inference.embed",
    "inference.retrieve",
    "inference.rerank",
    "inference.refusal",
    "inference.success",
    "eval.benchmark.start",
    "eval.benchmark.done",
    "eval.harness.done",
    "eval.sandbox.run",
    "safety.checker.fired",
    "log.dropped",
)


_HITS = "array<struct<path: string, rule: string>>"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _keys(variant: Column) -> Column:
    """An object's keys; null for anything else."""
    return F.map_keys(F.try_variant_get(variant, "$", "map<string, variant>"))


def schema_rules(schema: dict, own: Column) -> list[tuple[str, str, Column]]:
    """(path below the value, rule, broken) of what a JSON schema asks of a value itself, given as (v, found, text, keys), see ``value_hits``."""
    rules: list[tuple[str, str, Column]] = []
    kind, found, text = schema.get("type"), own["found"], own["text"]
    if kind:
        wanted = {
            "string": found == "STRING",
            "integer": found.isin("BIGINT") | found.rlike(r"^DECIMAL\(\d+,0\)$"),
            "number": found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
            "boolean": found == "BOOLEAN",
            "array": found.rlike("^ARRAY"),
            "object": found.rlike("^(OBJECT|STRUCT)"),
            "null": found == "VOID",
        }
        any_of = reduce(lambda x, y: x | y, [wanted[k] for k in (kind if isinstance(kind, list) else [kind])])
        rules.append(("", "type", ~F.coalesce(any_of, F.lit(False))))
    if "enum" in schema:
        rules.append(("", "enum", ~F.coalesce(text.isin(*[str(e) for e in schema["enum"]]), F.lit(False))))
    if "pattern" in schema:
        rules.append(("", "pattern", ~F.coalesce(text.rlike(schema["pattern"]), F.lit(False))))
    number = F.when(found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(own["v"], "$", "double"))
    for name, test in (("minimum", lambda x, b: x < b), ("maximum", lambda x, b: x > b)):
        if name in schema:
            rules.append(("", name, F.coalesce(test(number, schema[name]), F.lit(False))))
    for name, test in (("minLength", lambda x, b: x < b), ("maxLength", lambda x, b: x > b)):
        if name in schema:
            rules.append(("", name, F.coalesce(test(F.length(text), schema[name]), F.lit(False))))
    for name in schema.get("required", []):
        # asked of objects only: what is none breaks the type
        rules.append((f".{name}", "required", F.coalesce(~F.array_contains(own["keys"], name), F.lit(False))))
    if schema.get("additionalProperties") is False:
        extra = F.array_except(F.coalesce(own["keys"], F.array().cast("array<string>")), F.array(*[F.lit(f) for f in schema.get("properties", {})]).cast("array<string>"))
        rules.append(("", "additionalProperties", F.size(extra) > 0))
    return rules


def _hits(rules: list[tuple[str, str, Column]], path: Column) -> Column:
    """The broken rules as an array of (path, rule), below a path."""
    found = [F.when(broken, F.struct(F.concat(path, F.lit(p)).alias("path"), F.lit(r).alias("rule"))) for p, r, broken in rules]
    return F.filter(F.array(*found), lambda h: h.isNotNull())


def value_hits(schema: dict, variant: Column, path: Column, keys: Column | None = None) -> Column:
    """An array of (path, rule) of all broken rules of a JSON schema in a value and inside it, at any depth.

    Supported: type (one or a list), enum, required, properties, additionalProperties (false, or
    a schema), items, pattern, minimum, maximum, minLength, maxLength. Elements are named by their
    place: $.a[3].b. A value's type, text and keys are worked out once, and what is inside it is
    taken out as a variant: nothing is parsed again, and no row is made for an element.
    """
    fields, items, more = schema.get("properties", {}), schema.get("items"), schema.get("additionalProperties")
    by_type = {"type", "minimum", "maximum"} & set(schema)
    by_text = {"enum", "pattern", "minLength", "maxLength"} & set(schema)
    by_keys = fields or schema.get("required") or more is False

    def judged(own: Column) -> Column:
        parts = [_hits(rules, path)] if (rules := schema_rules(schema, own)) else []
        for name, part in fields.items():
            there = F.coalesce(F.array_contains(own["keys"], name), F.lit(False))
            inside = value_hits(part, F.try_variant_get(own["v"], f"$.{name}", "variant"), F.concat(path, F.lit(f".{name}")))
            parts.append(F.when(there, inside).otherwise(F.array().cast(_HITS)))
        if isinstance(items, dict):
            elements = F.try_variant_get(own["v"], "$", "array<variant>")
            inside = F.transform(elements, lambda e, i: value_hits(items, e, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            parts.append(F.coalesce(F.flatten(inside), F.array().cast(_HITS)))
        if isinstance(more, dict):
            entries = F.map_entries(F.try_variant_get(own["v"], "$", "map<string, variant>"))
            if fields:
                entries = F.filter(entries, lambda e: ~e["key"].isin(*fields))
            inside = F.transform(entries, lambda e: value_hits(more, e["value"], F.concat(path, F.lit("."), e["key"])))
            parts.append(F.coalesce(F.flatten(inside), F.array().cast(_HITS)))
        return F.flatten(F.array(*parts)) if parts else F.array().cast(_HITS)

    def described(v: Column) -> Column:
        found = F.schema_of_variant(v) if by_type else F.lit(None).cast("string")
        text = F.try_variant_get(v, "$", "string") if by_text else F.lit(None).cast("string")
        names = F.lit(None).cast("array<string>") if not by_keys else _keys(v) if keys is None else keys
        return F.struct(v.alias("v"), found.alias("found"), text.alias("text"), names.alias("keys"))

    return _once(variant, lambda v: _once(described(v), judged))


def violations(df: DataFrame, key: str, value: str, schema: dict) -> DataFrame:
    """(key, path, rule) of every broken rule, in arrays too, in one pass over df, whose JSON is parsed once."""
    broken = _once(F.col(value), lambda text: value_hits(schema, F.try_parse_json(text), F.lit("$"), F.json_object_keys(text)))
    return df.select(key, F.explode(broken).alias("h")).select(key, "h.path", "h.rule")


def log_violations(df: DataFrame, key: str) -> DataFrame:
    """(key, rule): the event and level lists are closed, and an error code is there if and only if the level is error."""
    error = F.col("level") == "error"
    broken = [
        F.when(~F.coalesce(F.col("event").isin(*EVENTS), F.lit(False)), F.lit("event")),
        F.when(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), F.lit("level")),
        F.when(F.coalesce(error, F.lit(False)) != F.col("error_code").isNotNull(), F.lit("error_code")),
    ]
    return df.select(key, F.explode(F.filter(F.array(*broken), lambda b: b.isNotNull())).alias("rule"))


def missing_references(rows: DataFrame, key: str, reference: str, target: DataFrame, target_key: str) -> DataFrame:
    return rows.where(F.col(reference).isNotNull()).join(target.select(F.col(target_key).alias(reference)).distinct(), reference, "left_anti").select(key, reference)


def in_several(df: DataFrame, key: str, group: str) -> DataFrame:
    """(key, n) of keys in more than one group."""
    return df.groupBy(key).agg(F.countDistinct(group).alias("n")).where("n > 1")


def first_mismatch(df: DataFrame, checks: list[tuple[str, str, str]]) -> Column:
    """The name of the first (name, expected, found) that differ, in this order; null if none does."""
    return F.coalesce(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(n)) for n, a, b in checks])


def check_hashes(expected: dict[str, str], found: dict[str, str]) -> None:
    for name in ("checkpoint_hash", "manifest_hash", "tokenizer_hash"):
        if expected.get(name) != found.get(name):
            raise HashMismatch(f"{name}: expected {expected.get(name)}, found {found.get(name)}")


def at_most(df: DataFrame, group: list[str], most: int) -> DataFrame:
    """(group, n) of groups with more rows."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def broken_rows(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    hits = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(key, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("rule"))


def all_violations(parts: dict[str, DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.select(F.col(key).cast("string").alias("key"), F.lit(n).alias("invariant")) for n, d in parts.items()])


def write_report(row: dict, path: str, once: bool = False) -> None:
    """A JSON report with sorted keys; ``once`` refuses to replace an existing lock."""
    target = Path(path)
    if once and target.exists():
        raise FileExistsError(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(row, sort_keys=True, indent=2) + "\n")
