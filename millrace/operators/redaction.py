"""Redaction of nested log payloads."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import DEBUG_SOURCE_CHARS, EMAIL, KNOWN_HASH_FIELDS, MAX_STRING_BYTES, SECRETS

# Fixed values.
SOURCE_KEYS = ("source", "chunk_source", "before_source", "after_source", "code")

_PATTERNS = [(re.compile(pattern), f"<redacted: {name}>") for name, pattern in SECRETS]
_EMAIL = re.compile(EMAIL)


def redact(value: object, level: str, field: str | None = None, above: tuple[int, ...] = ()) -> object:
    """A copy of the payload: raw sources dropped (cut at debug level), strings redacted at any depth.

    The items of a list belong to the list's field. A container inside itself becomes a mark;
    one that occurs twice side by side does not.
    """
    if isinstance(value, str):
        return _string(value, field)
    if not isinstance(value, dict | list):
        return value
    if id(value) in above:
        return "<redacted: cycle>"
    path = (*above, id(value))
    if isinstance(value, list):
        return [redact(x, level, field, path) for x in value]
    return {k: _source(x, level) if k in SOURCE_KEYS and isinstance(x, str) else redact(x, level, k, path) for k, x in value.items()}


def _source(text: str, level: str) -> str:
    if level != "debug":
        return "<redacted: source>"
    return text if len(text) <= DEBUG_SOURCE_CHARS else text[:DEBUG_SOURCE_CHARS] + "…"


def _string(text: str, field: str | None) -> str:
    if len(text.encode()) > MAX_STRING_BYTES:
        return "<redacted: too_long>"
    if field not in KNOWN_HASH_FIELDS:
        for pattern, mark in _PATTERNS:
            text = pattern.sub(mark, text)
    return _EMAIL.sub("<redacted: email>", text)


def redacted_json(payload: Column, level: Column) -> Column:
    """The redacted payloads of JSON texts, in Arrow batches; null stays null, and text that is no JSON is redacted as a string."""

    def one(text: str | None, at: str | None) -> str | None:
        if text is None:
            return None
        try:
            found = json.loads(text)
        except json.JSONDecodeError:
            found = text
        return json.dumps(redact(found, at or "info"), ensure_ascii=False)

    @F.pandas_udf("string")
    def run(texts: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([one(t, a) for t, a in zip(texts, levels, strict=True)], dtype=object)

    return run(payload, level)
