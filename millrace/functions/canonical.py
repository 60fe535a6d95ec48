"""Canonical JSON as Column expressions: sorted keys, no spaces, ASCII only; content ids are digests of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _escaped(char: Column) -> Column:
    code = F.lower(F.hex(F.encode(char, "UTF-16BE")))
    plain = F.when(char == '"', F.lit('\\"')).when(char == "\\", F.lit("\\\\")).when(char == "\n", F.lit("\\n")).when(char == "\r", F.lit("\\r")).when(char == "\t", F.lit("\\t")).when(char == "\b", F.lit("\\b")).when(char == "\f", F.lit("\\f"))
    # beyond the basic plane a character has two units
    units = F.concat(F.lit("\\u"), F.substring(code, 1, 4), F.when(F.length(code) > 4, F.concat(F.lit("\\u"), F.substring(code, 5, 4))).otherwise(F.lit("")))
    return plain.when(char.rlike(r"^[\x20-\x7e]$"), char).otherwise(units)


def json_string(text: Column) -> Column:
    """The text as an ASCII JSON string; null is null (the word). Only texts with other than printable ASCII are taken apart."""
    simple = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    by_char = F.array_join(F.transform(F.split(text, ""), _escaped), "")
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.when(text.rlike(r"[^\x20-\x7e]"), by_char).otherwise(simple), F.lit('"')))


def json_ints(ids: Column) -> Column:
    return F.coalesce(F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ",", "null"), F.lit("]")), F.lit("null"))


def json_int_lists(lists: Column) -> Column:
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(lists, json_ints), ","), F.lit("]")), F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """An object of columns that are JSON text already, keys in order."""
    parts: list[Column] = []
    for place, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if place else "") + f'"{name}":'), fields[name]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def sequence_id(repo: Column, file_path: Column, context_ids: Column, target_ids: Column) -> Column:
    """A sequence's content id: the same for equal content on every machine and in every run."""
    text = json_object({"repo": json_string(repo), "file_path": json_string(file_path), "context_ids": json_int_lists(context_ids), "target_ids": json_ints(target_ids)})
    return F.sha2(text, 256)
