"""Normal form of Python chunks, changed nodes of a file, and unified diffs; texts are handled in Arrow batches.

The formatters that the survey's rule runs first and last are not part of this environment; what
is left of it is white space, docstring sentinels, comments without addresses, pragmas and the
compile gate. The form is idempotent.
"""

from __future__ import annotations

import ast
import difflib
import io
import re
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import EMAIL, PRAGMA_PREFIXES, TRAILING_PRAGMA
from millrace.operators.tokens import MAX_TOKEN_LENGTH, encode, over_cap, token_ids

# Fixed values.
SENTINEL = '"<DOC>"'
DIFF_CONTEXT = 3

_EMAIL, _PRAGMA = re.compile(EMAIL), re.compile(TRAILING_PRAGMA)
_BODIES = (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


def _edited(source: str, edits: list[tuple[int, int, int, int, str]]) -> str:
    """source with the spans (line, column, end line, end column; columns in characters) replaced."""
    lines = source.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    for line, column, end_line, end_column, text in sorted(edits, reverse=True):
        source = source[: starts[line - 1] + column] + text + source[starts[end_line - 1] + end_column :]
    return source


def _docstrings(source: str) -> list[tuple[int, int, int, int, str]]:
    """Spans of the string statements that open a module, class or function and share their line with no other statement of a block."""
    lines = [line.encode("utf-8", "surrogatepass") for line in source.split("\n")]
    found = []
    for node in ast.walk(ast.parse(source)):
        if not isinstance(node, _BODIES) or not node.body or not isinstance(node.body[0], ast.Expr):
            continue
        first, rest = node.body[0], node.body[1:2]
        literal = isinstance(first.value, ast.JoinedStr) or (isinstance(first.value, ast.Constant) and isinstance(first.value.value, (str, bytes)))
        in_block = not lines[first.lineno - 1][: first.col_offset].strip()
        if literal and not (in_block and rest and rest[0].lineno == first.end_lineno):
            column, end = (len(lines[n - 1][:c].decode("utf-8", "surrogatepass")) for n, c in ((first.lineno, first.col_offset), (first.end_lineno, first.end_col_offset)))
            found.append((first.lineno, column, first.end_lineno, end, SENTINEL))
    return found


def _comments(source: str) -> list[tuple[int, int, int, int, str]]:
    found = []
    for token in tokenize.generate_tokens(io.StringIO(source).readline):
        if token.type == tokenize.COMMENT:
            text = re.sub(r"[ \t]+", " ", _EMAIL.sub("", token.string)).rstrip()
            found.append((*token.start, *token.end, text))
    return found


def normalise(source: str | None) -> str | None:
    """The normal form of a chunk; "" of "", and null where the source, or what becomes of it, does not compile."""
    if not source:
        return source
    try:
        text = _trimmed(source)
        text = _edited(text, _docstrings(text))
        text = _edited(text, _comments(text))
        text = _PRAGMA.sub("", text)
        text = "\n".join(line for line in text.split("\n") if not line.strip().startswith(PRAGMA_PREFIXES))
        text = _trimmed(text).rstrip("\n")
        text = text + "\n" if text else text
        compile(text, "<normalised>", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
        return None
    return text


def _trimmed(source: str) -> str:
    return "\n".join(line.rstrip() for line in source.replace("\r\n", "\n").replace("\r", "\n").split("\n"))


def _mapped(df: DataFrame, columns: list[str], out: str, change: Callable[..., str | None]) -> DataFrame:
    """df with a string column of change(values of columns); equal inputs of a batch are handled once."""
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, str | None] = {}
            values = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
            for v in values:
                if v not in known:
                    known[v] = change(*v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([known[v] for v in values], pa.string())], names=[*kept, out])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{out}` string"])
    source = df if out in columns else df.select(*kept)
    return source.mapInArrow(run, schema)


def normalise_chunks(df: DataFrame, source: str = "source", out: str = "normalised") -> DataFrame:
    """df with the normal form of source; rows whose form is null or blank are dropped."""
    return _mapped(df, [source], out, normalise).where(F.col(out).rlike(r"\S"))


def unified_diff(before: str | None, after: str | None, context: int = DIFF_CONTEXT) -> str:
    """Line differences with context; null counts as empty, and equal texts give "". """
    lines = [(t or "").splitlines(keepends=True) for t in (before, after)]
    return "".join(difflib.unified_diff(*lines, fromfile="before", tofile="after", n=context))


def with_diff(df: DataFrame, before: str = "before", after: str = "after", out: str = "diff", context: int = DIFF_CONTEXT) -> DataFrame:
    return _mapped(df, [before, after], out, lambda b, a: unified_diff(b, a, context))


def top_level(source: str | None) -> dict[str, str] | None:
    """Name and text of the functions and classes of a module, the later of equal names; null if it does not parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines, found = (source or "").splitlines(), {}
    for node in tree.body:
        if isinstance(node, _BODIES):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            found[node.name] = "\n".join(lines[first - 1 : node.end_lineno]) + "\n"
    return found


def changed_nodes(before: str | None, after: str | None) -> list[dict]:
    """(qualname, before, after), by name: nodes of both sides whose normal forms exist and differ."""
    sides = top_level(before), top_level(after)
    if before is None or after is None or None in sides:
        return []
    out = []
    for name in sorted(sides[0].keys() & sides[1].keys()):
        old, new = normalise(sides[0][name]), normalise(sides[1][name])
        if old is not None and new is not None and old != new:
            out.append({"qualname": name, "before": old, "after": new})
    return out


def node_pairs(df: DataFrame, key: str, before: str = "before", after: str = "after") -> DataFrame:
    """(key, qualname, before, after) of every changed node of the two sides of a file; sides that are null or do not parse have none."""
    kind = pa.list_(pa.struct([("qualname", pa.string()), ("before", pa.string()), ("after", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([changed_nodes(b, a) for b, a in sides], kind)], names=["_key", "_nodes"])

    own = df.select(F.col(key).alias("_key"), F.col(before).alias("_before"), F.col(after).alias("_after"))
    schema = f"_key {own.schema['_key'].dataType.simpleString()}, _nodes array<struct<qualname: string, before: string, after: string>>"
    return own.mapInArrow(run, schema).select(F.col("_key").alias(key), F.inline("_nodes"))


def embedding_input(df: DataFrame, source: str = "source", length: int = MAX_TOKEN_LENGTH) -> DataFrame:
    """df with token_ids, what an encoder of chunks takes in: the framed ids of the source's normal form.

    Null where the source does not compile, and where its form has more ids than fit: such
    chunks are refused, not cut.
    """
    own = encode(_mapped(df, [source], "_normal", normalise), "_normal", "_ids")
    ids = F.when(F.col("_normal").isNotNull() & ~over_cap(F.col("_ids"), length), token_ids(F.col("_ids"), length))
    return own.withColumn("token_ids", ids).drop("_normal", "_ids")
