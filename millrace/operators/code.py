"""Operators over Python source: chunks, structural features, intent labels and safety checks.

Sources are parsed once each, in Arrow batches, into a struct of features; labels and checks
are Column expressions over the features of the two sides, so Catalyst can prune and combine
them and nothing is parsed again.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sequences import INTENTS

# Fixed values.
EFFECTS = ("print", "logging", "logger", "log", "open", "write", "os", "subprocess", "socket", "requests", "urllib", "httpx", "aiohttp")
APPENDERS = ("append", "add", "update")
LEGACY = ("Optional[", "Union[", "typing.Optional[", "typing.Union[", "typing.List[", "typing.Dict[", "typing.Set[", "typing.Tuple[", "typing.FrozenSet[", "typing.Type[", "typing.DefaultDict[")
MODERN = ("| None", "list[", "dict[", "set[", "tuple[", "frozenset[", "type[")
SELF_ITERATORS = ("values", "iterrows", "itertuples", "items")
ARRAY_NAMES = ("arr", "array", "arrays", "df", "series", "s", "data", "x", "y", "X", "Y", "col", "column", "col_", "vec", "vector", "values")
VECTORIZED = (".apply(", ".map(", ".where(", ".filter(", ".sum(", ".mean(", ".max(", ".min(", "np.where(", "np.vectorize(", "np.sum(", "np.mean(", "np.array(", ".values", ".str.", ".dt.")
ACCEPTED_VECTOR_CALLS = (".apply(", ".map(", ".where(", "np.where(", "np.vectorize(")
ACCEPTED_LEGACY = ("Optional[", "Union[", "typing.List[", "typing.Dict[", "typing.Set[", "typing.Tuple[")
ACCEPTED_MODERN = ("| None", " | ", "list[", "dict[", "set[", "tuple[")
CHECKS = ("side_effect_introduction", "side_effect_elimination", "exception_contract", "public_api", "async_boundary")
REFUSAL = "R006_SAFETY_CHECKER_REJECTED_ALL"

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_TYPE = pa.struct(
    [
        ("parses", pa.bool_()),
        ("effects", pa.list_(pa.string())),
        ("raises", pa.list_(pa.string())),
        ("calls", pa.list_(pa.string())),
        ("functions", pa.list_(pa.struct([("name", pa.string()), ("body", pa.list_(pa.string())), ("returned", pa.string())]))),
        ("api", pa.list_(pa.struct([("name", pa.string()), ("params", pa.string()), ("returns", pa.string()), ("is_async", pa.bool_())]))),
        ("loops", pa.int32()),
        ("comprehensions", pa.int32()),
        ("jumps", pa.bool_()),
        ("appends", pa.bool_()),
        ("classes", pa.list_(pa.struct([("name", pa.string()), ("assigned", pa.list_(pa.string())), ("assigns", pa.bool_()), ("has_init", pa.bool_()), ("decorated", pa.bool_()), ("annotated", pa.list_(pa.string()))]))),
        ("bare", pa.int32()),
        ("silent", pa.int32()),
        ("broad", pa.int32()),
        ("suppresses", pa.bool_()),
        ("passes", pa.bool_()),
        ("array_loops", pa.bool_()),
        ("signatures", pa.list_(pa.struct([("name", pa.string()), ("positional", pa.list_(pa.string())), ("defaults", pa.list_(pa.string())), ("mutable", pa.list_(pa.string())), ("literal", pa.list_(pa.string())), ("most_args", pa.int32()), ("least_args", pa.int32())]))),
    ]
)
_DDL = (
    "struct<parses: boolean, effects: array<string>, raises: array<string>, calls: array<string>, functions: array<struct<name: string, body: array<string>, returned: string>>, "
    "api: array<struct<name: string, params: string, returns: string, is_async: boolean>>, loops: int, comprehensions: int, jumps: boolean, appends: boolean, "
    "classes: array<struct<name: string, assigned: array<string>, assigns: boolean, has_init: boolean, decorated: boolean, annotated: array<string>>>, bare: int, silent: int, broad: int, "
    "suppresses: boolean, passes: boolean, array_loops: boolean, signatures: array<struct<name: string, positional: array<string>, defaults: array<string>, mutable: array<string>, "
    "literal: array<string>, most_args: int, least_args: int>>>"
)


def _parse(source: str | None) -> ast.Module | None:
    if not source or not source.strip():
        return None
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _root(node: ast.expr) -> str | None:
    while isinstance(node, ast.Attribute):
        node = node.value
    return node.id if isinstance(node, ast.Name) else None


def _raised(node: ast.expr | None) -> str | None:
    while isinstance(node, ast.Call):
        node = node.func
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


def _appends(body: list[ast.stmt]) -> bool:
    """One statement that adds to a collection, possibly below ifs without else."""
    if len(body) != 1:
        return False
    s = body[0]
    if isinstance(s, ast.If):
        return not s.orelse and _appends(s.body)
    if isinstance(s, ast.Assign):
        return len(s.targets) == 1 and isinstance(s.targets[0], ast.Subscript)
    return isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Attribute) and s.value.func.attr in APPENDERS


def _outermost(body: list[ast.stmt]) -> Iterator[ast.FunctionDef | ast.AsyncFunctionDef]:
    """Functions that lie in no other definition, also those below other statements."""
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node
        elif not isinstance(node, ast.ClassDef):
            for part in ("body", "orelse", "finalbody"):
                yield from _outermost(getattr(node, part, []))
            for handler in getattr(node, "handlers", []) + getattr(node, "cases", []):
                yield from _outermost(handler.body)


def _last_name(node: ast.expr) -> str | None:
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


def _on_own_line(statement: ast.stmt, lines: list[bytes]) -> bool:
    """Not behind the colon of the statement it belongs to."""
    return not lines[statement.lineno - 1][: statement.col_offset].strip()


def _assigned(init: ast.FunctionDef | ast.AsyncFunctionDef, named: set[str], lines: list[bytes]) -> list[str] | None:
    """The names x, if the body is nothing but self.x = x of these parameters."""
    found = []
    for s in init.body:
        plain = isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Attribute) and isinstance(s.targets[0].value, ast.Name)
        if not plain or s.targets[0].value.id != "self" or not isinstance(s.value, ast.Name) or s.value.id != s.targets[0].attr or s.value.id not in named:
            return None
        found.append(s.value.id)
    return found if _on_own_line(init.body[0], lines) else None


def _class(node: ast.ClassDef, lines: list[bytes]) -> dict:
    inits = [f for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.name == "__init__"]
    assigned, any_assigned = None, None
    if inits:
        args = inits[0].args
        positional = {a.arg for a in args.posonlyargs + args.args} - {"self"}
        assigned = _assigned(inits[0], positional, lines)
        any_assigned = _assigned(inits[0], positional | {a.arg for a in args.kwonlyargs}, lines)
    fields = [s for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and _on_own_line(node.body[0], lines)]
    decorators = [d.func if isinstance(d, ast.Call) else d for d in node.decorator_list]
    return {
        "name": node.name, "assigned": assigned, "assigns": bool(any_assigned), "has_init": bool(inits),
        "decorated": any(_last_name(d) == "dataclass" for d in decorators), "annotated": [s.target.id for s in fields],
    }


def _signature(name: str, f: ast.FunctionDef | ast.AsyncFunctionDef, calls: dict[str, list[int]]) -> dict:
    positional = [a.arg for a in f.args.posonlyargs + f.args.args]
    given = dict(zip(positional[len(positional) - len(f.args.defaults) :], f.args.defaults, strict=True))
    given |= {a.arg: d for a, d in zip(f.args.kwonlyargs, f.args.kw_defaults, strict=True) if d is not None}
    literal = [p for p, d in given.items() if isinstance(d, (ast.List, ast.Dict, ast.Set))]
    made = [p for p, d in given.items() if isinstance(d, ast.Call) and isinstance(d.func, ast.Name) and d.func.id in ("list", "dict", "set") and not d.args and not d.keywords]
    counts = calls.get(name)
    return {
        "name": name, "positional": positional, "defaults": sorted(given), "mutable": literal + made, "literal": literal,
        "most_args": max(counts) if counts else None, "least_args": min(counts) if counts else None,
    }


def _array_like(node: ast.expr) -> bool:
    """What the iterated expression suggests by its form and names."""
    if isinstance(node, ast.Subscript):
        return True
    if isinstance(node, ast.Attribute):
        return node.attr in SELF_ITERATORS or node.attr.endswith("_") or node.attr in ARRAY_NAMES
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        return node.func.attr in SELF_ITERATORS or (isinstance(node.func.value, ast.Name) and node.func.value.id == "np")
    return isinstance(node, ast.Name) and node.id in ARRAY_NAMES


def _shape(source: str, tree: ast.Module, nodes: list[ast.AST]) -> dict:
    """Classes, handlers, iterated expressions and signatures."""
    lines = source.encode("utf-8", "surrogatepass").splitlines()
    tries = [n for n in nodes if isinstance(n, ast.Try)]
    handlers = [h for t in tries for h in t.handlers]
    below = [[s for s in h.body if isinstance(s, ast.Pass)] if _on_own_line(h.body[0], lines) else [] for h in handlers]
    withs = [i.context_expr for n in nodes if isinstance(n, (ast.With, ast.AsyncWith)) for i in n.items]
    counts: dict[str, list[int]] = {}
    for n in nodes:
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
            # unpacked arguments count one each, as they are written
            counts.setdefault(n.func.id, []).append(len(n.args) + sum(k.arg is None for k in n.keywords))
    signatures = {}
    for node in tree.body:
        inner = [(node.name, node)] if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else []
        if isinstance(node, ast.ClassDef):
            inner = [(f"{node.name}.{f.name}", f) for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]
        signatures |= {name: _signature(name, f, counts) for name, f in inner}
    return {
        "classes": list({n.name: _class(n, lines) for n in tree.body if isinstance(n, ast.ClassDef)}.values()),
        "bare": sum(h.type is None for h in handlers),
        "silent": sum(len(p) == 1 and len(h.body) == 1 for h, p in zip(handlers, below, strict=True)),
        "broad": sum(isinstance(h.type, ast.Name) and h.type.id in ("Exception", "BaseException") for h in handlers),
        "suppresses": any(isinstance(w, ast.Call) and _last_name(w.func) == "suppress" for w in withs),
        "passes": any(below),
        "array_loops": any(_array_like(n.iter) for n in nodes if isinstance(n, (ast.For, ast.AsyncFor))),
        "signatures": list(signatures.values()),
    }


def features(source: str | None) -> dict:
    tree = _parse(source)
    if tree is None:
        return {"parses": False}
    nodes = list(ast.walk(tree))
    calls = [n for n in nodes if isinstance(n, ast.Call)]
    functions = {}
    for f in tree.body:
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            only = f.body[0] if len(f.body) == 1 else None
            returned = ast.get_source_segment(source, only.value) if isinstance(only, ast.Return) and only.value else None
            functions[f.name] = {"name": f.name, "body": [ast.unparse(s) for s in f.body], "returned": returned}
    api = {
        f.name: {
            "name": f.name,
            "params": ",".join([a.arg for a in f.args.args] + ([f"**{f.args.kwarg.arg}"] if f.args.kwarg else [])),
            "returns": ast.unparse(f.returns) if f.returns else None,
            "is_async": isinstance(f, ast.AsyncFunctionDef),
        }
        for f in _outermost(tree.body)
    }
    loops = [n for n in nodes if isinstance(n, (ast.For, ast.AsyncFor))]
    return {
        "parses": True,
        "effects": sorted({r for c in calls if (r := _root(c.func)) in EFFECTS}),
        "raises": sorted({r for n in nodes if isinstance(n, ast.Raise) and (r := _raised(n.exc))}),
        "calls": sorted({c.func.id for c in calls if isinstance(c.func, ast.Name)}),
        "functions": list(functions.values()),
        "api": list(api.values()),
        "loops": len(loops),
        "comprehensions": sum(isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)) for n in nodes),
        "jumps": any(isinstance(n, (ast.Break, ast.Continue)) for n in nodes),
        "appends": any(_appends(n.body) for n in loops),
        **_shape(source, tree, nodes),
    }


def with_features(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a features struct per source column: {source column: new column}. A source that occurs again in a batch is parsed once."""
    kept = [c for c in df.columns if c not in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, dict] = {}
            arrays = [batch.column(c) for c in kept]
            for source in columns:
                values = batch.column(source).to_pylist()
                for v in values:
                    if v not in known:
                        known[v] = features(v)
                arrays.append(pa.array([known[v] for v in values], _TYPE))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *columns.values()])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{c}` {_DDL}" for c in columns.values()])
    return df.select(*kept).mapInArrow(run, schema)


def chunks(source: str | None) -> list[dict]:
    """Top-level definitions, methods and inner classes besides with dotted names, and runs of other statements."""
    tree = _parse(source)
    if tree is None:
        return []
    out: list[dict] = []
    text = source.splitlines()

    def add(first: ast.stmt, last: ast.stmt, name: str, kind: str) -> None:
        start = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
        out.append({"qualname": name, "kind": kind, "start_line": start, "end_line": last.end_lineno, "source": "\n".join(text[start - 1 : last.end_lineno])})

    def definition(node: ast.stmt, parents: tuple[str, ...]) -> None:
        kind = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}[type(node)]
        add(node, node, ".".join((*parents, node.name)), kind)
        if isinstance(node, ast.ClassDef):
            for inner in node.body:
                if isinstance(inner, _DEFS):
                    definition(inner, (*parents, node.name))

    run: list[ast.stmt] = []
    for node in [*tree.body, None]:
        if node is None or isinstance(node, _DEFS):
            if run:
                add(run[0], run[-1], "<interstitial>", "interstitial")
                run = []
            if node is not None:
                definition(node, ())
        else:
            run.append(node)
    return out


def chunk_sources(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, qualname, kind, start_line, end_line, source) of every chunk; sources that do not parse have none."""
    kind = pa.list_(pa.struct([("qualname", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("source", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([chunks(s) for s in batch.column(1).to_pylist()], kind)], names=["_key", "_chunks"])

    own = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"))
    schema = f"_key {own.schema['_key'].dataType.simpleString()}, _chunks array<struct<qualname: string, kind: string, start_line: int, end_line: int, source: string>>"
    return own.mapInArrow(run, schema).select(F.col("_key").alias(key), F.inline("_chunks"))


def safety(b: Column, a: Column) -> Column:
    """The name of the first check that fails, in the order of CHECKS; null if all pass, or a side does not parse."""
    name = lambda f: f["name"]
    lost = F.size(F.array_except(F.transform(b["api"], name), F.transform(a["api"], name))) > 0

    def shared(differs) -> Column:
        return F.exists(b["api"], lambda x: F.exists(a["api"], lambda y: (x["name"] == y["name"]) & differs(x, y)))

    fails = (
        F.size(F.array_except(a["effects"], b["effects"])) > 0,
        F.size(F.array_except(b["effects"], a["effects"])) > 0,
        (F.size(F.array_except(a["raises"], b["raises"])) > 0) | (F.size(F.array_except(b["raises"], a["raises"])) > 0),
        lost | shared(lambda x, y: (x["params"] != y["params"]) | ~x["returns"].eqNullSafe(y["returns"])),
        shared(lambda x, y: x["is_async"] != y["is_async"]),
    )
    first = reduce(lambda rest, pair: F.when(pair[1], F.lit(pair[0])).otherwise(rest), list(zip(CHECKS, fails, strict=True))[::-1], F.lit(None).cast("string"))
    return F.when(b["parses"] & a["parses"], first)


def _count(text: Column, markers: tuple[str, ...]) -> Column:
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m) for m in markers), F.lit(0.0))


def confidences(before: Column, after: Column, b: Column, a: Column) -> dict[str, Column]:
    """Confidence per intent, 0 for no match, in the order of INTENTS."""
    own = lambda side: F.transform(side["functions"], lambda f: f["name"])
    helpers = F.filter(a["functions"], lambda f: ~F.array_contains(own(b), f["name"]) & (F.size(f["body"]) >= 2) & F.array_contains(a["calls"], f["name"]))

    def moved(h: Column) -> Column:
        # the helper's first two statements stand side by side in a function of before
        pairs = lambda body: F.zip_with(body, F.slice(body, 2, F.size(body)), lambda x, y: F.struct(x.alias("p"), y.alias("q")))
        return F.exists(b["functions"], lambda f: F.coalesce(F.array_contains(pairs(f["body"]), F.struct(F.get(h["body"], F.lit(0)).alias("p"), F.get(h["body"], F.lit(1)).alias("q"))), F.lit(False)))

    extract = F.when(F.size(helpers) > 0, F.when(F.exists(helpers, moved), F.lit(0.9)).otherwise(F.lit(0.7))).otherwise(F.lit(0.0))
    gone = F.filter(b["functions"], lambda f: ~F.array_contains(own(a), f["name"]))
    called = F.exists(gone, lambda f: F.array_contains(a["calls"], f["name"]))
    textual = F.exists(gone, lambda f: F.coalesce(F.contains(after, f["returned"]), F.lit(False)))
    inline = F.when((F.size(gone) > 0) & ~called & (F.size(a["functions"]) > 0), F.when(textual, F.lit(0.85)).otherwise(F.lit(0.7))).otherwise(F.lit(0.0))
    fewer, more = b["loops"] - a["loops"], a["comprehensions"] - b["comprehensions"]
    comprehension = F.when((fewer > 0) & (more > 0) & ~b["jumps"] & b["appends"], F.when((fewer == 1) & (more == 1), F.lit(0.9)).otherwise(F.lit(0.7))).otherwise(F.lit(0.0))
    legacy = _count(before, LEGACY), _count(after, LEGACY)
    newer = (_count(after, MODERN) > _count(before, MODERN)) | (_count(after, (" | ",)) > _count(before, (" | ",)))
    typing = F.when((legacy[1] < legacy[0]) & newer, F.when(legacy[1] == 0, F.lit(0.95)).otherwise(F.lit(0.8))).otherwise(F.lit(0.0))
    both = b["parses"] & a["parses"]
    found = (extract, inline, comprehension, _dataclass(b, a), _exceptions(b, a), _vectorized(after, b, a), _defaulted(b, a), typing)
    return {k: F.when(both, F.coalesce(v, F.lit(0.0))).otherwise(F.lit(0.0)) for k, v in zip(INTENTS, found, strict=True)}


def _dataclass(b: Column, a: Column) -> Column:
    def migrated(fits) -> Column:
        def same(x: Column, y: Column) -> Column:
            return (x["name"] == y["name"]) & (F.size(x["assigned"]) >= 2) & ~y["has_init"] & y["decorated"] & fits(x["assigned"], y["annotated"])

        return F.exists(b["classes"], lambda x: F.exists(a["classes"], lambda y: F.coalesce(same(x, y), F.lit(False))))

    equal = migrated(lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0))
    return F.when(equal, 0.9).when(migrated(F.arrays_overlap), 0.7)


def _exceptions(b: Column, a: Column) -> Column:
    suppressed = a["suppresses"] & ~b["suppresses"]
    worse = (a["bare"] > b["bare"]) | ((a["silent"] > b["silent"]) & ~suppressed)
    best = (b["bare"] > a["bare"]) | ((a["silent"] < b["silent"]) & suppressed)
    return F.when(worse, 0.0).when(best, 0.9).when((a["silent"] < b["silent"]) | (b["broad"] > a["broad"]), 0.7)


def _has_any(text: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(m)) for m in markers])


def _vectorized(after: Column, b: Column, a: Column) -> Column:
    return F.when((a["loops"] < b["loops"]) & b["array_loops"] & _has_any(after, VECTORIZED), 0.8)


def _defaulted(b: Column, a: Column) -> Column:
    """Pairs (old, new) of functions with the same positional names that gained defaults decide."""

    def some(holds) -> Column:
        def same(x: Column, y: Column) -> Column:
            gained = F.array_except(y["defaults"], x["defaults"])
            return (x["name"] == y["name"]) & (x["positional"] == y["positional"]) & (F.size(gained) > 0) & holds(x, y, gained)

        return F.exists(a["signatures"], lambda y: F.exists(b["signatures"], lambda x: F.coalesce(same(x, y), F.lit(False))))

    mutable = some(lambda x, y, gained: F.arrays_overlap(gained, y["mutable"]))
    fewer = some(lambda x, y, gained: x["most_args"] > y["least_args"])
    return F.when(mutable, 0.0).when(fewer, 0.9).when(some(lambda x, y, gained: F.lit(True)), 0.7)


def acceptance(intent: Column, before: Column, after: Column, b: Column, a: Column) -> Column:
    """Whether a pair satisfies the permissive rule of an intent; null if a side does not parse. NONE accepts all; another name is an error."""
    names = lambda side: F.transform(side["functions"], lambda f: f["name"])
    new, gone = F.array_except(names(a), names(b)), F.array_except(names(b), names(a))
    jumps = F.contains(before, F.lit(" break\n")) | F.contains(before, F.lit(" continue\n"))
    migrated = F.exists(b["classes"], lambda x: F.exists(a["classes"], lambda y: (x["name"] == y["name"]) & x["assigns"] & ~y["has_init"] & y["decorated"]))
    bare = lambda text: F.contains(text, F.lit("except:"))
    of_module = lambda side: F.filter(side["signatures"], lambda f: ~F.contains(f["name"], F.lit(".")))

    def gained(y: Column) -> Column:
        olds = F.filter(of_module(b), lambda x: x["name"] == y["name"])
        return F.when(F.size(olds) > 0, F.array_except(y["defaults"], F.get(olds, F.lit(0))["defaults"])).otherwise(F.array().cast("array<string>"))

    # the first function that gained a default decides
    changed = F.transform(F.filter(of_module(a), lambda y: F.size(gained(y)) > 0), lambda y: F.arrays_overlap(gained(y), y["literal"]))
    rules = (
        F.arrays_overlap(new, a["calls"]),
        (F.size(gone) > 0) & ~F.arrays_overlap(gone, a["calls"]),
        (a["comprehensions"] > b["comprehensions"]) & (a["loops"] < b["loops"]) & ~jumps,
        migrated,
        (bare(before) & ~bare(after)) | (b["passes"] & ~a["passes"]),
        (a["loops"] < b["loops"]) & _has_any(after, ACCEPTED_VECTOR_CALLS),
        F.coalesce(~F.get(changed, F.lit(0)), F.lit(False)),
        _has_any(before, ACCEPTED_LEGACY) & _has_any(after, ACCEPTED_MODERN) & ~_has_any(after, ACCEPTED_LEGACY),
    )
    decided = reduce(lambda rest, pair: F.when(intent == pair[0], pair[1]).otherwise(rest), list(zip(INTENTS, rules, strict=True)), F.when(intent == "NONE", True).otherwise(F.raise_error(F.concat(F.lit("unknown intent: "), intent)).cast("boolean")))
    return F.when(b["parses"] & a["parses"], decided)


def label(before: Column, after: Column, b: Column, a: Column) -> Column:
    """struct(intent, confidence) of the most confident intent, the first in order on ties; NONE and 0 if none matches."""
    each = confidences(before, after, b, a)
    most = F.greatest(*each.values())
    name = F.coalesce(*[F.when((c == most) & (most > 0), F.lit(k)) for k, c in each.items()], F.lit("NONE"))
    return F.struct(name.alias("intent"), most.alias("confidence"))
