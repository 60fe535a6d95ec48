"""Source-code operators. The tables hold no code, so each document writes a small module with a known outcome."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import code, normalise, refusals
from millrace.plans.registry import query
from millrace.session import shared_dir, table
from millrace.sources import files

_MODULE = "import os\nX = {n}\n\ndef f{n}(a):\n    return a\n\nclass C:\n    y = 1\n\n    def m(self):\n        return {n}\n"


def _filled(template):
    return F.replace(F.lit(template), F.lit("{n}"), F.col("doc_id").cast("string"))


@query(
    "code_c1_chunks",
    """SELECT doc_id, unnest(['<interstitial>', 'f' || doc_id, 'C', 'C.m']) AS qualname, unnest(['interstitial', 'function', 'class', 'function']) AS kind,
              unnest([1, 4, 7, 10]) AS start_line, unnest([2, 5, 11, 11]) AS end_line FROM documents""",
)
def chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _filled(_MODULE).alias("source"))
    return code.chunk_sources(rows, "doc_id", "source").select("doc_id", "qualname", "kind", "start_line", "end_line")


def _pick(cases):
    at = F.col("doc_id") % len(cases)
    out = F.lit(cases[-1])
    for i, c in enumerate(cases[:-1]):
        out = F.when(at == i, F.lit(c)).otherwise(out)
    return out


_BASE = "def f(a, b):\n    print(a)\n    return a + b\n"
_AFTER = [_BASE, _BASE.replace("return", "open(a)\n    return"), _BASE.replace("print(a)", "pass"), _BASE.replace("print(a)", "print(a)\n    raise ValueError(b)"), _BASE.replace("a, b", "a, c"), "async " + _BASE, "def f(:"]


@query(
    "code_h6_safety",
    """SELECT doc_id, [NULL, 'side_effect_introduction', 'side_effect_elimination', 'exception_contract', 'public_api', 'async_boundary', NULL][doc_id % 7 + 1] AS failed FROM documents""",
)
def safety(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(_BASE).alias("before"), _pick(_AFTER).alias("after"))
    return code.with_features(rows, {"before": "b", "after": "a"}).select("doc_id", code.safety(F.col("b"), F.col("a")).alias("failed"))


_LOOP = "def f{n}(xs):\n    r = []\n    for x in xs:\n        r.append(x)\n    return r\n"
_LONG = "def f{n}(a):\n    b = a + 1\n    c = b * 2\n    return c\n"
_PLAIN = "class P{n}:\n    def __init__(self, a, b):\n        self.a = a\n        self.b = b\n"
_DATA = "@dataclass\nclass P{n}:\n    a: int\n    b: int\n"
_TRY = "def f{n}():\n    try:\n        g()\n    except:\n        pass\n"
_SUM = "def f{n}(df):\n    t = 0\n    for v in df['c']:\n        t = t + v\n    return t\n"
_CALL = "def f{n}(a, b):\n    return a\n\nf{n}(1, {n})\n"
#: (before, after, label, confidence, the intents that accept the pair)
_CASES = [
    ("def f{n}(a):\n    return a\n", "def f{n}(a):\n    return a\n", "NONE", 0.0, ""),
    (_LOOP, "def f{n}(xs):\n    r = [x for x in xs]\n    return r\n", "comprehension-rewrite", 0.9, "comprehension-rewrite"),
    (_LONG, "def g{n}(a):\n    b = a + 1\n    c = b * 2\n    return c\n\ndef f{n}(a):\n    return g{n}(a)\n", "extract-helper", 0.9, "extract-helper"),
    ("def g{n}(a):\n    return a + 1\n\ndef f{n}(a):\n    return g{n}(a)\n", "def f{n}(a):\n    return (a + 1)\n", "inline-helper", 0.85, "inline-helper"),
    ("def f{n}(a: Optional[int]): pass\n", "def f{n}(a: int | None): pass\n", "none-typing-modernization", 0.95, "none-typing-modernization"),
    (_PLAIN, _DATA, "dataclass-migration", 0.9, "dataclass-migration"),
    (_PLAIN, _DATA.replace("b: int", "c: int"), "dataclass-migration", 0.7, "dataclass-migration"),
    (_PLAIN.replace("= b", "= b + {n}"), _DATA, "NONE", 0.0, ""),
    (_TRY, _TRY.replace("except:", "except KeyError:"), "exception-handling-cleanup", 0.9, "exception-handling-cleanup"),
    (_TRY.replace("except:", "except KeyError:"), _TRY.replace("except:", "except KeyError:").replace("pass", "raise"), "exception-handling-cleanup", 0.7, "exception-handling-cleanup"),
    (_TRY.replace("except:", "except KeyError:"), _TRY, "NONE", 0.0, ""),
    (_SUM, "def f{n}(df):\n    return df['c'].sum()\n", "loop-to-vectorized", 0.8, ""),
    (_SUM, "def f{n}(df):\n    return df['c'].map({n})\n", "loop-to-vectorized", 0.8, "loop-to-vectorized"),
    (_SUM.replace("df['c']", "rows"), "def f{n}(df):\n    return df['c'].map({n})\n", "NONE", 0.0, "loop-to-vectorized"),
    (_CALL, _CALL.replace("a, b)", "a, b={n})").replace("(1, {n})", "(1)"), "argument-defaulting", 0.9, "argument-defaulting"),
    (_CALL, _CALL.replace("a, b)", "a, b={n})"), "argument-defaulting", 0.7, "argument-defaulting"),
    (_CALL, _CALL.replace("a, b)", "a, b=[])"), "NONE", 0.0, ""),
    (_CALL, _CALL.replace("a, b)", "a, b=list())"), "NONE", 0.0, "argument-defaulting"),
    ("def f{n}(:", _CALL, "NONE", 0.0, None),
]
_N = len(_CASES)


def _sided(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _pick([c[0] for c in _CASES]).alias("before"), _pick([c[1] for c in _CASES]).alias("after"))
    number = F.col("doc_id").cast("string")
    return rows.withColumns({c: F.replace(F.col(c), F.lit("{n}"), number) for c in ("before", "after")})


def _listed(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


@query(
    "code_l9_labels",
    f"""SELECT doc_id, {_listed([c[2] for c in _CASES])}[doc_id % {_N} + 1] AS intent, {_listed([c[3] for c in _CASES])}[doc_id % {_N} + 1]::DOUBLE AS confidence FROM documents""",
)
def labels(spark, sf_dir):
    found = code.with_features(_sided(spark, sf_dir), {"before": "b", "after": "a"})
    return found.select("doc_id", code.label(F.col("before"), F.col("after"), F.col("b"), F.col("a")).alias("l")).select("doc_id", "l.intent", "l.confidence")


_ASKED = (*code.INTENTS, "NONE")


@query(
    "code_q1_acceptance",
    f"""WITH asked AS (SELECT doc_id, unnest({_listed(_ASKED)}) AS intent, {_listed([c[4] for c in _CASES])}[doc_id % {_N} + 1] AS fits FROM documents)
        SELECT doc_id, intent, CASE WHEN fits IS NULL THEN NULL ELSE intent = 'NONE' OR intent = fits END AS accepted FROM asked""",
)
def acceptance(spark, sf_dir):
    found = code.with_features(_sided(spark, sf_dir), {"before": "b", "after": "a"})
    asked = found.withColumn("intent", F.explode(F.array(*[F.lit(i) for i in _ASKED])))
    return asked.select("doc_id", "intent", code.acceptance(F.col("intent"), F.col("before"), F.col("after"), F.col("b"), F.col("a")).alias("accepted"))


_RAW = '"""Module {n}."""\r\nimport os  # noqa: F401\n\n# mypy: strict\nclass C{n}:\n    \'\'\'Of\n    two lines.\'\'\'\n\n    def m(self):  \n        "doc"\n        return {n}  # ask   a{n}@example.org  now\n'
_NORMAL = '"<DOC>"\nimport os\n\n\nclass C{n}:\n    "<DOC>"\n\n    def m(self):\n        "<DOC>"\n        return {n}  # ask now\n'
_CHUNKS = [_RAW, "x = {n}   \n\n\n", "def f(:\n", "   \n", "# noqa\n", 'def f{n}(): "d"; return {n}\n']
_FORMS = [_NORMAL, "x = {n}\n", None, None, None, 'def f{n}(): "<DOC>"; return {n}\n']


@query(
    "code_x8_normalised",
    "SELECT doc_id, replace(form, '{n}', doc_id::VARCHAR) AS normalised FROM (SELECT doc_id, "
    + _listed([f and f.replace("'", "''") for f in _FORMS]) + f"[doc_id % {len(_FORMS)} + 1] AS form FROM documents) WHERE form IS NOT NULL",
)
def normalised(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace(_pick(_CHUNKS), F.lit("{n}"), F.col("doc_id").cast("string")).alias("source"))
    return normalise.normalise_chunks(rows).select("doc_id", "normalised")


_OLD = "def b{n}():\n    return 1\n\ndef a{n}():\n    return {n}\n\nclass K:\n    x = 1\n\ndef gone(): pass\n"
_NEW = "def a{n}():\n    return {n} + 1\n\nclass K:\n    x = 1  # noqa\n\ndef b{n}():\n    'doc'\n    return 1\n\ndef new(): pass\n"


@query(
    "commit_p1_nodes",
    """SELECT doc_id, unnest(['a' || doc_id, 'b' || doc_id]) AS qualname,
              unnest(['def a' || doc_id || '():' || chr(10) || '    return ' || doc_id || chr(10), 'def b' || doc_id || '():' || chr(10) || '    return 1' || chr(10)]) AS before,
              unnest(['def a' || doc_id || '():' || chr(10) || '    return ' || doc_id || ' + 1' || chr(10),
                      'def b' || doc_id || '():' || chr(10) || '    "<DOC>"' || chr(10) || '    return 1' || chr(10)]) AS after FROM documents""",
)
def nodes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _filled(_OLD).alias("before"), _filled(_NEW).alias("after"))
    return normalise.node_pairs(rows, "doc_id").select("doc_id", "qualname", "before", "after")


@query(
    "code_x18_diff",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -1,4 +1,4 @@' || chr(10) || ' a' || chr(10) || '-b' || chr(10)
              || '+' || doc_id || chr(10) || ' c' || chr(10) || ' d' || chr(10) END AS diff FROM documents""",
)
def diff(spark, sf_dir):
    base = F.lit("a\nb\nc\nd\n")
    changed = F.replace(base, F.lit("b"), F.when(F.col("doc_id") % 3 == 0, F.lit("b")).otherwise(F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", base.alias("before"), changed.alias("after"))
    return normalise.with_diff(rows).select("doc_id", "diff")


@query("serve_x17_messages", "SELECT doc_id, " + _listed([m.replace("'", "''") for m in refusals.MESSAGES.values()]) + f"[doc_id % {len(refusals.MESSAGES)} + 1] AS message FROM documents")
def messages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _pick(list(refusals.MESSAGES)).alias("code"))
    return rows.select("doc_id", refusals.message(F.col("code")).alias("message"))


@query("source_s8_round_trip", "SELECT o_orderkey, o_custkey, o_comment, kind FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS o_comment FROM orders), (VALUES ('jsonl'), ('parquet')) v(kind)")
def round_trip(spark, sf_dir):
    """Rows written and read again in both formats."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("o_comment"))
    base = f"{shared_dir(spark)}/millrace-rows-{uuid.uuid4().hex}"
    out = []
    for kind in ("jsonl", "parquet"):
        files.write_rows(rows, f"{base}.{kind}", rows.schema)
        out.append(files.load_rows(spark, f"{base}.{kind}", rows.schema).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])
