"""The benchmark suite, loose rows, records read with a schema, and functions called from SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import registry
from millrace.functions import text as X
from millrace.operators.audit import boilerplate, token_length
from millrace.operators.sequences import pair_matrix, stratified_sample
from millrace.operators.splits import union_in_order
from millrace.operators.suite import Benchmark, run_suite
from millrace.plans.registry import query
from millrace.session import shared_dir, table
from millrace.sources import locks, loose


def _fresh(spark, name):
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


_SUITE = """WITH o AS (SELECT o_orderpriority, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 150 + 1 END AS rank FROM orders),
    m AS (SELECT o_orderpriority AS p, o_orderstatus AS s, grouping(o_orderpriority) AS gp, grouping(o_orderstatus) AS gs, count(*) AS n,
                 avg((coalesce(rank, 999) <= 1)::INT::DOUBLE) AS recall_1, avg((coalesce(rank, 999) <= 5)::INT::DOUBLE) AS recall_5, avg((coalesce(rank, 999) <= 10)::INT::DOUBLE) AS recall_10,
                 avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr_zero, avg(1.0::DOUBLE / coalesce(rank, 101)) AS mrr_pool
          FROM o GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus))),
    r AS (UNPIVOT (SELECT CASE WHEN gp = 0 THEN 'o_orderpriority=' || p WHEN gs = 0 THEN 'o_orderstatus=' || s ELSE '' END AS "group", n, recall_1, recall_5, recall_10, mrr_zero, mrr_pool FROM m) ON recall_1, recall_5, recall_10, mrr_zero, mrr_pool INTO NAME metric VALUE value),
    p AS (SELECT event_type, count(*) AS n, avg((value > 50)::INT::DOUBLE) AS pass_rate, avg(value) AS mean, stddev_samp(value) AS std, count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY GROUPING SETS ((), (event_type))),
    e AS (UNPIVOT (SELECT coalesce('event_type=' || event_type, '') AS "group", n, pass_rate, mean, std, users FROM p) ON pass_rate, mean, std, users INTO NAME metric VALUE value)"""


def _suite(spark, sf_dir):
    ranks = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey") % 150 + 1).alias("rank"))
    r, v = F.col("rank"), F.col("value")
    ranking = {f"recall_{k}": F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))) for k in (1, 5, 10)}
    ranking |= {"mrr_zero": F.avg(F.coalesce(1.0 / r, F.lit(0.0))), "mrr_pool": F.avg(1.0 / F.coalesce(r, F.lit(101)))}
    passing = {"pass_rate": F.avg((v > 50).cast("double")), "mean": F.avg(v), "std": F.stddev_samp(v), "users": F.count_distinct("user_id")}
    return [
        Benchmark("RET-100", ranks, ranking, ("o_orderpriority", "o_orderstatus"), {"pool": "100"}),
        Benchmark("EVAL", table(spark, sf_dir, "events").select("event_type", "value", "user_id"), passing, ("event_type",)),
    ]


@query(
    "suite_k6_results",
    _SUITE + """ SELECT 'RET-100' AS benchmark_id, "group", metric, round(value, 9) AS value, n FROM r UNION ALL SELECT 'EVAL', "group", metric, round(value, 9), n FROM e""",
)
def suite(spark, sf_dir):
    """Orders as ranked answers and events as outcomes: recalls, reciprocal ranks, rates and moments over all and by group."""
    out = run_suite(_suite(spark, sf_dir), _fresh(spark, "suite"))
    return out.select("benchmark_id", "group", "metric", F.round("value", 9).alias("value"), "n")


@query(
    "suite_k6_report",
    _SUITE
    + """, every AS (SELECT 'RET-100' AS b, "group" AS g, metric, value, n FROM r UNION ALL SELECT 'EVAL', "group", metric, value, n FROM e)
         SELECT b AS benchmark_id, 'v1' AS schema_version, count(DISTINCT g) AS n_groups, round(max(value) FILTER (g = '' AND metric IN ('recall_5', 'pass_rate')), 9) AS headline FROM every GROUP BY b""",
)
def suite_report(spark, sf_dir):
    """What the one JSON line of a suite says."""
    out = _fresh(spark, "suite")
    run_suite(_suite(spark, sf_dir), out)
    groups = "array<struct<group: string, n: bigint, metrics: map<string, double>>>"
    line = spark.read.text(f"{out}/results").select(F.from_json("value", f"schema_version string, global_seed int, benchmarks array<struct<benchmark_id: string, seed: bigint, groups: {groups}>>").alias("r"))
    each = line.select("r.schema_version", F.inline("r.benchmarks"))
    whole = F.filter("groups", lambda g: g["group"] == "")[0]["metrics"]
    return each.select("benchmark_id", "schema_version", F.size("groups").cast("long").alias("n_groups"), F.round(F.coalesce(whole["recall_5"], whole["pass_rate"]), 9).alias("headline"))


_LOOSE = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"k":' || event_id || '.5,"who":"u' || user_id || '"}' WHEN 2 THEN '{"k":7,"more":{"deep":[' || event_id || ',2]}}'
              WHEN 3 THEN '{"mixed":' || event_id || '}' WHEN 4 THEN '{"mixed":{"a":"' || event_type || '"}}' END AS json FROM events"""


@query(
    "sink_k2_loose",
    f"""SELECT event_id, (json->>'k')::DOUBLE AS k, json->>'who' AS who, (json->'more'->'deep'->>0)::BIGINT AS deep, (json->'mixed') IS NOT NULL AS has_mixed,
               CASE WHEN json_type(json->'mixed') = 'OBJECT' THEN json->'mixed'->>'a' ELSE json->>'mixed' END AS mixed FROM ({_LOOSE})""",
)
def loose_rows(spark, sf_dir):
    """Props whose fields and types differ by row, null ones among them, written typed and read again."""
    kind = F.col("event_id") % 6
    key = F.col("event_id").cast("string")
    json = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit('{"k":'), key, F.lit('.5,"who":"u'), F.col("user_id").cast("string"), F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"k":7,"more":{"deep":['), key, F.lit(",2]}}")))
        .when(kind == 3, F.concat(F.lit('{"mixed":'), key, F.lit("}")))
        .when(kind == 4, F.concat(F.lit('{"mixed":{"a":"'), F.col("event_type"), F.lit('"}}')))
    )
    # the key goes into the object, so that what comes back can be told apart
    whole = F.when(json.isNull(), F.concat(F.lit('{"event_id":'), key, F.lit("}"))).otherwise(F.regexp_replace(json, r"^\{", F.concat(F.lit('{"event_id":'), key, F.lit(","))))
    path = _fresh(spark, "loose")
    loose.write_loose(table(spark, sf_dir, "events").select(whole.alias("json")), "json", path)
    back = spark.read.parquet(path)
    mixed = F.coalesce(F.try_variant_get("mixed", "$.a", "string"), F.try_variant_get("mixed", "$", "string"))
    return back.select("event_id", F.col("k").cast("double").alias("k"), "who", F.col("more.deep")[0].alias("deep"), F.col("mixed").isNotNull().alias("has_mixed"), mixed.alias("mixed"))


@query(
    "source_s9_records",
    """SELECT count(*) FILTER (o_orderkey % 7 <> 0) AS records, sum(o_orderkey) FILTER (o_orderkey % 7 <> 0)::BIGINT AS keys, count(*) FILTER (o_orderkey % 7 = 0) AS rejected, count(*) FILTER (o_orderkey % 14 = 0) AS wrong_types FROM orders""",
)
def records(spark, sf_dir):
    """Orders as JSON records; every seventh is cut off or has a word for a number, and is rejected whole."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    good = F.to_json(F.struct("o_orderkey", F.struct(F.array("o_orderstatus").alias("states")).alias("of")))
    text = F.when(F.col("o_orderkey") % 14 == 0, F.lit('{"o_orderkey":"many","of":{"states":[]}}')).when(F.col("o_orderkey") % 7 == 0, F.substring(good, 1, 12)).otherwise(good)
    path = _fresh(spark, "records")
    o.select(text.alias("value")).write.text(path)
    kept, rejected = loose.load_records(spark, path, "o_orderkey long, of struct<states: array<string>>", lines=True)
    a = kept.agg(F.count(F.lit(1)).alias("records"), F.sum("o_orderkey").alias("keys"))
    b = rejected.agg(F.count(F.lit(1)).alias("rejected"), F.count_if(F.contains("text", F.lit("many"))).alias("wrong_types"))
    return a.crossJoin(b)  # two single rows


def _modules(spark, sf_dir):
    """A module per document, with a word of its text inside: a function, a class with a method, and statements between."""
    word = F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 6)
    n = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("x = '"), word, F.lit("'\n\ndef f"), n, F.lit("(a):\n    return a + '"), word, F.lit("'\n\n\nclass C:\n    def m(self):\n        return 1\n")).alias("source")
    )


@query(
    "sql_c1_chunks",
    """WITH w AS (SELECT doc_id, substring(md5(coalesce(text, '')), 1, 6) AS word FROM documents)
       SELECT doc_id, unnest(['<interstitial>', 'f' || doc_id, 'C', 'C.m']) AS qualname, unnest(['interstitial', 'function', 'class', 'function']) AS kind, unnest([1, 3, 7, 8]) AS start_line, unnest([1, 4, 9, 9]) AS end_line,
              unnest(['x = ''' || word || '''', 'def f' || doc_id || '(a):' || chr(10) || '    return a + ''' || word || '''', 'class C:' || chr(10) || '    def m(self):' || chr(10) || '        return 1', '    def m(self):' || chr(10) || '        return 1']) AS source FROM w""",
)
def sql_chunks(spark, sf_dir):
    """Chunks by a table function called from SQL text, over modules that hold a word of each document."""
    registry.register(spark)
    return spark.sql("SELECT m.doc_id, c.* FROM {modules} m, LATERAL source_chunks(m.source) c", modules=_modules(spark, sf_dir))


@query(
    "sql_a13_macro_f1",
    """WITH p AS (SELECT event_type AS t, CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END AS p FROM events), c AS (SELECT DISTINCT t AS c FROM p UNION SELECT DISTINCT p FROM p),
        f AS (SELECT (SELECT count(*) FROM p WHERE t = c) AS t, (SELECT count(*) FROM p WHERE p = c) AS q, (SELECT count(*) FROM p WHERE t = c AND p = c) AS h FROM c)
        SELECT round(avg(CASE WHEN h = 0 THEN 0 ELSE 2.0::DOUBLE * h / (t + q) END), 9) AS macro_f1 FROM f""",
)
def sql_macro_f1(spark, sf_dir):
    """A registered aggregate over counts of (label, predicted), called from SQL text."""
    registry.register(spark)
    counts = "SELECT event_type AS t, CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END AS p, count(*) AS n FROM {events} GROUP BY ALL"
    return spark.sql(f"SELECT round(macro_f1(t, p, n), 9) AS macro_f1 FROM ({counts})", events=table(spark, sf_dir, "events"))


@query(
    "sql_l9_judged",
    """SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'exception-handling-cleanup' ELSE 'NONE' END AS intent, CASE doc_id % 4 WHEN 2 THEN 'side_effect_introduction' WHEN 3 THEN 'public_api' END AS rejected_by FROM documents""",
)
def judged(spark, sf_dir):
    """Pairs of modules that hold a word of each document, judged by all registered labellers and checks; SQL text reads the view."""
    word = F.concat(F.lit("'"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 6), F.lit("'"))
    kind, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    head = F.concat(F.lit("def f"), n, F.lit("(a):\n"))
    tried = lambda e: F.concat(head, F.lit("    try:\n        return int(a)\n    except"), F.lit(e), F.lit(":\n        return "), word, F.lit("\n"))
    plain = F.concat(head, F.lit("    return a + "), word, F.lit("\n"))
    before = F.when(kind == 1, tried("")).otherwise(plain)
    after = F.when(kind == 1, tried(" ValueError")).when(kind == 2, F.concat(head, F.lit("    print(a)\n    return a + "), word, F.lit("\n"))).when(kind == 3, F.replace(plain, F.lit("(a)"), F.lit("(a, b)"))).otherwise(plain)
    pairs = table(spark, sf_dir, "documents").select("doc_id", before.alias("before"), after.alias("after"))
    return spark.sql("SELECT doc_id, intent, rejected_by FROM {judged}", judged=registry.judged(pairs))


# ---- pools and audits read back, and small operators of audit and feed


@query(
    "source_s9_pools",
    """WITH r AS (SELECT lang, doc_id::VARCHAR AS id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || doc_id), doc_id) AS n FROM documents WHERE lang IS NOT NULL)
       SELECT lang AS benchmark, count(*)::INT AS pool_size, sha256(string_agg(id, ',' ORDER BY id)) AS pool_hash, min(id) AS least FROM r WHERE n <= 100 GROUP BY lang""",
)
def pools_back(spark, sf_dir):
    """A pool of 100 documents a language, written and read again; the hash is taken anew from the ids."""
    sampled = stratified_sample(table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", "doc_id"), "lang", "doc_id", 100, 7)
    pools = sampled.groupBy("lang").agg(F.collect_list("doc_id").alias("ids"))
    path = _fresh(spark, "pools")
    locks.write_pools(pools, path, "lang", "ids")
    return locks.load_pools(spark, path).select("benchmark", "pool_size", "pool_hash", F.col("chunk_ids")[0].alias("least"))


@query(
    "source_s9_audits",
    """WITH o AS (SELECT o_custkey % 40 AS c, count(*) AS n, sum((o_orderstatus = 'F')::INT)::DOUBLE / count(*) AS f FROM orders GROUP BY ALL)
       SELECT 'r' || c AS repo, 1 - f / 10 AS compile_ok_rate, 1 - f / 10 >= 0.95 AS compile_gate, f < 0.3 AS duplication_gate, c % 5 > 0 AS license_gate, c % 7 > 0 AS secrets_gate,
              1 - f / 10 >= 0.95 AND f < 0.3 AND c % 5 > 0 AND c % 7 > 0 AS gates_pass, n AS pairs FROM o""",
)
def audits_back(spark, sf_dir):
    """Figures of orders as audits, written without their gates and read again with them."""
    c, share = F.col("c"), F.avg((F.col("o_orderstatus") == "F").cast("double"))
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("c")).agg(F.count(F.lit(1)).alias("n"), share.alias("f"))
    audits = o.select(
        F.lit(locks.VERSION).alias("schema_version"), F.concat(F.lit("r"), c.cast("string")).alias("repo"), F.sha1(c.cast("string").cast("binary")).alias("commit_sha"), F.when(c % 5 > 0, "MIT").otherwise("none").alias("license_spdx"),
        F.lit(1).alias("py_files_in_scope"), F.col("n").alias("chunk_count"), F.lit(10).alias("median_chunk_token_len"), F.lit(0.0).alias("drop_rate_over_cap"), F.lit(0.0).alias("drop_rate_parse_fail"),
        F.col("f").alias("duplication_rate"), F.when(c % 7 > 0, 0).otherwise(1).alias("secret_scanner_hits"), (1 - F.col("f") / 10).alias("compile_ok_rate"), F.create_map(F.lit("unknown"), F.col("n")).alias("per_intent_pair_count"),
    )
    path = _fresh(spark, "audits")
    locks.write_audits(audits, path)
    back = locks.load_audits(spark, path)
    return back.select("repo", "compile_ok_rate", "compile_gate", "duplication_gate", "license_gate", "secrets_gate", "gates_pass", F.col("per_intent_pair_count")["unknown"].alias("pairs"))


@query(
    "audit_a2_lengths",
    r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 11 WHEN coalesce(text, '') <> '' THEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) END AS n_tokens FROM documents""",
)
def token_lengths(spark, sf_dir):
    """Lengths of what a third of the documents has as ids and the others as words."""
    ids = F.when(F.col("doc_id") % 3 == 0, F.array_repeat(F.lit(20), (F.col("doc_id") % 11).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", token_length(ids, F.col("text")).cast("long").alias("n_tokens"))


@query(
    "audit_f14_templates",
    "SELECT doc_id, doc_id % 8 IN (0, 2, 4, 6) AS template FROM documents",
)
def templates(spark, sf_dir):
    """Modules that hold a word of each document: templates of four kinds, and what resembles them."""
    word, kind = F.concat(F.lit("w"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 6)), F.col("doc_id") % 8
    parts = [
        ("p/__init__.py", "# made of @\nfrom .@ import @, b\nimport os\n\n__all__ = ['@',\n  'b']\n"), ("p/__init__.py", "from .@ import @\n\ndef @():\n    return 1\n"),
        ("setup.py", "from setuptools import setup\n\nsetup(\n    name='@',\n)\n"), ("setup.py", "x = '@'\nprint(x)\n"),
        ("m.py", "__all__ = ['@', 'b']\n"), ("m.py", "__all__ = ['@']\n@ = 1\n"), ("m.py", "@ = lambda x: x + 1\n"), ("m.py", "def @(x):\n    return lambda: x\n"),
    ]
    path = F.get(F.array(*[F.lit(p) for p, _ in parts]), kind.cast("int"))
    source = F.replace(F.get(F.array(*[F.lit(s) for _, s in parts]), kind.cast("int")), F.lit("@"), word)
    return table(spark, sf_dir, "documents").select("doc_id", boilerplate(path, source).alias("template"))


@query(
    "feed_b2_pairs",
    r"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> ''), lambda t: length(t)) AS ids FROM documents)
        SELECT doc_id, list_resize(ids[1:16], 16, 0) AS before, CASE WHEN doc_id % 4 = 0 THEN list_resize([]::BIGINT[], 16, 0) ELSE list_resize(list_reverse(ids)[1:16], 16, 0) END AS after FROM w""",
)
def pair_rows(spark, sf_dir):
    """Both sides of pairs as rows of 16: a document's word lengths, and the same backwards (null every fourth time)."""
    ids = F.transform(X.tokens(F.col("text")), lambda t: F.length(t))
    after = F.when(F.col("doc_id") % 4 != 0, F.reverse("ids"))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", pair_matrix(F.col("ids"), after, 16).alias("m"))
    return rows.select("doc_id", F.col("m")[0].cast("array<bigint>").alias("before"), F.col("m")[1].cast("array<bigint>").alias("after"))


@query(
    "split_u5_order",
    "SELECT o_orderkey, s AS split, CASE s WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS split_order FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS s FROM orders)",
)
def splits_in_order(spark, sf_dir):
    """Three splits of orders as one table, with the place of each in the order."""
    o, r = table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") % 10
    return union_in_order({"test": o.where(r == 9), "train": o.where(r < 7), "val": o.where((r >= 7) & (r < 9))})
