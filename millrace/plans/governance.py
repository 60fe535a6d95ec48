"""Validation and invariants, on events, documents, labels and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import governance as G
from millrace.operators import mining as M
from millrace.plans.registry import query
from millrace.session import table

_LOG = """WITH log AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'train.step' WHEN event_type = 'click' THEN 'log.dropped' ELSE event_type END AS event,
    CASE WHEN value > 90 THEN 'error' WHEN event_id % 13 = 0 THEN 'notice' ELSE 'info' END AS level, CASE WHEN value > 80 THEN 'E1' END AS error_code FROM events)"""


def _log(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "train.step").when(F.col("event_type") == "click", "log.dropped").otherwise(F.col("event_type"))
    level = F.when(F.col("value") > 90, "error").when(F.col("event_id") % 13 == 0, "notice").otherwise("info")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("event"), level.alias("level"), F.when(F.col("value") > 80, "E1").alias("error_code"))


@query(
    "govern_g2_log_rules",
    _LOG
    + """ SELECT event_id, 'event' AS rule FROM log WHERE event NOT IN ('train.step', 'log.dropped') UNION ALL SELECT event_id, 'level' FROM log WHERE level NOT IN ('debug', 'info', 'warn', 'error')
          UNION ALL SELECT event_id, 'error_code' FROM log WHERE (level = 'error') <> (error_code IS NOT NULL)""",
)
def log_rules(spark, sf_dir):
    return G.log_violations(_log(spark, sf_dir), "event_id")


_SCHEMA = {"type": "object", "required": ["k", "missing"], "properties": {"k": {"type": "integer", "maximum": 50}}, "additionalProperties": False}


@query(
    "govern_g1_schema",
    """SELECT event_id, '$.missing' AS path, 'required' AS rule FROM events
       UNION ALL SELECT event_id, '$.k', 'maximum' FROM events WHERE (props->>'k')::BIGINT > 50""",
)
def schema(spark, sf_dir):
    return G.violations(table(spark, sf_dir, "events"), "event_id", "props", _SCHEMA)


_ITEMS = {
    "type": "object",
    "properties": {
        "k": {"type": ["integer", "null"]},
        "a": {"type": "array", "items": {"type": "object", "required": ["b"], "properties": {"b": {"type": "integer", "minimum": 10}, "c": {"type": "array", "items": {"type": "string", "maxLength": 4}}}}},
    },
}


@query(
    "govern_g1_items",
    """WITH e AS (SELECT event_id, (props->>'k')::BIGINT AS k, event_type FROM events)
       SELECT event_id, '$.a[0].b' AS path, 'minimum' AS rule FROM e WHERE k < 10
       UNION ALL SELECT event_id, '$.a[1].b', 'required' FROM e
       UNION ALL SELECT event_id, '$.a[2].b', 'type' FROM e
       UNION ALL SELECT event_id, '$.a[' || 3 + i || ']', 'type' FROM e, range(3) r(i) WHERE i < k % 3
       UNION ALL SELECT event_id, '$.a[3].c[1]', 'maxLength' FROM e WHERE k % 3 = 0 AND length(event_type) > 4
       UNION ALL SELECT event_id, '$.a[3].c[0]', 'type' FROM e WHERE k % 3 = 0
       UNION ALL SELECT event_id, '$.a[3].b', 'required' FROM e WHERE k % 3 = 0""",
)
def array_items(spark, sf_dir):
    """Props with an array built from each event: objects that lack b or have another kind of b, bare numbers, and an array inside an element."""
    k, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    bare = F.array_join(F.slice(F.array(F.lit("7"), F.lit("true")), 1, (k % 3).cast("int")), ",")
    inner = F.concat(F.lit('{"c":[1,"'), kind, F.lit('"]}'))
    last = F.when(k % 3 == 0, inner).otherwise(bare)
    json = F.concat(F.lit('{"k":null,"a":[{"b":'), k, F.lit('},{"d":1},{"b":"x"},'), last, F.lit("]}"))
    return G.violations(table(spark, sf_dir, "events").select("event_id", json.alias("json")), "event_id", "json", _ITEMS)


@query("govern_g3_first_mismatch", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'checkpoint_hash' WHEN o_orderkey % 5 = 0 THEN 'manifest_hash' END AS mismatch FROM orders")
def mismatch(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("a").alias("c"), F.when(F.col("o_orderkey") % 7 == 0, "b").otherwise("a").alias("c2"), F.lit("a").alias("m"), F.when(F.col("o_orderkey") % 5 == 0, "b").otherwise("a").alias("m2"))
    return rows.select("o_orderkey", G.first_mismatch(rows, [("checkpoint_hash", "c", "c2"), ("manifest_hash", "m", "m2")]).alias("mismatch"))


@query("govern_g5_references", "SELECT page_id, page_id AS doc_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def references(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("doc_id"))
    return G.missing_references(rows, "page_id", "doc_id", table(spark, sf_dir, "labels"), "doc_id").select("page_id", "doc_id")


@query("govern_g5_in_several", "SELECT sha256(text) AS text_hash, count(DISTINCT source) AS n FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def several(spark, sf_dir):
    return G.in_several(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash"), "source"), "text_hash", "source")


@query("govern_g6_caps", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1000")
def caps(spark, sf_dir):
    return G.at_most(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], 1000)


@query("govern_g6_rows", "SELECT doc_id, 'length' AS rule FROM documents WHERE n_chars > 4000 UNION ALL SELECT doc_id, 'chars' FROM documents WHERE n_chars <> length(text)")
def rows(spark, sf_dir):
    return G.broken_rows(table(spark, sf_dir, "documents"), "doc_id", {"length": F.col("n_chars") <= 4000, "chars": F.col("n_chars") == F.length("text")})


@query("merge_j10_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'SEGMENT-' || c_custkey ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = c.where("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("SEGMENT-"), F.col("c_custkey").cast("string")).alias("c_mktsegment"))
    return M.upsert(c, changes, "c_custkey", ["c_mktsegment"])


@query("latest_by_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return M.latest(e, "user_id", "o").select("user_id", "event_id", "event_type")


@query("sets_u1_intersect", "SELECT a.source AS a, b.source AS b, len(list_intersect(a.l, b.l)) AS common, len(list_filter(a.l, lambda x: NOT list_contains(b.l, x))) AS only_a FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY source) a JOIN (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY source) b ON a.source < b.source")
def intersect(spark, sf_dir):
    sets = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    a, b = sets.select(F.col("source").alias("a"), F.col("l").alias("la")), sets.select(F.col("source").alias("b"), F.col("l").alias("lb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.size(F.array_intersect("la", "lb")).cast("long").alias("common"), F.size(F.array_except("la", "lb")).cast("long").alias("only_a"))


@query(
    "notice_k8_sections",
    "SELECT string_agg('## ' || source || E'\\n' || coalesce(c, 'Copyright the authors') || E'\\n', E'\\n' ORDER BY source) AS notice FROM (SELECT source, max(CASE WHEN lang = 'de' AND doc_id < 20 THEN 'Copyright ' || source END) AS c FROM documents GROUP BY source)",
)
def notice(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.when((F.col("lang") == "de") & (F.col("doc_id") < 20), F.concat(F.lit("Copyright "), "source"))).alias("c"))
    parts = rows.agg(F.array_sort(F.collect_list(F.struct("source", "c"))).alias("all")).select(F.transform("all", lambda s: F.concat(F.lit("## "), s["source"], F.lit("\n"), F.coalesce(s["c"], F.lit("Copyright the authors")), F.lit("\n"))).alias("p"))
    return parts.select(F.array_join("p", "\n").alias("notice"))
