"""Windows, quotas, samples and the training feed, on conversations, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import sequences as S
from millrace.plans.registry import query
from millrace.session import table, widened

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '')"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("w"))


def _windows_sql(h, p, stride):
    return f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
        r AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS start, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE len(w) > 0)
      SELECT a.conv_id, a.start, string_agg(len(b.w)::VARCHAR, ',' ORDER BY b.start) FILTER (b.start < a.start + {h}) AS context_lengths,
             max(array_to_string(b.w, ' ')) FILTER (b.start = a.start + {h}) AS target
      FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.start BETWEEN a.start AND a.start + {h}
      WHERE a.start <= a.n - {h + p + 1} AND a.start % {stride} = 0 GROUP BY a.conv_id, a.start"""


def _windows(spark, sf_dir, h, p, stride):
    rows = S.build_sequences(_turns(spark, sf_dir), ["conv_id"], "turn", "w", h, p, stride)
    lengths = F.array_join(F.transform("context", lambda c: F.size(c).cast("string")), ",")
    return rows.select("conv_id", F.col("start").cast("long").alias("start"), lengths.alias("context_lengths"), F.array_join("target", " ").alias("target"))


@query("sequence_w1_windows", _windows_sql(3, 1, 1))
def windows(spark, sf_dir):
    return _windows(spark, sf_dir, 3, 1, 1)


@query("sequence_w1_strided", _windows_sql(2, 2, 2))
def strided(spark, sf_dir):
    return _windows(spark, sf_dir, 2, 2, 2)


@query(
    "quota_w2_intents",
    """SELECT lang, count(*) FILTER (r) AS retained, count(*) FILTER (NOT r) AS overflow FROM (
         SELECT lang, lang <> 'fr' AND row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 60 AS r FROM documents) GROUP BY lang""",
)
def quotas(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif(F.col("lang"), F.lit("fr")).alias("intent"))
    kept = S.apply_quotas(docs, "intent", "doc_id", 60)
    return kept.groupBy("lang").agg(F.count_if("retained").alias("retained"), F.count_if(~F.col("retained")).alias("overflow"))


@query(
    "quota_w2_orders",
    "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 500",
)
def order_quotas(spark, sf_dir):
    kept = S.apply_quotas(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 500)
    return kept.where("retained").select("o_orderkey", "o_orderpriority")


@query("sample_w4_gold", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('11|' || doc_id), doc_id) <= 25")
def gold(spark, sf_dir):
    return S.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 25, 11)


@query(
    "window_w5_monotonicity",
    """WITH b AS (SELECT event_id // 100 AS bucket, avg(value) AS mean FROM events WHERE event_id < 5000 GROUP BY ALL HAVING count(*) = 100),
            u AS (SELECT bucket, mean, coalesce(mean > lag(mean) OVER (ORDER BY bucket), false) AS up FROM b)
       SELECT bucket, round(mean, 6) AS mean, NOT bool_or(up) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS ok FROM u""",
)
def monotonicity(spark, sf_dir):
    out = S.loss_monotonicity(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", 100, 5000)
    return out.select("bucket", F.round("mean", 6).alias("mean"), "ok")


@query(
    "schedule_w8_learning_rate",
    """SELECT event_id, i AS step, round(CASE WHEN i < 100 THEN 0.001 * (i + 1) / 100.0 ELSE 0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(3.141592653589793 * least(1.0, (i - 100)::DOUBLE / 900))) END::DOUBLE, 12) AS rate
       FROM (SELECT event_id, event_id % 1100 AS i FROM events)""",
)
def schedule(spark, sf_dir):
    """Events as training steps, in runs of 1100: the last hundred of a run are beyond the schedule's end."""
    steps = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1100).alias("step"))
    return steps.select("event_id", "step", F.round(S.learning_rate(F.col("step"), 100, 1000, 0.001, 0.00001), 12).alias("rate"))


@query(
    "feed_x13_padded",
    f"""SELECT doc_id, array_to_string(list_slice(list_concat(list_transform(w, lambda t: length(t)), list_transform(range(64), lambda i: 0)), 1, 64), ',') AS ids,
              array_to_string(list_slice(list_concat(list_concat(list_concat([2], list_slice(list_transform(w, lambda t: length(t)), 1, 30)), [3]), list_transform(range(32), lambda i: 0)), 1, 32), ',') AS framed
       FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""",
)
def padded(spark, sf_dir):
    ids = F.transform(X.tokens(F.col("text")), lambda t: F.length(t))
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "documents").select("doc_id", show(X.padded(ids, 64)).alias("ids"), show(X.framed(ids, 32)).alias("framed"))


@query(
    "feed_b1_matrix",
    f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
        r AS (SELECT conv_id, list_slice(list_concat(list_transform(w, lambda x: length(x)), list_transform(range(8), lambda i: 0)), 1, 8) AS ids,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS start, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE len(w) > 0)
        SELECT a.conv_id, a.start, string_agg(array_to_string(b.ids, ','), ';' ORDER BY b.start) AS matrix
        FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.start BETWEEN a.start AND a.start + 3 WHERE a.start <= a.n - 5 GROUP BY ALL""",
)
def matrix(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(X.tokens(F.col("text")), lambda t: F.length(t)).alias("ids"))
    rows = S.build_sequences(turns, ["conv_id"], "turn", "ids")
    shown = F.array_join(F.transform(S.sequence_matrix(F.col("context"), F.col("target"), 8), lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), ";")
    return rows.select("conv_id", F.col("start").cast("long").alias("start"), shown.alias("matrix"))


@query("feed_a20_weights", "SELECT doc_id, lang, 1.0::DOUBLE / count(*) OVER (PARTITION BY lang) AS weight FROM documents")
def weights(spark, sf_dir):
    return S.class_weights(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").select("doc_id", "lang", "weight")


def _uniform(text):
    return f"('0x' || md5({text})[1:13])::BIGINT::DOUBLE / 4503599627370496"


@query(
    "feed_b3_balanced",
    f"""WITH c AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) - 1 AS c FROM documents GROUP BY lang),
        d AS (SELECT i AS draw, floor({_uniform("'5|' || i || '|class'")} * (SELECT count(*) FROM c))::BIGINT AS c, {_uniform("'5|' || i || '|row'")} AS u FROM range(2000) t(i)),
        r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS at FROM documents)
        SELECT d.draw, c.lang, r.doc_id FROM d JOIN c USING (c) JOIN r ON r.lang = c.lang AND r.at = floor(d.u * c.n)::BIGINT""",
)
def balanced(spark, sf_dir):
    return S.balanced_draws(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 2000, 5)


@query("feed_b4_shuffle", "SELECT doc_id, md5('3|' || doc_id) AS shuffle_key FROM documents")
def shuffle(spark, sf_dir):
    return S.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3)


@query(
    "feed_b5_mask",
    f"""WITH t AS (SELECT doc_id, list_transform({_WORDS}, lambda x: length(x)) AS ids FROM documents),
        u AS (SELECT doc_id, ids, unnest(range(len(ids))) AS i FROM t),
        h AS (SELECT doc_id, i, ids[i + 1] AS id, {_uniform("'0|' || doc_id || '|' || i")} < 0.15 AS hit FROM u)
        SELECT doc_id, count(*) FILTER (hit) AS n_masked, sum(CASE WHEN hit THEN 4 ELSE id END)::BIGINT AS masked_sum, sum(CASE WHEN hit THEN id ELSE -100 END)::BIGINT AS label_sum FROM h GROUP BY doc_id""",
)
def mask(spark, sf_dir):
    docs = widened(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.transform(X.tokens(F.col("text")), lambda t: F.length(t)).alias("ids")).where(F.size("ids") > 0)
    rows = S.with_masked(docs, "ids", "doc_id", 4)
    sums = F.aggregate("masked", F.lit(0).cast("long"), lambda s, x: s + x), F.aggregate("labels", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total")), lambda s, x: F.struct((s["n"] + (x != S.IGNORED_LABEL).cast("long")).alias("n"), (s["total"] + x).alias("total")))
    return rows.select("doc_id", sums[0].alias("masked_sum"), sums[1].alias("l")).select("doc_id", F.col("l.n").alias("n_masked"), "masked_sum", F.col("l.total").alias("label_sum"))


@query(
    "feed_x16_intents",
    f"""WITH n(i, name) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(S.INTENTS))}, (-1, 'NONE')),
        d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 8 THEN -1 ELSE doc_id % 9 END AS i FROM documents)
        SELECT d.doc_id, n.name, n.i AS intent_idx, CASE WHEN n.i < 0 THEN 8 ELSE n.i END AS dataset_idx FROM d JOIN n USING (i)""",
)
def intent_names(spark, sf_dir):
    name = F.coalesce(F.get(F.array(*[F.lit(i) for i in S.INTENTS]), (F.col("doc_id") % 9).cast("int")), F.lit("NONE"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return rows.select("doc_id", "name", S.intent_index(F.col("name")).alias("intent_idx"), S.intent_index(F.col("name"), True).alias("dataset_idx"))


@query(
    "retention_t6_checkpoints",
    """SELECT * FROM (SELECT o_orderkey AS step, o_totalprice AS metric FROM orders ORDER BY step DESC LIMIT 3)
       UNION SELECT * FROM (SELECT o_orderkey AS step, o_totalprice AS metric FROM orders ORDER BY metric, step LIMIT 1)""",
)
def checkpoints(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("metric"))
    return S.kept_checkpoints(rows, "step", "metric", 3)
