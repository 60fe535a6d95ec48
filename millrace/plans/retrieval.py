"""Vector and text retrieval with its metrics, on embeddings, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import retrieval as R
from millrace.plans.registry import query
from millrace.session import settle, table, widened

#: A search asks with every row whose id this divides, against all rows.
EVERY = 100

_SCORES = f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    scores AS (SELECT q.vec_id AS query, q.label AS query_label, e.vec_id, e.label, round(list_dot_product(q.v, e.v), 9) AS score FROM e q CROSS JOIN e WHERE q.vec_id % {EVERY} = 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scores QUALIFY rank <= 10)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _queries(spark, sf_dir):
    return _vectors(spark, sf_dir).where(F.col("vec_id") % EVERY == 0)


def _top(spark, sf_dir, k=10):
    return R.top_k(_vectors(spark, sf_dir), _queries(spark, sf_dir), "vec_id", "embedding", k)


@query("retrieval_t1_top_k", _SCORES + " SELECT query, vec_id, score, rank FROM top")
def top_k(spark, sf_dir):
    return _top(spark, sf_dir)


_RERANK = (
    _SCORES
    + """, passing AS (SELECT *, label = query_label AS passed FROM top),
    exps AS (SELECT *, CASE WHEN passed THEN exp((score - max(CASE WHEN passed THEN score END) OVER (PARTITION BY query)) / 0.1::DOUBLE) ELSE 0 END AS e FROM passing),
    conf AS (SELECT *, e / sum(e) OVER (PARTITION BY query) AS confidence FROM exps)"""
)


def _reranked(spark, sf_dir):
    labels = _vectors(spark, sf_dir).select("vec_id", "label")
    asked = labels.select(F.col("vec_id").alias("query"), F.col("label").alias("query_label"))
    found = _top(spark, sf_dir).join(labels, "vec_id").join(asked, "query")
    return R.rerank(found, F.col("label") == F.col("query_label"), 10)


@query("retrieval_r5_rerank", _RERANK + " SELECT query, vec_id, rank, passed, round(confidence, 9) AS confidence FROM conf")
def rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query", "vec_id", "rank", "passed", F.round("confidence", 9).alias("confidence"))


@query(
    "retrieval_r6_refusals",
    _RERANK
    + """ SELECT query, count(*) AS n, count(*) FILTER (passed) AS n_passed, round(max(confidence), 9) AS best,
           CASE WHEN count(*) FILTER (passed) = 0 THEN 'R006_SAFETY_CHECKER_REJECTED_ALL' WHEN max(confidence) < 0.55 THEN 'R005_CONFIDENCE_BELOW_THRESHOLD' END AS refusal FROM conf GROUP BY query""",
)
def refusals(spark, sf_dir):
    asked = _queries(spark, sf_dir).select(F.col("vec_id").alias("query"), F.col("embedding").isNotNull().alias("embedded"))
    out = R.refusals(asked, _reranked(spark, sf_dir))
    return out.withColumn("best", F.round("best", 9))


_RANKS = f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query, q.label, q.vec_id + 1 AS target, e.vec_id, round(list_dot_product(q.v, e.v), 9) AS score FROM e q CROSS JOIN e WHERE q.vec_id % {EVERY} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s),
    ranks AS (SELECT query, label, target, rank FROM r WHERE vec_id = target)"""


def _ranks(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = _queries(spark, sf_dir).select(F.col("vec_id").alias("query"), (F.col("vec_id") + 1).alias("target"), F.col("embedding").alias("qv"))
    pairs = asked.join(v.select(F.col("vec_id").alias("target"), F.col("embedding").alias("tv")), "target")
    return R.target_ranks(v, pairs, "vec_id", "embedding")


@query("retrieval_w7_target_rank", _RANKS + " SELECT query, target, rank FROM ranks")
def target_rank(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(
    "retrieval_a6_metrics",
    _RANKS
    + """ SELECT round(avg((rank <= 1)::INT::DOUBLE), 9) AS recall_1, round(avg((rank <= 5)::INT::DOUBLE), 9) AS recall_5, round(avg((rank <= 10)::INT::DOUBLE), 9) AS recall_10,
           round(avg(CASE WHEN rank <= 100 THEN 1.0::DOUBLE / rank ELSE 0 END), 9) AS mrr_zero, round(avg(CASE WHEN rank <= 100 THEN 1.0::DOUBLE / rank ELSE 1.0::DOUBLE / 101 END), 9) AS mrr_pool FROM ranks""",
)
def metrics(spark, sf_dir):
    ranks = _ranks(spark, sf_dir).withColumn("rank", F.when(F.col("rank") <= 100, F.col("rank")))
    out = R.ranking_metrics(ranks, "rank", F.lit(100))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("retrieval_t7_worst", _RANKS + " SELECT label, query, rank FROM ranks QUALIFY row_number() OVER (PARTITION BY label ORDER BY rank DESC, query) <= 2")
def worst(spark, sf_dir):
    labels = _vectors(spark, sf_dir).select(F.col("vec_id").alias("query"), "label")
    return R.worst_per_group(_ranks(spark, sf_dir).join(labels, "query"), "label", "rank", "query", 2).select("label", "query", "rank")


@query("retrieval_a8_hit_rate", _SCORES + " SELECT round(avg(hit::INT::DOUBLE), 9) AS hit_rate FROM (SELECT query, bool_or(vec_id <> query AND label = query_label) AS hit FROM top GROUP BY query)")
def hit_rate(spark, sf_dir):
    labels = _vectors(spark, sf_dir).select("vec_id", "label")
    found = _top(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("query_label")), "query")
    hits = found.groupBy("query").agg(F.bool_or((F.col("vec_id") != F.col("query")) & (F.col("label") == F.col("query_label"))).alias("hit"))
    return hits.agg(F.round(F.avg(F.col("hit").cast("double")), 9).alias("hit_rate"))


@query(
    "retrieval_a9_intent_gain",
    _SCORES
    + """, plain AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scores WHERE vec_id <> query QUALIFY vec_id = query + 1),
          kept AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scores WHERE vec_id <> query AND vec_id % 2 = 1 QUALIFY vec_id = query + 1)
         SELECT round((SELECT avg((rank <= 5)::INT::DOUBLE) FROM kept) - (SELECT avg((rank <= 5)::INT::DOUBLE) FROM plain), 9) AS gain_5""",
)
def intent_gain(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = _queries(spark, sf_dir).select(F.col("vec_id").alias("query"), (F.col("vec_id") + 1).alias("target"), F.col("embedding").alias("qv"))
    pairs = asked.join(v.select(F.col("vec_id").alias("target"), F.col("embedding").alias("tv")), "target")
    # a query's own row always comes first and does not count
    plain = R.target_ranks(v, pairs, "vec_id", "embedding").select(F.col("rank") - 1 <= 5)
    kept = R.target_ranks(v.where("vec_id % 2 = 1"), pairs, "vec_id", "embedding").select(F.col("rank") <= 5)
    a, b = (d.toDF("hit").agg(F.avg(F.col("hit").cast("double")).alias(n)) for d, n in ((kept, "a"), (plain, "b")))
    return a.crossJoin(b).select(F.round(F.col("a") - F.col("b"), 9).alias("gain_5"))  # two single rows


_NOISE = "list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i % 4 = 1 THEN 0.0::DOUBLE ELSE x END)"


def _perturbed(v):
    return F.transform(v.cast("array<double>"), lambda x, i: F.when(i % 4 == 0, F.lit(0.0)).otherwise(x))


@query(
    "robust_a10_rank_change",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, {_NOISE} AS p FROM embeddings),
        s AS (SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(q.v, e.v), 9) AS a, round(list_dot_product(q.p, e.v), 9) AS b FROM e q CROSS JOIN e WHERE q.vec_id % {EVERY} = 0 AND e.vec_id <> q.vec_id),
        t AS (SELECT query, arg_min(vec_id, (-a, vec_id)) AS x, arg_min(vec_id, (-b, vec_id)) AS y FROM s GROUP BY query)
        SELECT round(100.0::DOUBLE * avg((x <> y)::INT::DOUBLE), 9) AS rank_change_pct FROM t""",
)
def rank_change(spark, sf_dir):
    v, q = _vectors(spark, sf_dir), _queries(spark, sf_dir)

    def first(queries, name):
        # the best two, as a query may find itself
        found = R.top_k(v, queries, "vec_id", "embedding", 2).where("vec_id <> query")
        return found.groupBy("query").agg(F.min(F.struct("rank", "vec_id"))["vec_id"].alias(name))

    both = first(q, "x").join(first(q.withColumn("embedding", _perturbed(F.col("embedding"))), "y"), "query")
    return both.agg(F.round(100.0 * F.avg((F.col("x") != F.col("y")).cast("double")), 9).alias("rank_change_pct"))


@query("robust_a11_drift", f"SELECT round(1 - avg(list_dot_product(embedding::DOUBLE[], {_NOISE})), 9) AS drift FROM embeddings")
def drift(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(X.dot(F.col("embedding"), _perturbed(F.col("embedding"))).alias("d"))
    return rows.agg(F.round(1 - F.avg("d"), 9).alias("drift"))


@query("vector_r1_normalized", "SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 9) AS norm, round(u[1], 9) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-9)) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def normalized(spark, sf_dir):
    u = _vectors(spark, sf_dir).select("vec_id", X.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(X.dot(F.col("u"), F.col("u")), 9).alias("norm"), F.round(F.get("u", F.lit(0)), 9).alias("first"))


@query("lookup_j7_first_text", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents")
def first_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("first_id")), "h").select("doc_id", "first_id")


_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '')"
_BM25 = f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
    stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
    tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    q AS (SELECT item_id, t, count(*) AS qf FROM (SELECT item_id, unnest({_W}) AS t FROM benchmark) GROUP BY ALL),
    s AS (SELECT item_id AS query, doc_id, round(sum(qf * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.001::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
          FROM q JOIN df USING (t) JOIN tf USING (t) CROSS JOIN stats GROUP BY ALL)"""


@query("retrieval_r7_bm25", _BM25 + " SELECT query, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 5")
def bm25(spark, sf_dir):
    docs = widened(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.tokens(F.col("text")).alias("w"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("w"))
    return R.bm25_top(docs, "doc_id", "w", asked, "item_id", "w", 5).select("query", "doc_id", "score")


def _mmr_sql(picks, width, weight):
    """Greedy picks, one after another: of a query's candidates that with the most of weight * score - (1 - weight) * the highest likeness to a pick."""
    steps = [f"""cand AS (SELECT s.query, s.vec_id, s.score, e.v FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= {width}) s JOIN e USING (vec_id))""", f"pick1 AS (SELECT query, vec_id, v, 1 AS pick FROM cand QUALIFY row_number() OVER (PARTITION BY query ORDER BY {weight}::DOUBLE * score DESC, vec_id) = 1)", "sofar1 AS (SELECT * FROM pick1)"]
    for i in range(2, picks + 1):
        steps.append(
            f"""pick{i} AS (SELECT query, vec_id, v, {i} AS pick FROM (
                  SELECT c.query, c.vec_id, any_value(c.v) AS v, {weight}::DOUBLE * any_value(c.score) - {round(1 - weight, 9)}::DOUBLE * max(list_dot_product(c.v, p.v)) AS gain
                  FROM cand c JOIN sofar{i - 1} p ON p.query = c.query WHERE NOT EXISTS (SELECT 1 FROM sofar{i - 1} x WHERE x.query = c.query AND x.vec_id = c.vec_id) GROUP BY c.query, c.vec_id)
                QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(gain, 9) DESC, vec_id) = 1)"""
        )
        steps.append(f"sofar{i} AS (SELECT * FROM sofar{i - 1} UNION ALL SELECT * FROM pick{i})")
    return ", ".join(steps) + f" SELECT query, vec_id, pick FROM sofar{picks}"


@query("retrieval_r10_mmr", _SCORES + ", " + _mmr_sql(5, 20, 0.7))
def diverse(spark, sf_dir):
    found = settle(_top(spark, sf_dir, 20), "mmr")
    return R.mmr(found.join(_vectors(spark, sf_dir).select("vec_id", "embedding"), "vec_id"), "embedding", "vec_id", 5)
