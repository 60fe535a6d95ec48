"""Probes and statistics on embeddings, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import evals as V
from millrace.plans.registry import query
from millrace.session import table

_PROBE = """WITH e AS (SELECT vec_id, (label < 5)::INT AS y, embedding::DOUBLE[] AS v FROM embeddings),
    parts AS (SELECT y, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e WHERE vec_id % 2 = 0),
    means AS (SELECT y, list(m ORDER BY pos) AS m FROM (SELECT y, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY y),
    d AS (SELECT vec_id, e.y, means.y AS c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e CROSS JOIN means WHERE vec_id % 2 = 1),
    p AS (SELECT vec_id, y AS label, arg_min(c, (round(d, 12), c)) AS predicted FROM d GROUP BY ALL)"""


def _probe(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("label"), "embedding")
    return V.centroid_probe(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "embedding", "label")


@query("probe_a12_centroid", _PROBE + " SELECT * FROM p")
def centroid(spark, sf_dir):
    return _probe(spark, sf_dir)


@query(
    "probe_a13_macro_f1",
    _PROBE
    + """, c AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT predicted FROM p),
         f AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS t, (SELECT count(*) FROM p WHERE predicted = c) AS q, (SELECT count(*) FROM p WHERE label = c AND predicted = c) AS h FROM c)
         SELECT round(sum(h)::DOUBLE / sum(t), 9) AS accuracy, round(avg(CASE WHEN h = 0 THEN 0 ELSE 2.0::DOUBLE * h / (t + q) END), 9) AS macro_f1 FROM f""",
)
def macro_f1(spark, sf_dir):
    return V.classification(_probe(spark, sf_dir), "label", "predicted").select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query("eval_a15_pass_rate", "SELECT event_type, round(avg((value > 50)::INT::DOUBLE), 9) AS pass_rate, count(*) AS n FROM events GROUP BY event_type")
def pass_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") > 50).cast("double")), 9).alias("pass_rate"), F.count(F.lit(1)).alias("n"))


_PICKS = "SELECT draw, floor(('0x' || md5('{seed}|' || draw || '|' || i)[1:13])::BIGINT::DOUBLE / 4503599627370496 * n)::BIGINT AS pos FROM range({draws}) d(draw) CROSS JOIN (SELECT unnest(range(n)) AS i, n FROM (SELECT count(*) AS n FROM customer)) r"


@query(
    "stats_a16_bootstrap",
    f"""WITH s AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
        picks AS ({_PICKS.format(seed=0, draws=1000)}),
        m AS (SELECT draw, avg(c_acctbal) AS mean FROM picks JOIN s USING (pos) GROUP BY draw)
        SELECT (SELECT round(avg(c_acctbal), 5) FROM s) AS mean, (SELECT round(stddev_samp(c_acctbal), 5) FROM s) AS std, (SELECT count(*) FROM s) AS n, 1000 AS n_boot, 0.95::DOUBLE AS level,
               round(quantile_cont(mean, 0.025), 5) AS ci_low, round(quantile_cont(mean, 0.975), 5) AS ci_high FROM m""",
)
def bootstrap(spark, sf_dir):
    s = V.numbered(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")
    out = V.bootstrap_ci(s, "at", "c_acctbal")
    return out.select(*[F.round(c, 5).alias(c) for c in ("mean", "std", "ci_low", "ci_high")], "n", "n_boot", "level")


@query(
    "stats_a17_paired",
    f"""WITH s AS (SELECT c_acctbal - 4400 AS d, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
        picks AS ({_PICKS.format(seed=3, draws=10_000)}),
        m AS (SELECT draw, avg(d) AS mean FROM picks JOIN s USING (pos) GROUP BY draw)
        SELECT round(avg((mean <= 0)::INT::DOUBLE), 9) AS p, (SELECT count(*) FROM s) AS n FROM m""",
)
def paired(spark, sf_dir):
    s = V.numbered(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal").withColumn("base", F.lit(4400.0))
    return V.paired_bootstrap_p(s, "at", "c_acctbal", "base", seed=3).select(F.round("p", 9).alias("p"), "n")


_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '')"


@query(
    "tokens_a18_coverage",
    f"""WITH v AS (SELECT DISTINCT unnest({_W}) AS t FROM benchmark), w AS (SELECT unnest({_W}) AS t FROM documents),
        c AS (SELECT count(*) AS tokens, count(*) FILTER (t NOT IN (SELECT t FROM v)) AS unknown FROM w)
        SELECT tokens, unknown, round(1 - unknown::DOUBLE / tokens, 9) AS coverage, 1 - unknown::DOUBLE / tokens >= 0.999 AS passes FROM c""",
)
def coverage(spark, sf_dir):
    vocabulary = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("t")).distinct()
    out = V.coverage(table(spark, sf_dir, "documents").select(X.tokens(F.col("text")).alias("w")), "w", vocabulary)
    return out.withColumn("coverage", F.round("coverage", 9))


@query("stats_a19_effective_rank")
def effective_rank(spark, sf_dir):
    return spark.createDataFrame([(V.effective_rank(table(spark, sf_dir, "embeddings"), "embedding"),)], "effective_rank double")


_DIRECTIONS = [[1.0 if (j >> i) & 1 else -1.0 for j in range(64)] for i in range(6)]
_UNITS = [[x / 8.0 for x in d] for d in _DIRECTIONS]


@query(
    "stats_a24_sliced_gaussian",
    f"""WITH u(i, u) AS (VALUES {", ".join(f"({i}, {d}::DOUBLE[])" for i, d in enumerate(_UNITS))}),
        p AS (SELECT i, list_dot_product(embedding::DOUBLE[], u) AS p FROM embeddings CROSS JOIN u)
        SELECT round(avg(m), 9) AS statistic FROM (SELECT i, abs(var_samp(p) - 1.0::DOUBLE / 64) + abs(avg(p)) AS m FROM p GROUP BY i)""",
)
def sliced(spark, sf_dir):
    return V.sliced_gaussian(table(spark, sf_dir, "embeddings"), "embedding", _UNITS).select(F.round("statistic", 9).alias("statistic"))


@query("stats_a21_means", "SELECT event_type, round(avg(value), 6) AS value, round(avg(length(props)), 6) AS size FROM events GROUP BY event_type")
def means(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("value"), F.round(F.avg(F.length("props")), 6).alias("size"))


@query("probe_a14_logistic")
def logistic(spark, sf_dir):
    """Accuracy and macro-F1 over the ten labels, of a probe trained on the even rows; tested against a solver of its own."""
    e = table(spark, sf_dir, "embeddings")
    out = V.logistic_probe(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "embedding", "label")
    return V.classification(out, "label", "predicted").select(F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


@query(
    "pool_r2_mean",
    """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id % 2 AS m FROM embeddings)
       SELECT vec_id, list_transform(range(1, 5), lambda i: round((v[i] + m * v[i + 4]) / (1 + m), 6)) AS pooled FROM p""",
)
def mean_pool(spark, sf_dir):
    """Of each vector the first two four-component parts as states, the second under a mask."""
    states = F.array(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4))
    pooled = X.mean_pooled(states, F.array(F.lit(1), (F.col("vec_id") % 2).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(pooled, lambda x: F.round(x, 6)).alias("pooled"))
