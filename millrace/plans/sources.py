"""What sinks wrote, read back: sequences, splits and an index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import shared_dir, table
from millrace.sources import files


def _fresh(spark, name):
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


@query(
    "sink_k1_sequences",
    """SELECT coalesce(source, '') AS repo, 'f' || doc_id AS file_path, 2 AS n_context, (doc_id % 8)::INT AS intent_idx, sha256(coalesce(text, '')) AS sequence_id,
              [(doc_id % 50000)::INT, 2] AS target_ids FROM documents""",
)
def sequences_back(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    target = F.array((F.col("doc_id") % 50000).cast("int"), F.lit(2))
    rows = d.select(
        F.coalesce("source", F.lit("")).alias("repo"), F.concat(F.lit("f"), "doc_id").alias("file_path"), F.array(target, target).alias("context_ids"), target.alias("target_ids"),
        (F.col("doc_id") % 8).alias("intent_idx"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sequence_id"), F.lit("left out").alias("more"),
    )
    path = _fresh(spark, "sequences") + ".parquet"
    files.write_sequences(rows, path)
    back = files.load_rows(spark, path)
    return back.select("repo", "file_path", F.size("context_ids").alias("n_context"), F.col("intent_idx").cast("int").alias("intent_idx"), "sequence_id", "target_ids")


@query(
    "sink_k7_splits",
    "SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey % 10 < 9 GROUP BY ALL",
)
def splits_back(spark, sf_dir):
    place = F.when(F.col("o_orderkey") % 10 < 8, "train").when(F.col("o_orderkey") % 10 < 9, "val")
    path = _fresh(spark, "splits")
    files.write_splits(table(spark, sf_dir, "orders").select("o_orderkey", place.alias("split")), path)
    back = None
    for name, rows in files.load_splits(spark, path).items():
        one = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("keys")).select(F.lit(name).alias("split"), "n", "keys")
        back = one if back is None else back.unionByName(one)
    return back


@query(
    "sink_k4_index",
    "SELECT vec_id AS chunk_id, label::VARCHAR AS source, len(embedding) AS d, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
)
def index_back(spark, sf_dir):
    folder = _fresh(spark, "index")
    files.write_index(table(spark, sf_dir, "embeddings"), folder, "0123abcd-89ef4567", "vec_id", "embedding", "label")
    back = files.load_index(spark, folder, "0123abcd-89ef4567", checkpoint="0123", manifest="89ef4567")
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return back.select("chunk_id", "source", F.size("vector").cast("long").alias("d"), F.round(total, 6).alias("total"))
