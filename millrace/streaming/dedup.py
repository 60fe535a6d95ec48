"""Incremental exact dedup over a stream: the batch operator's decision, one file slice at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.dedup import digest

STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _first_of_each(key: tuple[str], rows: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Of a digest that was never met, the row with the lowest seq stays; all others are removed."""
    part = pd.concat(list(rows))
    part = part.sort_values("seq", kind="stable", na_position="last")
    kept = [not state.exists] + [False] * (len(part) - 1)
    if not state.exists:
        state.update((None if pd.isna(part["seq"].iloc[0]) else int(part["seq"].iloc[0]),))
    (first,) = state.get
    yield pd.DataFrame({"seq": part["seq"].astype("Int64"), "kept": kept, "kept_seq": pd.array([first] * len(part), "Int64"), "digest": key[0]})


def dedup_stream(stream: DataFrame, text: str, seq: str) -> DataFrame:
    """(seq, kept, kept_seq, digest) of every row of a stream, in append mode; kept_seq is the seq of the row that stays.

    Only digests and seqs are shuffled and kept, one state entry a digest, so the state grows
    with the different texts and is spread over the shuffle partitions. Null texts are equal to
    each other. Where slices arrive by ascending seq, the result equals ``exact_dedup`` over all
    of them; a late lower seq does not take back what was decided.
    """
    own = stream.select(F.col(seq).cast("long").alias("seq"), digest(F.col(text)).alias("digest"))
    from pyspark.sql.streaming.state import GroupStateTimeout

    return own.groupBy("digest").applyInPandasWithState(_first_of_each, "seq long, kept boolean, kept_seq long, digest string", "first long", "append", GroupStateTimeout.NoTimeout)


def run_dedup(spark: SparkSession, source: str, schema: str, text: str, seq: str, out: str, checkpoint: str, files_a_batch: int = 1) -> StreamingQuery:
    """Take in all that lies in the source folder and was not taken in before, then stop: a restart goes on from the checkpoint.

    The Parquet sink's log names each batch's files once, so a batch that is done again after a
    failure does not add rows twice.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, STATE)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        query = dedup_stream(stream, text, seq).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return query
