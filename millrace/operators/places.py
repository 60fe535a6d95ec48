"""Numbering rows in an order without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle


def numbered(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), out: str = "at") -> DataFrame:
    """df with its rows numbered 0, 1, ... by ``order`` (unique together), anew within each value of ``within``.

    Rows are dealt by ranges of both, so a value that most rows have lies in many ranges; each
    range is numbered by itself and starts where those before it end. Only one count a range and
    value is gathered. Nulls are a value like others.
    """
    ranged = settle(df.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range", *within).agg(F.count(F.lit(1)).alias("_n"))
    # as many rows as ranges and values in them
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    match = F.col("_range") == F.col("_r")
    for i, c in enumerate(within):
        match &= F.col(c).eqNullSafe(F.col(f"_w{i}"))
    own = F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(starts, match).select(*df.columns, (F.col("_own") + F.col("_start")).cast("long").alias(out))
