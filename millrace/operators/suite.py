"""A suite of benchmarks: all metrics of one in a single scan, all of them in one job, as a long table and one report."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SCHEMA_VERSION = "v1"

LONG = "benchmark_id string, seed long, group string, metric string, value double, n long"


@dataclass(frozen=True)
class Benchmark:
    """Rows and what is measured over them: name -> aggregate. ``by`` adds a line a value of each of these columns."""

    benchmark_id: str
    rows: DataFrame
    metrics: Mapping[str, Column]
    by: Sequence[str] = ()
    meta: Mapping[str, str] = field(default_factory=dict)

    def seed(self, global_seed: int = 0) -> int:
        """The first 32 bits of a digest of name and global seed, so that one benchmark can be run again alone."""
        return int(hashlib.sha256(f"{self.benchmark_id}:{global_seed}".encode()).hexdigest()[:8], 16)


def results(benchmark: Benchmark, global_seed: int = 0) -> DataFrame:
    """(benchmark_id, seed, group, metric, value, n): one scan whatever the number of metrics and groups.

    group is "" over all rows and "column=value" else; a null value is "column=" alone. Rows are
    pre-aggregated on the map side for all grouping sets at once. Without rows, n is 0 and the
    values are what the aggregates give for nothing.
    """
    if not benchmark.metrics:
        raise ValueError(f"{benchmark.benchmark_id}: nothing to measure")
    own = benchmark.rows
    aggregates = [c.cast("double").alias(f"_m{i}") for i, c in enumerate(benchmark.metrics.values())]
    count = F.count(F.lit(1)).alias("_n")
    if benchmark.by:
        sets = [[], *[[F.col(c)] for c in benchmark.by]]
        keys = [F.col(c) for c in benchmark.by]
        rows = own.groupingSets(sets, *keys).agg(*aggregates, count, F.grouping_id().alias("_g"))
        group = F.lit("")
        for place, c in enumerate(benchmark.by):
            # the bit of a column is 0 where it groups
            bit = 1 << (len(benchmark.by) - 1 - place)
            group = F.when(F.col("_g").bitwiseAND(bit) == 0, F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("")))).otherwise(group)
    else:
        rows, group = own.agg(*aggregates, count), F.lit("")
    lines = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"_m{i}").alias("value")) for i, name in enumerate(benchmark.metrics)])
    head = [F.lit(benchmark.benchmark_id).alias("benchmark_id"), F.lit(benchmark.seed(global_seed)).cast("long").alias("seed"), group.alias("group")]
    return rows.select(*head, F.inline(lines), F.col("_n").alias("n"))


def run_suite(benchmarks: Sequence[Benchmark], out: str, global_seed: int = 0) -> DataFrame:
    """Run all benchmarks in one job; returns their long table, read back from ``out``.

    out/metrics holds it, a folder a benchmark; out/results one line of JSON with
    schema_version, global_seed and the list of benchmarks, each with its seed, metrics by
    group, and meta. Names must differ. A folder that exists is an error.
    """
    names = [b.benchmark_id for b in benchmarks]
    if not names or len(set(names)) < len(names):
        raise ValueError("a suite needs benchmarks of different names")
    spark: SparkSession = benchmarks[0].rows.sparkSession
    table = reduce(DataFrame.unionByName, [results(b, global_seed) for b in benchmarks])
    table.write.partitionBy("benchmark_id").parquet(f"{out}/metrics")
    back = spark.read.schema(LONG).parquet(f"{out}/metrics")
    report(back, {b.benchmark_id: dict(b.meta) for b in benchmarks}, global_seed).write.text(f"{out}/results")
    return back.select("benchmark_id", "seed", "group", "metric", "value", "n")


def report(table: DataFrame, meta: Mapping[str, Mapping[str, str]], global_seed: int) -> DataFrame:
    """One row (value): the JSON of a suite's long table, in the order of names; it has one entry a metric and group, not a row of data."""
    by_group = table.groupBy("benchmark_id", "seed", "group").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"), F.max("n").alias("n"))
    each = by_group.groupBy("benchmark_id", "seed").agg(F.sort_array(F.collect_list(F.struct("group", F.to_json("metrics").alias("metrics"), "n"))).alias("groups"))
    kept = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.map_from_entries(F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in sorted(v.items())])) if v else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for k, v in sorted(meta.items())]))
    one = F.to_json(F.struct(F.col("benchmark_id"), F.transform("groups", lambda g: F.struct(g["group"].alias("group"), F.parse_json(g["metrics"]).alias("metrics"), g["n"].alias("n"))).alias("groups"), F.try_element_at(kept, F.col("benchmark_id")).alias("meta"), F.col("seed")))
    lines = each.agg(F.sort_array(F.collect_list(F.struct("benchmark_id", one.alias("json")))).alias("_all"))
    text = F.concat(F.lit('{"benchmarks":['), F.array_join(F.transform("_all", lambda x: x["json"]), ","), F.lit(f'],"global_seed":{int(global_seed)},"schema_version":"{SCHEMA_VERSION}"}}'))
    return lines.select(text.alias("value"))
