"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle

#: Ranking values of a source are counted in so many steps a unit of their logarithm; only the step at the border is sorted.
STEPS = 1 << 12
CYCLE = (3, 1, 2)
#: All sources' targets together, and one source's at most, as a share of the sizes.
TOTAL, MOST = 1.5, 2.0

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(df: DataFrame, source: str, size: str) -> DataFrame:
    """One row per source: (source, source_size, n, target).

    Sources by code point, null last, weigh 3, 1, 2, repeating. The water level is the level
    at which the sources below their cap share what the capped ones leave: of the levels that
    capping the first 0, 1, 2, ... sources would give, the highest that caps no further one.
    """
    sums = df.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(CYCLE)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in CYCLE]), place + 1)
    sums = sums.withColumn("weight", weight).withColumn("most", F.lit(MOST) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("_source").asc_nulls_first())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.lit(TOTAL) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    level = F.when(level * F.col("weight") <= F.col("most"), level)
    return sums.withColumn("level", level).select(
        "_source", "source_size", "n", F.coalesce(F.least(F.col("most"), F.max("level").over(whole) * F.col("weight")), F.col("most")).alias("target")
    )


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix") -> DataFrame:
    """(key, source, size, source_size, target, taken) of every row.

    A source with target r times its size gives every document floor(r) certain copies; what
    is left of the target is a Pareto sample: documents by random odds u / (1 - u) over
    inclusion odds, which fall with the root of their size, in that order up to the number of
    words left, to the nearest document. Empty and null texts have size 0 and nothing taken.
    Equal keys have one random value; ties go by key. Per source, the words are summed in
    STEPS steps of each unit of the ranking value's logarithm before the one shuffle of rows;
    only the border step's rows are sorted. Whatever the share and the sizes, a step holds no
    more than about a part of 4 * STEPS of a source (a logistic variable's density is at most
    1/4), so no source is sorted whole.
    """
    own = df.select(df[key].alias("_key"), df[source].cast("string").alias("_source"), word_count(df[text].cast("string")).alias("size"))
    # the texts are read once; from here on rows are a few bytes
    own = settle(own, "sizes")
    goal = targets(own, "_source", "size")
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("_key").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("copies")).otherwise(F.lit(0.0)))
    goal = goal.withColumn("room", F.col("target") - F.col("copies") * F.col("source_size"))
    rows = own.join(goal, own["_source"].eqNullSafe(goal["_source"])).drop(goal["_source"])
    u = (bits + 0.5) / float(1 << 52)
    odds = F.col("share") / (1.0 - F.col("share")) * F.sqrt(F.col("source_size") / F.col("n") / F.col("size"))
    rank = F.when((F.col("size") > 0) & (F.col("share") > 0), u / (1.0 - u) / odds)
    rows = rows.withColumn("_rank", rank).withColumn("_step", F.floor(F.ln("_rank") * STEPS))
    steps = rows.where(F.col("_rank").isNotNull()).groupBy("_source", "_step", "room").agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("_source").orderBy("_step")
    steps = steps.withColumn("_before", F.sum("_words").over(running) - F.col("_words"))
    # the border: the first step that does not fit whole
    border = steps.where(F.col("_before") + F.col("_words") > F.col("room")).groupBy("_source").agg(
        F.min("_step").alias("_border"), F.min("_before").alias("_base")
    )
    border = border.withColumnRenamed("_source", "_of")
    rows = rows.join(border, rows["_source"].eqNullSafe(border["_of"]), "left").drop("_of")
    at_border = F.col("_step") == F.col("_border")
    order = Window.partitionBy("_source").orderBy("_rank", "_key").rowsBetween(Window.unboundedPreceding, -1)
    border_rows = rows.where(at_border).withColumn("_so_far", F.col("_base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    other_rows = rows.where(~F.coalesce(at_border, F.lit(False))).withColumn("_so_far", F.lit(None).cast("long"))
    taken = (
        F.when(F.col("_rank").isNull(), F.lit(0))
        .when(F.col("_border").isNull() | (F.col("_step") < F.col("_border")), F.lit(1))
        .when(F.col("_so_far") + F.col("size") / 2 <= F.col("room"), F.lit(1))
        .otherwise(F.lit(0))
    )
    return border_rows.unionByName(other_rows).select(
        F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size", "target", ((F.col("copies") + taken) * F.col("size")).alias("taken")
    )
