"""Windows over ordered rows, quotas, seeded samples and training-feed operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import hash_uniform, padded
from millrace.operators.places import numbered

# Fixed values.
HISTORY, PREDICTIONS, STRIDE = 3, 1, 1
MAX_PER_INTENT = 12_000
INTENTS = (
    "extract-helper",
    "inline-helper",
    "comprehension-rewrite",
    "dataclass-migration",
    "exception-handling-cleanup",
    "loop-to-vectorized",
    "argument-defaulting",
    "none-typing-modernization",
)
IGNORED_LABEL = -100


def build_sequences(df: DataFrame, group: list[str], order: str, tokens: str, history: int = HISTORY, predictions: int = PREDICTIONS, stride: int = STRIDE) -> DataFrame:
    """(group, start, context, target) of every window of history + predictions + 1 ordered rows.

    Rows without tokens are left out first. The context is the first ``history`` rows, the
    target the next; the rows after it must exist but are not used. Groups never mix.
    """
    if min(history, predictions, stride) < 1:
        raise ValueError("history, predictions and stride must be positive")
    width = history + predictions + 1
    rows = df.where(F.size(F.coalesce(F.col(tokens), F.array())) > 0)
    by = Window.partitionBy(*group).orderBy(order)
    whole = Window.partitionBy(*group)
    rows = rows.select(
        *group,
        (F.row_number().over(by) - 1).alias("start"),
        F.collect_list(tokens).over(by.rowsBetween(0, history - 1)).alias("context"),
        F.lead(tokens, history).over(by).alias("target"),
        F.count(F.lit(1)).over(whole).alias("_n"),
    )
    return rows.where((F.col("start") <= F.col("_n") - width) & (F.col("start") % stride == 0)).drop("_n")


def apply_quotas(df: DataFrame, intent: str, seq: str, most: int = MAX_PER_INTENT) -> DataFrame:
    """df with retained: the first ``most`` rows of each intent; rows without intent overflow.

    Only one rank per intent is kept up to the quota on the map side (WindowGroupLimit), so
    an intent that most rows have is not sorted whole.
    """
    rank = F.row_number().over(Window.partitionBy(intent).orderBy(seq))
    first = df.where(F.col(intent).isNotNull()).select(intent, seq).withColumn("_r", rank).where(F.col("_r") <= most).select(F.col(intent).alias("_i"), F.col(seq).alias("_s"))
    joined = df.join(first, (F.col(intent) == F.col("_i")) & (F.col(seq) == F.col("_s")), "left")
    return joined.withColumn("retained", F.col("_s").isNotNull()).drop("_i", "_s")


def build_pool(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """The ids of a deterministic sample that does not depend on the order or repeats of its input."""
    ids = df.select(key).distinct()
    if size < 1 or size > ids.count():
        raise ValueError("the pool's size must lie between 1 and the number of ids")
    return ids.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), key).limit(size)


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int) -> DataFrame:
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_stratum).drop("_r")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight, one over the number of rows of its label; counts are joined back, not windowed."""
    counts = df.groupBy(F.col(label).alias("_l")).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return df.join(counts, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def balanced_draws(df: DataFrame, label: str, key: str, draws: int, seed: int) -> DataFrame:
    """(draw, label, key): each draw takes a class at even odds, then one of its rows, by hashed uniforms.

    Rows are numbered within their class by ranges, so a class of most rows is many tasks' work.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = counts.withColumn("_c", F.row_number().over(Window.orderBy(label)) - 1)  # as many rows as classes
    k = classes.count()
    rows = numbered(df.select(label, key), [key], [label], "_at")
    drawn = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.floor(hash_uniform(F.lit(seed), F.col("id"), F.lit("class")) * k).alias("_c"), hash_uniform(F.lit(seed), F.col("id"), F.lit("row")).alias("_u"))
    drawn = drawn.join(classes, "_c").withColumn("_at", F.floor(F.col("_u") * F.col("_n")).cast("long"))
    return drawn.join(rows, [label, "_at"]).select("draw", label, key)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with its place in a seeded order, as a sort key: no global row number is needed to read it in order."""
    return df.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))


def with_masked(df: DataFrame, ids: str, key: str, mask_id: int, share: float = 0.15, seed: int = 0, masked: str = "masked", labels: str = "labels") -> DataFrame:
    """df with masked ids and labels: a hashed share of positions shows mask_id and keeps its id as label; others have IGNORED_LABEL.

    Each position is drawn once: the draws are a column of their own, which both others read.
    """

    def draw(x: Column, i: Column) -> Column:
        return F.struct(x.alias("id"), (hash_uniform(F.lit(seed), F.col(key), i) < share).alias("hit"))

    drawn = df.withColumn("_drawn", F.transform(ids, draw))
    shown = F.transform("_drawn", lambda d: F.when(d["hit"], F.lit(mask_id)).otherwise(d["id"]))
    kept = F.transform("_drawn", lambda d: F.when(d["hit"], d["id"]).otherwise(F.lit(IGNORED_LABEL)))
    return drawn.withColumns({masked: shown, labels: kept}).drop("_drawn")


def sequence_matrix(context: Column, target: Column, length: int, pad: int = 0) -> Column:
    """The rows of context and then target, each of exactly this length."""
    return F.transform(F.concat(context, F.array(target)), lambda ids: padded(ids, length, pad))


def pair_matrix(before: Column, after: Column, length: int, pad: int = 0) -> Column:
    """Both sides of a pair, each of exactly this length; null sides are padding."""
    return F.array(padded(before, length, pad), padded(after, length, pad))


def intent_index(name: Column, dataset: bool = False) -> Column:
    """Place in INTENTS, -1 for NONE; datasets give negatives one class past the end."""
    at = F.when(name == "NONE", F.lit(-1)).otherwise(F.array_position(F.array(*[F.lit(i) for i in INTENTS]), name).cast("int") - 1)
    return F.when(at < 0, F.lit(len(INTENTS))).otherwise(at) if dataset else at


def learning_rate(step: Column, warmup: int, total: int, peak: float, floor: float) -> Column:
    """Linear warm-up, then half a cosine down to the floor."""
    share = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share)))


def loss_monotonicity(df: DataFrame, step: str, loss: str, window: int, gate_steps: int) -> DataFrame:
    """(bucket, mean, ok) of each whole window of steps: ok stays false once a mean exceeds the one before."""
    each = df.where(F.col(step) < gate_steps).groupBy(F.floor(F.col(step) / window).alias("bucket")).agg(F.avg(loss).alias("mean"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == window)
    by = Window.orderBy("bucket")  # one row per window of steps
    up = F.coalesce(F.col("mean") > F.lag("mean").over(by), F.lit(False))
    return each.withColumn("_up", up).select("bucket", "mean", (~F.max("_up").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("ok"))


def kept_checkpoints(df: DataFrame, step: str, metric: str, last: int) -> DataFrame:
    """The last checkpoints by step and the best by metric."""
    recent = df.orderBy(F.col(step).desc()).limit(last)
    best = df.where(F.col(metric).isNotNull()).orderBy(F.col(metric).asc(), F.col(step).asc()).limit(1)
    return recent.unionByName(best).distinct()
