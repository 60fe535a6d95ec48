"""Probes, bootstrap statistics and audits of numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import places
from millrace.session import settle

# Fixed values.
DRAWS, LEVEL = 1000, 0.95


def centroid_probe(train: DataFrame, test: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, predicted): the label of the nearer class mean by squared distance, the lower one on ties.

    Fewer or more than two classes predict the lowest. Means are taken per component in one
    aggregation of (label, place); only the means, one vector a class, reach the driver.
    """
    parts = train.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("mean"))
    means = parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m")).orderBy(label)
    found = [(r[label], [p["mean"] for p in r["m"]]) for r in means.limit(3).collect()]
    if not found:
        return test.select(key, label, F.lit(None).cast(test.schema[label].dataType).alias("predicted"))
    if len(found) != 2:
        return test.select(key, label, F.lit(found[0][0]).alias("predicted"))

    def distance(mean: list[float]) -> F.Column:
        gaps = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(m) for m in mean]), lambda x, m: (x - m) * (x - m))
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)

    (low, a), (high, b) = found
    return test.select(key, label, F.when(distance(a) <= distance(b), F.lit(low)).otherwise(F.lit(high)).alias("predicted"))


def logistic_probe(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, max_iter: int = 1000) -> DataFrame:
    """(key, label, predicted) of a logistic regression with a ridge penalty of 1 over all training rows, multinomial above two classes.

    Labels are integers from 0. Rows with a null label or vector are not learned from; a null
    vector predicts null. Of one class only, that class is predicted; without rows, null.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(label), F.max(label)).first()
    kind = test.schema[label].dataType
    if not n or least == most:
        return test.select(key, label, F.lit(least).cast(kind).alias("predicted"))
    features = array_to_vector(F.col(vector).cast("array<double>")).alias("features")
    # the penalty is per row in this solver
    fitted = LogisticRegression(maxIter=max_iter, regParam=1.0 / n, standardization=False, tol=1e-8).fit(rows.select(features, F.col(label).cast("double").alias("label")))
    known = test.where(F.col(vector).isNotNull())
    out = fitted.transform(known.select(F.col(key).alias("_key"), F.col(label).alias("_label"), features))
    out = out.select(F.col("_key").alias(key), F.col("_label").alias(label), F.col("prediction").cast(kind).alias("predicted"))
    return out.unionByName(test.where(F.col(vector).isNull()).select(key, label, F.lit(None).cast(kind).alias("predicted")))


def classification(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy and macro-F1 over the classes seen on either side; a class never predicted, or never true, has F1 0."""
    sides = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col(label) == F.col(predicted)).cast("int").alias("hit"))
    each = sides.groupBy("s.c").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum(F.col("hit") * F.col("s.t")).alias("h"))
    f1 = F.when((F.col("t") == 0) | (F.col("p") == 0) | (F.col("h") == 0), F.lit(0.0)).otherwise(2.0 * F.col("h") / (F.col("t") + F.col("p")))
    return each.agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def numbered(df: DataFrame, key: str, value: str) -> DataFrame:
    """Written (at, value): the rows numbered 0, 1, ... in the order of a unique key, by ranges."""
    return settle(places.numbered(df.select(key, value), [key]).select("at", value), "numbered")


#: MD5's rotations and constants.
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _digit_words(start: int, stop: int, at: int) -> list[np.ndarray]:
    """The message words, from that of byte ``at``, of the decimals start ... stop - 1 (all of one length) and the byte that ends a message."""
    number, digits = np.arange(start, stop), len(str(start))
    words = [np.zeros(stop - start, np.uint32) for _ in range((at % 4 + digits) // 4 + 1)]
    for k in range(digits):
        byte = (number // 10 ** (digits - 1 - k) % 10 + ord("0")).astype(np.uint32)
        words[(at % 4 + k) // 4] |= byte << np.uint32(8 * ((at + k) % 4))
    words[-1] |= np.uint32(0x80 << 8 * ((at + digits) % 4))
    return words


def _hashed(prefix: bytes, words: list[np.ndarray], digits: int) -> np.ndarray:
    """``hash_uniform`` of the texts prefix + number: the first 52 bits of their MD5 as a part of one. ``words`` are those of the numbers."""
    size, n = len(prefix) + digits, len(words[0])
    if size > 55:
        raise ValueError("the hashed text must fit one block")
    fixed = [int.from_bytes(prefix[i : i + 4], "little") for i in range(0, 64, 4)]
    fixed[14] = 8 * size
    first = len(prefix) // 4
    varied = {first + j: w | np.uint32(fixed[first]) if j == 0 else w for j, w in enumerate(words)}
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if g in varied:
            f += varied[g]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + fixed[g]) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_TURNS[i]), out=t)
        f >>= np.uint32(32 - _TURNS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    high = a.byteswap().astype(np.uint64) << np.uint64(20)
    return (high | (b.byteswap() >> np.uint32(12))).astype(np.float64) / float(1 << 52)


#: Picks that are hashed at once, rows of a piece of the values, of those a task holds, and groups of draws.
PICKS, PIECE, HELD, GROUPS = 1 << 14, 1 << 16, 1 << 23, 96


def _resampled(df: DataFrame, place: str, value: str, n: int, draws: int, seed: int) -> DataFrame:
    """(draw, mean) of draws with replacement; the i-th pick of a draw is the row at a place by ``hash_uniform`` of seed, draw and i.

    No row is made for a pick: a task hashes all picks of its draws and adds up the values at
    those that lie among the rows it holds, HELD at most. The values are sent once to each of
    at most GROUPS groups of draws; beyond HELD rows, each further HELD rows hash the picks anew.
    """
    groups, parts = min(GROUPS, draws), -(-n // HELD)
    rows = df.select((F.col(place) / PIECE).cast("int").alias("piece"), F.struct(F.col(place).alias("at"), F.col(value).cast("double").alias("v")).alias("row"))
    pieces = rows.groupBy("piece").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["v"]).alias("v"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = settle(pieces, "pieces").select(every.alias("g"), "piece", "v")
    to = F.col("g") * parts + (F.col("piece") * PIECE / HELD).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(g, piece, v) for batch in batches for g, piece, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
        if not found:
            return
        found.sort(key=lambda x: x[1])
        g, low = found[0][0], found[0][1] * PIECE
        held = pa.concat_arrays([v.values for _, _, v in found])
        known = held.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        held = held.fill_null(0.0).to_numpy()
        del found
        own = range(g, draws, groups)
        total, count = dict.fromkeys(own, 0.0), dict.fromkeys(own, 0)
        start = 0
        while start < n:
            digits = len(str(start))
            stop = min(start + PICKS, n, 10**digits)
            words = {at: _digit_words(start, stop, at) for at in range(4)}
            for draw in own:
                prefix = f"{seed}|{draw}|".encode()
                at = (_hashed(prefix, words[len(prefix) % 4], digits) * n).astype(np.int64)
                if parts > 1:
                    at -= low
                    at = at[(at >= 0) & (at < len(held))]
                total[draw] += float(held[at].sum())
                count[draw] += int(known[at].sum())
            start = stop
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(total.values())), pa.array(list(count.values()), pa.int64())], names=["draw", "total", "count"])

    sums = dealt.repartitionById(groups * parts, to).mapInArrow(run, "draw long, total double, count long")
    mean = F.when(F.sum("count") > 0, F.sum("total") / F.sum("count"))
    return settle(sums, "draws").groupBy("draw").agg(mean.alias("mean"))


def bootstrap_ci(df: DataFrame, place: str, value: str, draws: int = DRAWS, level: float = LEVEL, seed: int = 0) -> DataFrame:
    """One row: mean, std (n - 1), ci_low, ci_high, n, n_boot, level. df numbers its rows 0, 1, ... in ``place``; two at least."""
    n = df.count()
    if n < 2:
        raise ValueError("a bootstrap needs two samples at least")
    means = _resampled(df, place, value, n, draws, seed)
    tail = (1 - level) / 2
    bounds = means.agg(F.percentile("mean", F.lit(tail)).alias("ci_low"), F.percentile("mean", F.lit(1 - tail)).alias("ci_high"))
    whole = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))
    return whole.crossJoin(bounds).withColumn("n_boot", F.lit(draws)).withColumn("level", F.lit(level))  # two single rows


def paired_bootstrap_p(df: DataFrame, place: str, model: str, base: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: p, the share of resampled mean differences that are not above 0. Rows lacking a side are an error."""
    odd = df.where(F.col(model).isNull() | F.col(base).isNull()).limit(1).count()
    n = df.count()
    if odd or n < 2:
        raise ValueError("a paired bootstrap needs two complete pairs at least")
    means = _resampled(df.withColumn("_d", F.col(model) - F.col(base)), place, "_d", n, draws, seed)
    return means.agg(F.avg((F.col("mean") <= 0).cast("double")).alias("p"), F.lit(n).cast("long").alias("n"))


def coverage(df: DataFrame, words: str, vocabulary: DataFrame, threshold: float = 0.999) -> DataFrame:
    """One row: tokens, unknown, coverage, passes. vocabulary: (t). No tokens: 0 and false."""
    counts = df.select(F.explode(words).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(vocabulary.select("t", F.lit(True).alias("known")), "t", "left")
    total, missing = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)), F.lit(0))
    share = F.when(total > 0, 1 - missing / total).otherwise(F.lit(0.0))
    return known.agg(total.alias("tokens"), missing.alias("unknown"), share.alias("coverage")).withColumn("passes", F.col("coverage") >= threshold)


def effective_rank(df: DataFrame, vector: str) -> float:
    """exp of the entropy of the normalised singular values; the Gram matrix is summed by the tasks, so the driver gets one a task of a small fixed number."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(g) for batch in batches for g in batch.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([sum(parts).tobytes()], pa.binary())], names=["g"])

    rows = df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(gram, "g binary").repartition(4).mapInArrow(add, "g binary").collect()
    if not rows:
        return 0.0
    flat = sum(np.frombuffer(r["g"]) for r in rows)
    d = int(np.sqrt(len(flat)))
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(flat.reshape(d, d)), 0))
    p = s[s > 0] / s.sum()
    return float(np.exp(-(p * np.log(p + 1e-12)).sum()))


def sliced_gaussian(df: DataFrame, vector: str, directions: list[list[float]]) -> DataFrame:
    """One row: the mean over the unit directions of abs(variance - 1 / d) + abs(mean) of the projections; variance is unbiased."""
    d = len(directions[0])
    moments = []
    for i, u in enumerate(directions):
        p = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in u]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        moments.append((F.abs(F.coalesce(F.var_samp(p), F.lit(0.0)) - 1.0 / d) + F.abs(F.avg(p))).alias(f"m{i}"))
    one = df.agg(*moments)
    return one.select((sum((F.col(f"m{i}") for i in range(1, len(directions))), F.col("m0")) / len(directions)).alias("statistic"))
