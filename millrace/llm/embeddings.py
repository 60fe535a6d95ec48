"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batches_of
from millrace.operators.components import components, local_components
from millrace.session import scratched, settle

MIN_COSINE = 0.98
#: Principal dimensions whose grid cells order the vectors.
GRID_DIMS = 8
#: Principal dimensions of the bounding boxes.
BOX_DIMS = 24
#: Vectors of a block, the unit that is sent to tasks, and of the smallest interval joined whole.
BLOCK, LEAF = 512, 64
_SLACK = 1e-9


def _matrix(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no digit, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b, from the given components."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _basis(classes: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """Of each dimension the principal axes, strongest first, from all vectors. Partitions send sums, which a few tasks add up."""

    def total(gram: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(gram), pa.int32()), pa.array([g.tobytes() for g in gram.values()], pa.binary())], names=["dim", "gram"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram: dict[int, np.ndarray] = {}
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                x = _unit(_scaled(_matrix(batch.filter(pa.array(dim == d)), "v", d)))
                x = np.c_[x, np.ones(len(x))]
                gram[d] = gram.get(d, 0) + x.T @ x
        yield from total(gram)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, g in zip(batch.column("dim").to_pylist(), batch.column("gram").to_pylist(), strict=True):
                gram[d] = gram.get(d, 0) + np.frombuffer(g).reshape(d + 1, d + 1)
        yield from total(gram)

    schema = "dim int, gram binary"
    sums: dict[int, np.ndarray] = {}
    for r in classes.select("dim", "v").mapInArrow(each, schema).repartition(4).mapInArrow(some, schema).collect():
        sums[r["dim"]] = sums.get(r["dim"], 0) + np.frombuffer(r["gram"]).reshape(r["dim"] + 1, r["dim"] + 1)
    axes = {}
    for d in dims:
        g = sums[d]
        n, mean = g[d, d], g[d, :d] / g[d, d]
        axes[d] = np.linalg.eigh(g[:d, :d] / n - np.outer(mean, mean))[1][:, ::-1].copy()
    return axes


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """The vectors in epsilon grid order, cut into sequence intervals with their boxes."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                own = batch.filter(pa.array(dim == d))
                x = _scaled(_matrix(own, "v", d))
                y = _unit(x) @ axes[d][:, :GRID_DIMS]
                cells = np.zeros((len(y), GRID_DIMS), np.int32)
                k = min(d, GRID_DIMS)
                cells[:, :k] = np.floor(y[:, :k] / eps)
                yield pa.RecordBatch.from_arrays(
                    [own.column(c) for c in ("label", "dim", "id", "n")] + [pa.array(cells[:, i]) for i in range(GRID_DIMS)] + [pa.array([v.tobytes() for v in x], pa.binary())],
                    names=["label", "dim", "id", "n", *(f"c{i}" for i in range(GRID_DIMS)), "v"],
                )

    names = [f"c{i}" for i in range(GRID_DIMS)]
    placed = classes.mapInArrow(rotate, "label long, dim int, id long, n long, " + ", ".join(f"{c} int" for c in names) + ", v binary")
    placed = placed.repartitionByRange("label", "dim", *names, "id").sortWithinPartitions("label", "dim", *names, "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: pa.Table | None = None

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            d = rows.column("dim")[0].as_py()
            x = np.frombuffer(b"".join(rows.column("v").to_pylist())).reshape(-1, d)
            made += 1
            y = _unit(x) @ axes[d][:, :BOX_DIMS]
            low, high = y.min(0), y.max(0)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) | made]), rows.column("label").slice(0, 1).combine_chunks(), pa.array([d], pa.int32()),
                    pa.array([int(np.floor(low[0] / eps))]), pa.array([int(np.floor(high[0] / eps))]),
                    pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([high.tolist()], pa.list_(pa.float64())),
                    pa.array([rows.column("id").to_numpy().tobytes()], pa.binary()), pa.array([rows.column("n").to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
                ],
                names=["block", "label", "dim", "first", "last", "low", "high", "ids", "ns", "m"],
            )

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            label, dim = rows.column("label").to_numpy(), rows.column("dim").to_numpy()
            edges = np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1
            at = 0
            for end in [*edges.tolist(), rows.num_rows]:
                last = end == rows.num_rows
                while at < end and not (last and end - at < BLOCK):
                    to = min(end, at + BLOCK)
                    yield block(rows.slice(at, to - at))
                    at = to
            held = rows.slice(at).combine_chunks() if at < rows.num_rows else None
        if held is not None:
            yield block(held)

    return placed.mapInArrow(cut, "block long, label long, dim int, first long, last long, low array<double>, high array<double>, ids binary, ns binary, m binary")


def _join(va: np.ndarray, vb: np.ndarray, axes: np.ndarray, same: bool, cosine: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The linked positions of two sequences, by halving intervals and skipping those whose boxes are further apart than eps.

    Products of rotated vectors are off in the last digits; pairs so near the threshold that it
    matters are judged by the cosine of the given components.
    """
    a, b = _unit(va) @ axes, _unit(vb) @ axes

    def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(x), LEAF)
        y = x[:, :BOX_DIMS]
        return np.minimum.reduceat(y, at), np.maximum.reduceat(y, at)

    (la, ha), (lb, hb) = boxes(a), boxes(b)
    todo = [(0, len(la), 0, len(lb))]
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i:
            continue
        gap = np.maximum(0, np.maximum(lb[k:m].min(0) - ha[i:j].max(0), la[i:j].min(0) - hb[k:m].max(0)))
        if (gap * gap).sum() > eps * eps + _SLACK:
            continue
        if j - i == 1 and m - k == 1:
            product = a[i * LEAF : j * LEAF] @ b[k * LEAF : m * LEAF].T
            x, y = np.nonzero(product >= cosine - _SLACK)
            keep = product[x, y] >= cosine + _SLACK
            x, y = x + i * LEAF, y + k * LEAF
            close = np.flatnonzero(~keep)
            keep[close] = _exact(va[x[close]], vb[y[close]]) >= cosine
            if same:
                keep &= x < y
            yield x[keep], y[keep]
        elif j - i >= m - k:
            mid = (i + j) // 2
            todo += [(i, mid, k, m), (mid, j, k, m)]
        else:
            mid = (k + m) // 2
            todo += [(i, j, k, mid), (i, j, mid, m)]


@scratched
def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = MIN_COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; links join vectors of one label with at least this cosine.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those
    without label, link with nothing; vectors of different dimension do not link. Equal
    vectors are one class with a weight, so their links are counted, not made; between
    classes a task adds up its links and hands on a spanning forest only, so the rows stay
    proportional to vectors and pairs of near blocks, however many links there are. The key
    is taken to identify a vector; a vector with a null key links like any other, and a
    component of null keys alone has a null id. An empty table gives no rows. A cosine equal to
    the threshold links: it is taken from the given components, in double precision.
    """
    spark = df.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine + 4 * _SLACK))
    rows = df.select(df[key].cast("long").alias("id"), df[label].cast("long").alias("label"), df[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", usable)
    good = rows.where("ok")
    # min of the keys may be null, so classes are joined by a number of their own; written, so it stays
    classes = good.groupBy("label", "v").agg(F.min("id").alias("key"), F.count(F.lit(1)).alias("n"))
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    own = classes.select("label", F.size("v").alias("dim"), "id", "n", "v")
    dims = [r["dim"] for r in own.select("dim").distinct().collect()]
    with batches_of(spark, 1000):
        axes = _basis(own, dims)
        blocks = settle(_blocks(own, axes, eps), "blocks")
    meta = blocks.select("block", "label", "dim", "first", "last", "low", "high")
    left = meta.select("label", "dim", F.col("block").alias("a"), F.col("first").alias("fa"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence("first", "last")).alias("cell"))
    right = meta.select(
        "label", "dim", F.col("block").alias("b"), F.col("first").alias("fb"), F.col("low").alias("lb"), F.col("high").alias("hb"),
        F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("cell"),
    )
    gaps = F.zip_with(
        F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    near = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= eps * eps + _SLACK
    pairs = left.join(right, ["label", "dim", "cell"]).where((F.col("a") <= F.col("b")) & (F.col("cell") == F.greatest(F.col("fa"), F.col("fb") - 1)) & near).select("a", "b")
    body = blocks.select("block", "dim", "ids", "ns", "m")
    pairs = pairs.join(body.select(F.col("block").alias("a"), "dim", F.col("ids").alias("ia"), F.col("ns").alias("na"), F.col("m").alias("ma")), "a")
    pairs = pairs.join(body.select(F.col("block").alias("b"), F.col("ids").alias("ib"), F.col("ns").alias("nb"), F.col("m").alias("mb")), "b")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b, dim, ia, na, ma, ib, nb, mb = (batch.column(c)[r].as_py() for c in ("a", "b", "dim", "ia", "na", "ma", "ib", "nb", "mb"))
                ia, ib, na, nb = (np.frombuffer(x, np.int64) for x in (ia, ib, na, nb))
                ma, mb = (np.frombuffer(x).reshape(-1, dim) for x in (ma, mb))
                found = list(_join(ma, mb, axes[dim], a == b, cosine, eps))
                x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                if not len(x):
                    continue
                ca = np.bincount(x, weights=nb[y], minlength=len(ia)).astype(np.int64)
                cb = np.bincount(y, weights=na[x], minlength=len(ib)).astype(np.int64)
                nodes, roots = local_components(ia[x], ib[y])
                ids = np.concatenate([ia[ca > 0], ib[cb > 0]])
                counts = np.concatenate([ca[ca > 0], cb[cb > 0]])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(roots[np.searchsorted(nodes, ids)])], names=["id", "links", "root"])

    with batches_of(spark, 16):
        found = settle(pairs.mapInArrow(link, "id long, links long, root long"), "links")
    groups = components(found.where("id <> root"), "id", "root")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    judged = classes.join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = judged.groupBy("component").agg(F.min("key").alias("component_id"))
    judged = judged.join(least, "component").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = good.join(judged, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))).select("id", "n_links", "component_id")
    rest = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
