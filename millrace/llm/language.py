"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained on the driver with follow-the-regularised-leader (proximal, elastic net) from a
bounded, hash-chosen sample of labelled documents, then calibrated with one temperature.
The sample's features are counted on the executors, so the driver gets at most
``per_language`` sparse count vectors of ``DIM`` entries for each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import pieces, release, released, small_batches

DIM = 1 << 15
ORDERS = 3
#: Labelled documents of each language that the classifier is fitted on, at most.
PER_LANGUAGE = 500
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def grams(text: str) -> np.ndarray:
    """The buckets of all 1- to ORDERS-grams of the lower-cased text's code points, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found, h = [], np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(min(ORDERS, len(c))):
            h = (h[: len(c) - n] ^ c[n:]) * _MULTIPLIERS[n]
            h ^= h >> np.uint32(15)
            found.append((h * np.uint32(668265263)) >> np.uint32(17))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(text), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # float32[DIM]
    weights: np.ndarray  # float32[DIM, languages]
    bias: np.ndarray
    temperature: float

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*counted(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(
    languages: list[str],
    rows: list[tuple[int, np.ndarray, np.ndarray]],
    epochs: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-3,
    calibrate: float = 0.2,
    seed: int = 17,
) -> Model:
    """rows: (language's number, buckets, counts). The last ``calibrate`` share of them only sets the temperature."""
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    cut = len(rows) - int(len(rows) * calibrate)
    df = np.zeros(DIM)
    for _, at, _ in rows:
        df[at] += 1
    k = len(languages)
    model = Model(languages, np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + 1, np.zeros((DIM, k), np.float32), np.zeros(k), 1.0)
    inputs = [(y, at, model.features(at, counts)) for y, at, counts in rows]
    # one more coordinate, the bias, without penalty
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(at: np.ndarray, bias: bool) -> np.ndarray:
        rate, zz = (beta + np.sqrt(n[at])) / alpha, z[at]
        if bias:
            return -zz / rate
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / (rate + l2))

    last = np.array([DIM])
    for _ in range(epochs):
        for i in rng.permutation(cut):
            y, at, x = inputs[i]
            w, b = weights(at, False), weights(last, True)
            error = softmax(x @ w + b[0])
            error[y] -= 1
            for where, grad, now in ((at, x[:, None] * error, w), (last, error[None, :], b)):
                sigma = (np.sqrt(n[where] + grad**2) - np.sqrt(n[where])) / alpha
                z[where] += grad - sigma * now
                n[where] += grad**2
    model.weights = weights(np.arange(DIM), False).astype(np.float32)
    model.bias = weights(last, True)[0]
    held = [(y, model.logits(at, counts)) for y, at, counts in rows[cut:]]
    if held:
        grid = np.exp(np.linspace(np.log(0.02), np.log(10), 61))
        losses = [np.mean([-np.log(max(softmax(s / t)[y], 1e-12)) for y, s in held]) for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
    return model


def train(df: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows for which ``allowed`` is true and text and lang are not null.

    Of a language with more rows, those whose key and text hash lowest stay, so the choice does not
    depend on the layout; the threshold leaves twice per_language rows in the mean.
    """
    small_batches(df.sparkSession)
    rows = df.where(allowed & df[lang].isNotNull() & df[text].isNotNull()).select(
        df[lang].cast("string").alias("_lang"), F.pmod(F.xxhash64(df[key].cast("string"), df[text].cast("string"), F.lit("language")), F.lit(1 << 40)).alias("_order"), df[text].cast("string").alias("_text")
    )
    # one scan counts the languages, one takes their rows; the threshold spares most rows the ranking
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    # as many sizes as languages, for each of which a model holds DIM floats anyway
    below = rows.join(F.broadcast(sizes), "_lang").where(F.col("_order") < F.lit(float(1 << 40)) * 2 * per_language / F.col("_n"))
    order = Window.partitionBy("_lang").orderBy("_order", "_text")
    sample = below.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_language).select("_lang", "_order", "_rank", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                found = [counted(t) for t in part.column("_text").to_pylist()]
                lists = [pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("_lang"), part.column("_rank"), *lists], names=["_lang", "_rank", "at", "counts"])

    own = sample.mapInArrow(released(run), "_lang string, _rank int, at array<int>, counts array<int>").orderBy("_lang", "_rank").toArrow()
    names = own.column("_lang").to_pylist()
    languages = sorted(set(names))
    number = {name: i for i, name in enumerate(languages)}
    own = own.combine_chunks()
    at, counts = (own.column(c).combine_chunks() if isinstance(own.column(c), pa.ChunkedArray) else own.column(c) for c in ("at", "counts"))
    ends = np.concatenate([[0], np.cumsum([len(x) for x in at])]) if len(names) else np.zeros(1, np.int64)
    flat_at, flat_counts = (x.flatten().to_numpy().astype(np.int64) if len(names) else np.zeros(0, np.int64) for x in (at, counts))
    chosen = [(number[name], flat_at[a:b], flat_counts[a:b]) for name, a, b in zip(names, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    del own, at, counts
    release()
    return fit(languages, chosen) if chosen else Model([], np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros(0), 1.0)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score. Null texts, and those without a letter, are UNKNOWN with score 0.

    Columns of these names are replaced. The model, whose size is DIM times its languages, is
    broadcast; whole texts are scored in a narrow map.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    own = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "_text"):
                found = [m.predict(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*part.schema.names[:-1], "lang_pred", "score"],
                )

    schema = ", ".join([f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    return own.mapInArrow(released(run), schema)


def held_out(key: str = "doc_id") -> Column:
    """A fifth of the keys, by the CRC-32 of their decimal form; null keys too."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))
