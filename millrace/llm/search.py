"""Ranked lexical search by a blocked sparse matrix product.

The items' term multiplicities and the documents' int64 impacts are two sparse matrices. A block
of documents is turned to rows of terms; an item's row of the product merges the rows of its
terms (Gustavson), and only its best k documents leave the block. Item blocks are broadcast up to
a fixed size; more items take more passes over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, pieces, released, spread, text_column, word_values, words
from millrace.session import forget, scratched, settle

#: What parts terms: ASCII that is neither letter nor digit.
BETWEEN = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
TOP = 50
#: Text bytes of the items of one block, which bounds what is broadcast.
ITEM_BYTES = 16 << 20
#: Postings of a document block.
BLOCK_POSTINGS = 1 << 20
#: Tasks whose answers are merged first.
FAN_IN = 64
_NO_KEY = np.iinfo(np.int64).max


def term_rows(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of terms of each text, and (row, term number, occurrences) of those in the vocabulary."""
    data, starts = text_column(texts)
    data = LOWER[data]
    begin, end, rows = words(data, starts, BETWEEN)
    sizes = np.bincount(rows, minlength=len(texts))
    found = pc.index_in(word_values(data, begin, end), value_set=vocabulary).fill_null(-1).to_numpy()[::2].astype(np.int64)
    known = found >= 0
    keys, counts = np.unique(rows[known] * max(1, len(vocabulary)) + found[known], return_counts=True)
    return sizes, keys // max(1, len(vocabulary)), keys % max(1, len(vocabulary)), counts


class ItemBlock:
    """Some items as rows of (term number, multiplicity), over their own vocabulary."""

    def __init__(self, keys: list[object], texts: list[str | None], once: bool) -> None:
        self.keys = keys
        column = pa.array([t or "" for t in texts], pa.large_string())
        data, starts = text_column(column)
        begin, end, _ = words(LOWER[data], starts, BETWEEN)
        self.vocabulary = word_values(LOWER[data], begin, end).dictionary_encode().dictionary
        _, rows, self.terms, times = term_rows(column, self.vocabulary)
        self.times = np.ones_like(times) if once else times
        self.starts = np.searchsorted(rows, np.arange(len(keys) + 1))


def item_blocks(items: DataFrame, key: str, text: str, once: bool, limit: int = ITEM_BYTES) -> Iterator[ItemBlock]:
    """The items in blocks of about limit bytes; one longer item is a block of its own. One partition of items at a time is on the driver."""
    keys, texts, held = [], [], 0
    for r in items.select(items[key].alias("k"), items[text].cast("string").alias("t")).toLocalIterator():
        size = len((r.t or "").encode("utf-8", "surrogatepass")) + 100
        if keys and held + size > limit:
            yield ItemBlock(keys, texts, once)
            keys, texts, held = [], [], 0
        keys.append(r.k)
        texts.append(r.t)
        held += size
    if keys:
        yield ItemBlock(keys, texts, once)


def _postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc, n, terms, times) of every document with a term, as far as the terms are in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            for part in pieces(batch, "text"):
                sizes, rows, terms, times = term_rows(part.column("text"), known)
                offsets = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in (terms, times)]
                out = pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sizes), *lists], names=["doc", "n", "terms", "times"])
                yield out.filter(pa.array(sizes > 0))

    return docs.mapInArrow(run, "doc long, n long, terms array<int>, times array<int>")


def impacts(times: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """weight * ((10^9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L: int64."""
    m = 50 + 50 * n * n_docs // n_terms
    return weight * (1_000_000_000 * times // (1000 * times + 20 * m))


class Best:
    """The k best (score, doc) of an item so far: higher scores first, then lower docs."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        if len(score) > 4 * self.k:
            # all of the k-th score stay, since docs decide among them
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc = score[keep], doc[keep]
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def product(block: ItemBlock, best: list[Best], doc: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
    """Merge a block of documents into the items' best: postings (row in doc, term, impact)."""
    order = np.argsort(terms, kind="stable")
    rows, values = rows[order], values[order]
    ends = np.cumsum(np.bincount(terms, minlength=len(block.vocabulary)))
    starts = np.r_[0, ends[:-1]]
    highest = np.zeros(len(block.vocabulary), np.int64)
    used = np.flatnonzero(ends > starts)
    if len(used):
        highest[used] = np.maximum.reduceat(values, starts[used])
    total = np.zeros(len(doc), np.int64)
    for item, own in enumerate(best):
        mine = slice(block.starts[item], block.starts[item + 1])
        t, times = block.terms[mine], block.times[mine]
        if int((highest[t] * times).sum()) < own.least:
            # no document of the block can come in
            continue
        for a, b, c in zip(starts[t].tolist(), ends[t].tolist(), times.tolist(), strict=True):
            # a term's row names a document once, so plain indexed addition is right
            total[rows[a:b]] += values[a:b] if c == 1 else c * values[a:b]
        hit = np.flatnonzero(total >= own.least)
        if len(hit):
            own.add(total[hit], doc[hit])
        total[:] = 0


def _answers(postings: DataFrame, block: ItemBlock, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, task, doc, score): of each task the k best documents of each item."""
    shared = postings.sparkSession.sparkContext.broadcast((block, weights))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        best = [Best(k) for _ in own.keys]
        for batch in batches:
            sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            groups = (np.cumsum(sizes) - sizes) // BLOCK_POSTINGS
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                rows = np.repeat(np.arange(b - a), sizes[a:b])
                terms = part.column("terms").flatten().to_numpy()
                times = part.column("times").flatten().to_numpy().astype(np.int64)
                values = impacts(times, part.column("n").to_numpy()[rows], weight[terms], n_docs, n_terms)
                product(own, best, part.column("doc").to_numpy(), rows, terms, values)
        counts = [len(x.score) for x in best]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best), dtype=np.int32), counts)), pa.array(np.full(sum(counts), task, np.int32)), *(pa.array(np.concatenate([getattr(x, c) for x in best])) for c in ("doc", "score"))],
            names=["item", "task", "doc", "score"],
        )

    return postings.mapInArrow(run, "item int, task int, doc long, score long")


def _first(answers: DataFrame, k: int, *by: object) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@scratched
def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = TOP, once: bool = True) -> DataFrame:
    """(item key, rank, doc key, score): the k documents of the highest scores above 0 of every item.

    Terms are runs of ASCII letters and digits and all beyond ASCII, A-Z lower-cased; ``once``
    counts an item's repeated term once. Equal scores go by ascending key, null keys last.
    Every row of docs is a document and every row of items an item, repeated ones too; items
    without terms, and all items where no document has a term, have no answers. Documents and
    terms are counted over all rows. A pass over the texts keeps the postings of an item block's
    vocabulary; a task of the product holds one block of documents and k answers an item.
    """
    spark: SparkSession = docs.sparkSession
    own = docs.select(F.coalesce(docs[key].cast("long"), F.lit(_NO_KEY)).alias("doc"), docs[text].cast("string").alias("text"))
    key_kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    done = []
    for block in item_blocks(items, item_key, item_text, once):
        postings = settle(_postings(own, block.vocabulary), "postings")
        sums = postings.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weights = np.zeros(len(block.vocabulary), np.int64)
        # as many rows as the item block has terms
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[r["term"]] = math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * r["count"] + 1)))
        answers = _answers(postings, block, weights, sums["docs"], max(1, sums["terms"]), k)
        few = _first(answers, k, "item", F.floor(F.col("task") / FAN_IN)).drop("rank")
        ranked = _first(few, k, "item").select(F.col("item"), "rank", F.nullif("doc", F.lit(_NO_KEY)).cast(key_kind).alias("doc"), "score")
        names = spark.createDataFrame(list(enumerate(block.keys)), f"item int, item_key {item_kind.simpleString()}")
        done.append(settle(ranked.join(names, "item").select(F.col("item_key"), "rank", "doc", "score"), "ranked"))
        forget(postings)
    empty = spark.createDataFrame([], f"item_key {item_kind.simpleString()}, rank int, doc {key_kind}, score long")
    found = done[0] if done else empty
    for other in done[1:]:
        found = found.unionByName(other)
    return found.select(F.col("item_key").alias(item_key), "rank", F.col("doc").alias(key), "score")
