"""Exact vector search, BM25, re-ranking and ranking metrics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
REFUSAL_TAU, TEMPERATURE = 0.55, 0.1
K1, B = 1.5, 0.75
#: Vectors of a block: two blocks are what a task multiplies at once.
BLOCK_ROWS = 4096


def _blocked(df: DataFrame, longs: list[str], vectors: list[str]) -> DataFrame:
    """(block, dim, longs, vectors): rows packed into blocks of at most BLOCK_ROWS, columns as bytes, by dimension; rows without a key or vector are left out."""
    own = df.where(reduce(lambda x, y: x & y, [*(F.col(c).isNotNull() for c in longs), *(F.size(v) > 0 for v in vectors)])).select(*[F.col(c).cast("long") for c in longs], *[F.col(v).cast("array<double>") for v in vectors])
    names = ["block", "dim", *longs, *vectors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[pa.RecordBatch]] = {}

        def packed(rows: pa.Table, dim: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            raw = [rows.column(c).to_numpy().astype(np.int64).tobytes() for c in longs]
            raw += [rows.column(v).combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes() for v in vectors]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) | made]), pa.array([dim], pa.int32()), *(pa.array([r], pa.binary()) for r in raw)], names=names)

        for batch in batches:
            sizes = pc.list_value_length(batch.column(vectors[0])).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                rows = held.setdefault(dim, [])
                rows.append(batch.filter(pa.array(sizes == dim)))
                while sum(r.num_rows for r in rows) >= BLOCK_ROWS:
                    whole = pa.Table.from_batches(rows)
                    yield packed(whole.slice(0, BLOCK_ROWS), dim)
                    rows[:] = whole.slice(BLOCK_ROWS).to_batches()
        for dim, rows in held.items():
            if sum(r.num_rows for r in rows):
                yield packed(pa.Table.from_batches(rows), dim)

    return own.mapInArrow(run, ", ".join(["block long", "dim int", *(f"`{c}` binary" for c in (*longs, *vectors))]))


def _paired(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Every block of the index with every block of queries of its dimension.

    Each index block lies in one cell, query blocks in all of them, as many as there are shuffle
    partitions: an equi-join, in which no block passes the driver and either side may be large.
    """
    cells = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = index.withColumn("_cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
    theirs = asked.select(F.col("dim").alias("_dim"), *[F.col(c).alias(f"asked_{c}") for c in asked.columns if c != "dim"], F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_at"))
    return mine.join(theirs, (F.col("_cell") == F.col("_at")) & (F.col("dim") == F.col("_dim")))


def _row(batch: pa.RecordBatch, r: int, column: str, kind: type, dim: int | None = None) -> np.ndarray:
    flat = np.frombuffer(batch.column(column)[r].as_buffer(), kind)
    return flat if dim is None else flat.reshape(-1, dim)


def top_k(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """(query, key, score, rank): each query's k rows of largest inner product, ties by key.

    Blocks of rows are multiplied with blocks of queries, and k a query leave each product.
    Scores are rounded to ``digits`` before ranking. Rows and queries without a vector, or with
    one of another dimension, do not meet.
    """
    blocks = _paired(_blocked(index, [key], [vector]), _blocked(queries, [key], [vector])).select("dim", F.col(key).alias("_id"), F.col(vector).alias("_x"), F.col(f"asked_{key}").alias("_query"), F.col(f"asked_{vector}").alias("_q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, dim in enumerate(batch.column("dim").to_pylist()):
                ids, asked = _row(batch, r, "_id", np.int64), _row(batch, r, "_query", np.int64)
                score = np.round(_row(batch, r, "_q", np.float64, dim) @ _row(batch, r, "_x", np.float64, dim).T, digits)
                # all of the k-th score are taken, since keys decide among them
                least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else -np.inf
                q, x = np.nonzero(score >= least)
                order = np.lexsort((ids[x], -score[q, x], q))
                q, x = q[order], x[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, x = q[first], x[first]
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids[x]), pa.array(score[q, x])], names=["query", key, "score"])

    found = blocks.mapInArrow(run, f"query long, `{key}` long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def target_ranks(index: DataFrame, pairs: DataFrame, key: str, vector: str, digits: int = 9) -> DataFrame:
    """(query, target, rank) for pairs (query, target, query vector, target vector): 1 + the rows that score higher, or equal with a lower key.

    Only counts leave a product of blocks. A repeated pair is one; pairs without a vector have no rank.
    """
    asked = pairs.select("query", "target", "qv", "tv").dropDuplicates(["query", "target"]).where((F.size("qv") > 0) & (F.size("qv") == F.size("tv")))
    blocks = _paired(_blocked(index, [key], [vector]), _blocked(asked, ["query", "target"], ["qv", "tv"]))
    blocks = blocks.select("dim", F.col(key).alias("_id"), F.col(vector).alias("_x"), *[F.col(f"asked_{c}").alias(f"_{c}") for c in ("query", "target", "qv", "tv")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, dim in enumerate(batch.column("dim").to_pylist()):
                keys, targets = _row(batch, r, "_id", np.int64)[None, :], _row(batch, r, "_target", np.int64)
                q, t = _row(batch, r, "_qv", np.float64, dim), _row(batch, r, "_tv", np.float64, dim)
                own = np.round((q * t).sum(1), digits)[:, None]
                score = np.round(q @ _row(batch, r, "_x", np.float64, dim).T, digits)
                ahead = ((score > own) | ((score == own) & (keys < targets[:, None]))).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(_row(batch, r, "_query", np.int64)), pa.array(targets), pa.array(ahead)], names=["query", "target", "ahead"])

    none = asked.select(F.col("query").cast("long").alias("query"), F.col("target").cast("long").alias("target"), F.lit(0).cast("long").alias("ahead"))
    counted = blocks.mapInArrow(run, "query long, target long, ahead long").unionByName(none)
    return counted.groupBy("query", "target").agg((F.sum("ahead") + 1).alias("rank"))


def ranking_metrics(ranks: DataFrame, rank: str, pool: Column | None = None) -> DataFrame:
    """One row: recall at 1, 5 and 10, and MRR by both conventions: a missing target (null rank) counts as pool + 1, or as 0."""
    r = F.col(rank)
    recall = [F.coalesce(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(f"recall_{k}") for k in (1, 5, 10)]
    out = [*recall, F.coalesce(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), F.lit(0.0)).alias("mrr_zero")]
    if pool is not None:
        out.append(F.coalesce(F.avg(1.0 / F.coalesce(r, pool + 1)), F.lit(0.0)).alias("mrr_pool"))
    return ranks.agg(*out)


def rerank(candidates: DataFrame, passes: Column, k: int, temperature: float = TEMPERATURE) -> DataFrame:
    """The k best of each query, then the safety verdict, then softmax confidences over those that pass; rejected ones have 0.

    The cap comes before the verdict, as the verdict is the expensive part.
    """
    capped = candidates.where(F.col("rank") <= k).withColumn("passed", F.coalesce(passes, F.lit(False)))
    by = Window.partitionBy("query")
    most = F.max(F.when(F.col("passed"), F.col("score"))).over(by)
    capped = capped.withColumn("_e", F.when(F.col("passed"), F.exp((F.col("score") - most) / temperature)).otherwise(F.lit(0.0)))
    total = F.sum("_e").over(by)
    return capped.withColumn("confidence", F.when(total > 0, F.col("_e") / total).otherwise(F.lit(0.0))).drop("_e")


def refusals(queries: DataFrame, reranked: DataFrame, tau: float = REFUSAL_TAU) -> DataFrame:
    """(query, n, n_passed, best, refusal): R001 without a vector, R004 with nothing retrieved, R006 with nothing passing, R005 below tau, else null.

    queries: (query, embedded boolean).
    """
    sums = reranked.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.max("confidence").alias("best"))
    rows = queries.join(sums, "query", "left")
    n, passed = F.coalesce("n", F.lit(0)), F.coalesce("n_passed", F.lit(0))
    code = (
        F.when(~F.col("embedded"), "R001_SOURCE_PARSE_FAILED")
        .when(n == 0, "R004_NO_CANDIDATE_PASSED_ACCEPTANCE")
        .when(passed == 0, "R006_SAFETY_CHECKER_REJECTED_ALL")
        .when(F.col("best") < tau, "R005_CONFIDENCE_BELOW_THRESHOLD")
    )
    return rows.select("query", n.alias("n"), passed.alias("n_passed"), F.coalesce("best", F.lit(0.0)).alias("best"), code.alias("refusal"))


#: Bytes of the queries' words that are sent to every task at once; more queries take more passes.
QUERY_BYTES = 16 << 20


class _Asked:
    """Queries as rows of (word number, weight) over their own vocabulary; weights are idf times the word's count in the query."""

    def __init__(self, ids: list[int], words: list[list[str]]) -> None:
        self.ids = np.array(ids, np.int64)
        counts = [Counter(w) for w in words]
        self.vocabulary = pa.array(sorted({w for c in counts for w in c}), pa.large_string())
        number = {w: i for i, w in enumerate(self.vocabulary.to_pylist())}
        self.words = [np.array([number[w] for w in c], np.int64) for c in counts]
        self.counts = [np.array(list(c.values()), np.float64) for c in counts]


def _asked_blocks(queries: DataFrame, query: str, words: str, limit: int) -> Iterator[_Asked]:
    """Queries in blocks of about limit bytes; the driver holds one partition of them and one block."""
    ids, texts, held = [], [], 0
    for r in queries.select(F.col(query).cast("long").alias("q"), F.col(words).alias("w")).toLocalIterator():
        own = [t for t in r["w"] or [] if t is not None]
        size = sum(map(len, own)) + 100
        if ids and held + size > limit:
            yield _Asked(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(r["q"])
        texts.append(own)
        held += size
    if ids:
        yield _Asked(ids, texts)


def _known_words(corpus: DataFrame, words: str, vocabulary: pa.Array) -> DataFrame:
    """(number, n): in how many rows each word of the vocabulary occurs; tasks count, and send one row a word."""
    shared = corpus.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_string())
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            row, word, _ = _occurrences(batch.column(0), known)
            total += np.bincount(word, minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["number", "n"])

    return corpus.select(words).mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))


def _occurrences(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, occurrences) of the known words in a column of word lists."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    found = pc.index_in(lists.flatten().cast(pa.large_string()), value_set=known).fill_null(-1).to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(lists), dtype=np.int64), sizes)
    keys, times = np.unique(rows[found >= 0] * max(1, len(known)) + found[found >= 0], return_counts=True)
    return keys // max(1, len(known)), keys % max(1, len(known)), times


def bm25_top(corpus: DataFrame, key: str, words: str, queries: DataFrame, query: str, query_words: str, k: int, digits: int = 6, limit: int = QUERY_BYTES) -> DataFrame:
    """(query, key, score, rank): each query's k documents of the highest Okapi BM25, k1 = 1.5, b = 0.75, ties by key.

    idf is ln((N - df + 0.5) / (df + 0.5)), at least 1e-3, so no shared word counts against a
    document; a query's repeated words count each time; documents that share no word are not
    ranked. Scores are rounded before they are ranked. No word is a shuffle key: tasks score their
    documents against blocks of queries of at most ``limit`` bytes of words and keep k a query.
    A query whose best possible score in a batch, by the highest weight of each of its words
    there, is below its k-th score so far is not scored against that batch. Queries are few and
    numbered; null words and null lists are none.
    """
    sizes = corpus.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(F.coalesce(words, F.array().cast("array<string>")))).alias("mean")).first()
    n, mean = sizes["n"], sizes["mean"] or 1.0
    spark, found = corpus.sparkSession, None
    own = corpus.select(F.col(key).cast("long").alias(key), F.col(words).cast("array<string>").alias("_w"))
    for asked in _asked_blocks(queries, query, query_words, limit):
        idf = np.full(len(asked.vocabulary), 0.0)
        for r in _known_words(own.select("_w"), "_w", asked.vocabulary).toLocalIterator():
            idf[r["number"]] = max(math.log((n - r["n"] + 0.5) / (r["n"] + 0.5)), 1e-3)
        shared = spark.sparkContext.broadcast((asked, idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, idf = shared.value
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in asked.words]
            for batch in batches:
                lists, docs = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
                length = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                row, word, times = _occurrences(lists, asked.vocabulary)
                weight = idf[word] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[row] / mean))
                order = np.argsort(word, kind="stable")
                row, weight = row[order], weight[order]
                ends = np.cumsum(np.bincount(word, minlength=len(idf)))
                starts = np.r_[0, ends[:-1]].astype(np.int64)
                most = np.zeros(len(idf))
                used = np.flatnonzero(ends > starts)
                if len(used):
                    most[used] = np.maximum.reduceat(weight, starts[used])
                for i, (terms, counts) in enumerate(zip(asked.words, asked.counts, strict=True)):
                    score, doc = best[i]
                    least = score[-1] if len(score) == k else 0.0
                    if (most[terms] * counts).sum() < least - 10.0**-digits:
                        continue
                    total = np.zeros(len(docs))
                    for a, b, c in zip(starts[terms].tolist(), ends[terms].tolist(), counts.tolist(), strict=True):
                        total[row[a:b]] += c * weight[a:b]
                    hit = np.flatnonzero(total > max(0.0, least - 10.0**-digits))
                    score, doc = np.concatenate([score, np.round(total[hit], digits)]), np.concatenate([doc, docs[hit]])
                    first = np.lexsort((doc, -score))[:k]
                    best[i] = score[first], doc[first]
            counts = [len(s) for s, _ in best]
            if sum(counts):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.ids, counts)), pa.array(np.concatenate([d for _, d in best]).astype(np.int64)), pa.array(np.concatenate([s for s, _ in best]))], names=["query", key, "score"])

        part = own.mapInArrow(run, f"query long, `{key}` long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"query long, `{key}` long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(corpus: DataFrame, key: str, words: str, queries: DataFrame, query: str, query_words: str) -> DataFrame:
    """(query, key, score) of every document that shares a word with the query, by Okapi BM25 with k1 = 1.5, b = 0.75.

    idf is ln((N - df + 0.5) / (df + 0.5)), at least 1e-3, so no shared word counts against a
    document. The words are joined as an inverted index; a query's repeated words count each time.
    """
    terms = corpus.select(F.col(key).alias("_d"), F.size(words).alias("_dl"), F.explode(words).alias("_t"))
    tf = terms.groupBy("_d", "_dl", "_t").agg(F.count(F.lit(1)).alias("_tf"))
    sizes = corpus.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size(words)).alias("_avg")).first()
    n, mean = sizes["_n"], sizes["_avg"] or 1.0
    df = tf.groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))
    asked = queries.select(F.col(query).alias("query"), F.explode(query_words).alias("_t")).groupBy("query", "_t").agg(F.count(F.lit(1)).alias("_qf"))
    idf = F.greatest(F.ln((F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-3))
    asked = asked.join(df, "_t").withColumn("_idf", idf * F.col("_qf"))
    weight = F.col("_idf") * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_dl") / F.lit(mean)))
    return tf.join(asked, "_t").groupBy("query", F.col("_d").alias(key)).agg(F.sum(weight).alias("score"))


def worst_per_group(df: DataFrame, group: str, rank: str, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col(rank).desc(), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def mmr(candidates: DataFrame, vector: str, key: str, k: int, weight: float = 0.7) -> DataFrame:
    """(query, key, pick): greedy maximal marginal relevance among a query's candidates (query, key, score, vector), of which there are few."""

    def pick(rows):
        import pandas as pd

        x, s = np.stack(rows[vector].to_list()).astype(float), rows["score"].to_numpy()
        like, chosen = x @ x.T, []
        while len(chosen) < min(k, len(rows)):
            # rounded, so that ties go by key whatever the order of a sum
            gain = np.round(weight * s - ((1 - weight) * like[:, chosen].max(1) if chosen else 0), 9)
            gain[chosen] = -np.inf
            chosen.append(int(np.lexsort((rows[key].to_numpy(), -gain))[0]))
        return pd.DataFrame({"query": rows["query"].iloc[chosen].to_numpy(), key: rows[key].iloc[chosen].to_numpy(), "pick": range(1, len(chosen) + 1)})

    return candidates.groupBy("query").applyInPandas(pick, f"query long, `{key}` long, pick int")
