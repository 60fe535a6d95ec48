"""Line dedup by an exact set-similarity join with prefix, positional and length filters.

A line is the set of its k-word shingles, its tokens. Tokens are ordered by rarity: by the
corpus count of their rarest word, then by hash. Two sets with Jaccard similarity of at least
percent / 100 share one of their first n - ceil(n * percent / 100) + 1 tokens, so only those
are indexed. A line is removed when an earlier line, in the order of keys and line numbers,
has an equal or similar set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import LOWER, distinct_sets, least_of_runs, mix, pieces, released, shingles, small_batches, spread, text_column, word_hashes, words
from millrace.llm.groups import BLOCK, GROUPED, PACKED, SMALL, Index, alone, cells_of, compared, in_blocks, odd_sketches, possible, record, units, wanted_rows
from millrace.llm.ngrams import digests, verified
from millrace.session import modest, scratched, settle

#: Corpus counts of words are kept in so many cells, and as eighths of their binary logarithm.
CELLS = 1 << 16
#: Lines that a task holds before it hands them on.
LINES = 1 << 18

def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts of the lines of all texts, number of lines of each text); an empty text is one line."""
    data, starts = text_column(column)
    breaks = np.flatnonzero(data == 10) + 1
    counts = np.bincount(np.searchsorted(starts, breaks - 1, "right") - 1, minlength=len(column)) + 1 if len(breaks) else np.ones(len(column), np.int64)
    first = np.cumsum(counts) - counts
    at = np.empty(int(counts.sum()) + 1, np.int64)
    at[-1] = len(data)
    inner = np.ones(len(at) - 1, bool)
    inner[first] = False
    at[:-1][inner] = breaks
    at[:-1][first] = starts[:-1]
    return data, at, counts


def word_rarity(df: DataFrame, text: str) -> np.ndarray:
    """Eighths of the binary logarithm of each cell's word count, over all lines. Tasks send one table each, which a few tasks add up."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in pieces(batch, text):
                data, starts = text_column(part.column(text))
                data = LOWER[data]
                begin, end, _ = words(data, starts)
                total += np.bincount(word_hashes(data, begin, end) & np.uint64(CELLS - 1), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                total += np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    found = df.select(text).mapInArrow(released(each), "counts binary").repartition(4).mapInArrow(some, "counts binary").collect()
    total = sum((np.frombuffer(r[0], np.int64) for r in found), np.zeros(CELLS, np.int64))
    return np.minimum(255, 8 * np.log2(total + 1)).astype(np.uint8)


def token_sets(data: np.ndarray, at: np.ndarray, k: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's tokens by rarity, the rarity in their highest byte, and the starts."""
    data = LOWER[data]
    begin, end, row = words(data, at)
    hashes = word_hashes(data, begin, end)
    grams, rows = shingles(hashes, row, len(at) - 1, k)
    if not len(grams):
        return grams, np.zeros(len(at), np.int64)
    least = least_of_runs(rarity[hashes & np.uint64(CELLS - 1)], row, len(at) - 1, k)
    return distinct_sets((least.astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8)), rows, len(at) - 1)


#: Packed lines of a bucket, and what comes of them: lines that go (rid, gone), and each set's first line.
_PACKED = {"p_sets": pa.binary(), "p_ns": pa.binary(), "p_lines": pa.binary(), "p_texts": pa.binary(), "p_docs": pa.binary(), "p_bare": pa.binary(), "p_rids": pa.binary(), "p_sketches": pa.binary()}
_LINED = {"rid": pa.int64(), "gone": pa.list_(pa.int32()), "doc": pa.int64(), "line": pa.int32(), "n": pa.int32(), "sketch": pa.binary()}
_TYPES = PACKED | GROUPED | _PACKED | _LINED


def _gone(rid: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
    """Lines that go, a row for each text."""
    order = np.argsort(rid, kind="stable")
    rid, line = rid[order], line[order]
    at = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]])) if len(rid) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(rid)).astype(np.int32)), pa.array(line.astype(np.int32)))
    return record(_TYPES, len(at), bucket=np.arange(len(at), dtype=np.int32), rid=rid[at], gone=lists)


def _first_of_each(sets: np.ndarray, bare: np.ndarray, doc: np.ndarray, rid: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of each set's first line, places of the others)."""
    order = np.argsort(sets)
    ranked = sets[order]
    same = ranked[1:] == ranked[:-1]
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    alone, again = order[~again], order[again]
    again = again[np.lexsort((line[again], rid[again], doc[again], ~bare[again], sets[again]))]
    first = np.concatenate([[True], sets[again][1:] != sets[again][:-1]]) if len(again) else np.zeros(0, bool)
    leader = again[np.maximum.accumulate(np.where(first, np.arange(len(again)), 0))]
    # wholly equal rows have the same line at the same place
    later = (rid[again] != rid[leader]) | (line[again] != line[leader])
    return np.concatenate([alone, again[first]]), again[later]


class _Lines:
    """A task's lines, handed on packed by the bucket of their sets; a set's later lines within the task go at once."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.texts: list[tuple[np.ndarray, ...]] = []
        self.sketches: list[pa.Array] = []
        self.lines = self.rows = 0

    def add(self, sets: np.ndarray, n: np.ndarray, text: np.ndarray, line: np.ndarray, sketches: pa.Array, doc: np.ndarray, bare: np.ndarray, rid: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((sets, n.astype(np.int32), (text + self.rows).astype(np.int32), line.astype(np.int32)))
        self.texts.append((doc, bare, rid))
        self.sketches.append(sketches)
        self.lines += len(sets)
        self.rows += len(doc)
        if self.lines > LINES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.lines:
            self.clear()
            return
        sets, n, text, line = (np.concatenate(x) for x in zip(*self.held, strict=True))
        doc, bare, rid = (np.concatenate(x) for x in zip(*self.texts, strict=True))
        sketches = pa.concat_arrays(self.sketches)
        self.clear()
        first, later = _first_of_each(sets, bare[text], doc[text], rid[text], line)
        yield _gone(rid[text[later]], line[later])
        bucket = (sets[first].view(np.uint64) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            own = first[order[cuts[b] : cuts[b + 1]]]
            if not len(own):
                continue
            used, number = np.unique(text[own], return_inverse=True)
            own_sketches = sketches.take(pa.array(own))
            yield record(
                _TYPES, 1, bucket=[b], p_sets=[sets[own].tobytes()], p_ns=[n[own].tobytes()], p_lines=[line[own].tobytes()], p_texts=[number.astype(np.int32).tobytes()],
                p_docs=[doc[used].tobytes()], p_bare=[bare[used].tobytes()], p_rids=[rid[used].tobytes()], p_sketches=[b"".join(own_sketches.to_pylist())],
            )

    @staticmethod
    def gather(packed: list[dict], percent: int) -> Iterator[pa.RecordBatch]:
        """The lines that go, and the first line of each set that may be similar to another."""
        if not packed:
            return
        kinds = {"p_sets": np.int64, "p_ns": np.int32, "p_lines": np.int32, "p_texts": np.int32, "p_docs": np.int64, "p_bare": bool, "p_rids": np.int64}
        rows = [{c: np.frombuffer(row[c], t) for c, t in kinds.items()} for row in packed]
        sets, n, line = (np.concatenate([r[c] for r in rows]) for c in ("p_sets", "p_ns", "p_lines"))
        doc, bare, rid = (np.concatenate([r[c][r["p_texts"]] for r in rows]) for c in ("p_docs", "p_bare", "p_rids"))
        raw = np.concatenate([np.frombuffer(row["p_sketches"], np.uint8) for row in packed])
        first, later = _first_of_each(sets, bare, doc, rid, line)
        yield _gone(rid[later], line[later])
        sizes = cells_of(n) // 8
        begin = np.cumsum(sizes) - sizes
        first = first[_may_be_similar(n[first].astype(np.int64), percent)]
        for a in range(0, len(first), 50_000):
            own = first[a : a + 50_000]
            data, offsets = raw[spread(begin[own], sizes[own])], np.concatenate([[0], np.cumsum(sizes[own])]).astype(np.int32)
            sketch = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
            yield record(_TYPES, len(own), bucket=np.zeros(len(own), np.int32), set=sets[own], n=n[own], rid=rid[own], doc=pa.array(doc[own], mask=bare[own]), line=line[own], sketch=sketch)


def _may_be_similar(n: np.ndarray, percent: int) -> np.ndarray:
    """Smaller sets are only similar to equal ones."""
    return (n > 0) & ((n + 1) * percent <= n * 100)


def _index(df: DataFrame, k: int, percent: int, rarity: np.ndarray, buckets: int, small: int) -> DataFrame:
    """Written rows: (rid, gone), lines of texts that have an equal one before them; (set, n, doc, rid, line, sketch), a set's
    first line; and (grp, set, info, extra, hot), the sets with a common prefix token, their sizes and its place in them."""
    plain = [*GROUPED, *_LINED]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kept = Index(_TYPES, buckets, small), _Lines(buckets)
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at, counts = _lines(part.column("text"))
                values, sets = token_sets(data, at, k, rarity)
                n = np.diff(sets)
                ids = digests(values, sets).view(np.int64)
                text = np.repeat(np.arange(len(counts)), counts)
                line = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                own = np.flatnonzero(n > 0)
                bare = np.array(part.column("doc").is_null(), bool)
                sketches = odd_sketches(values, np.append(sets[:-1][own], len(values)))
                yield from kept.add(ids[own], n[own], text[own], line[own], sketches, part.column("doc").fill_null(0).to_numpy(), bare, part.column("rid").to_numpy())
                big = np.flatnonzero(_may_be_similar(n, percent))
                big = big[np.unique(ids[big], return_index=True)[1]]
                prefix = n[big] - -(-n[big] * percent // 100) + 1
                token = spread(sets[big], prefix)
                place = token - np.repeat(sets[big], prefix)
                # a smaller place only lets more pass
                yield from index.add(mix(values[token]), np.repeat(np.arange(len(big)), prefix), ids[big], n[big], np.minimum(place, 255).astype(np.uint8))
        yield from index.flush()
        yield from kept.flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[dict] = []
        lines: list[dict] = []
        for batch in batches:
            indexed, lined = pc.is_valid(batch.column("steps")), pc.is_valid(batch.column("p_sets"))
            tokens += batch.filter(indexed).select(list(PACKED)).to_pylist()
            lines += batch.filter(lined).select(list(_PACKED)).to_pylist()
            yield batch.filter(pc.invert(pc.or_(indexed, lined))).select(plain)
        for out in Index(_TYPES, buckets, small).gather(tokens, by_members=False):
            yield out.select(plain)
        tokens.clear()
        for out in _Lines.gather(lines, percent):
            yield out.select(plain)

    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>"}
    schemas = [", ".join(f"{c} {names[_TYPES[c]]}" for c in kind) for kind in (_TYPES, plain)]
    return settle(df.mapInArrow(released(scan), schemas[0]).repartition(buckets, "bucket").mapInArrow(released(gather), schemas[1]), "lines")


def _similar(small: DataFrame, hot: DataFrame, firsts: DataFrame, fetch: Callable[[DataFrame], DataFrame], k: int, percent: int, block: int) -> DataFrame:
    """(set) of the sets with an earlier similar one. small, hot: groups (grp, set, info, extra); firsts: (set, n, doc, rid, line, sketch).
    fetch(set) returns the (set, text) of those, once, for all sets that sketches let pass.

    In each round a set asks some of the earlier ones of its groups that sizes, places and
    sketches let pass, nearest first, eight times as many as in the round before, until it is
    found to go. Sets of large groups first ask the earliest of them only. Rounds end when
    no group holds an untried pair whose later set stays so far.
    """
    found: DataFrame | None = None
    few: DataFrame | None = small
    crowd: DataFrame | None = hot
    texts: DataFrame | None = None
    more: DataFrame | None = None
    turn = 0

    def asked(rows: DataFrame, at: int) -> DataFrame:
        rows = rows.join(firsts, "set").withColumn("mark", F.col("set"))
        if found is None:
            rows = rows.withColumn("done", F.lit(False))
        else:
            rows = rows.join(found.select(F.col("a").alias("_a")), F.col("set") == F.col("_a"), "left").withColumn("done", F.col("_a").isNotNull())
        return compared(rows, percent, at, ["doc", "rid", "line"], positional=True)

    def led(groups: DataFrame) -> DataFrame:
        rows = groups.join(firsts.select("set", F.struct("doc", "rid", "line").alias("first")), "set")
        heads = rows.groupBy("grp").agg(F.min(F.struct("first", "set", "info", "extra")).alias("y"))
        most = F.least(F.col("info") - F.col("extra"), F.col("y.info") - F.col("y.extra"))
        pairs = rows.join(heads, "grp").where((F.col("first") > F.col("y.first")) & (most * (100 + percent) >= (F.col("info") + F.col("y.info")) * percent))
        pairs = pairs.select(F.col("set").alias("a"), F.col("y.set").alias("b")).distinct()
        return possible(pairs, firsts, percent).withColumn("grp", F.lit(None).cast("long"))

    while few is not None or crowd is not None:
        parts = [] if few is None else [asked(alone(few), turn)]
        if turn == 0:
            parts.append(led(hot))
        elif crowd is not None:
            # which groups go on, and in how many blocks, is settled on one row a group, so their members are joined once
            sized = hot.groupBy("grp").agg(in_blocks(block))
            sized = sized if turn == 1 else sized.join(more, "grp", "left_semi")
            parts.append(asked(units(hot.join(sized, "grp")), turn - 1))
        pairs = reduce(DataFrame.unionAll, [settle(p, "pairs") for p in parts])
        if texts is None:
            texts = fetch(pairs.where("a IS NOT NULL").select(F.col("a").alias("set")).union(hot.select("set")).distinct())
        more = pairs.where("a IS NULL").select("grp").distinct()
        n_pairs, n_more = pairs.agg(F.count("b"), F.count(F.when(F.col("a").isNull(), 1))).first()
        if n_pairs:
            links = verified(pairs.where("b IS NOT NULL").select("a", "b").distinct(), texts, k, percent).select("a")
            found = settle((links if found is None else found.unionAll(links)).distinct(), "found")
        few = None if few is None or not n_more else small.join(more, "grp", "left_semi")
        if turn and not n_more:
            crowd = None
        turn += 1
    return firsts.select(F.col("set").alias("a")).limit(0) if found is None else found


@modest
@scratched
def _removed(own: DataFrame, k: int, percent: int, block: int, few: int) -> DataFrame:
    """(_rid, _gone) of texts (rid, doc, text) that lose lines: the numbers of those."""
    buckets = max(8, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _index(own, k, percent, word_rarity(own, "text"), buckets, few)
    gone = rows.where(F.col("gone").isNotNull()).select("rid", "gone")
    groups = rows.where(F.col("grp").isNotNull()).select("grp", "set", "info", "extra", "hot")
    small = settle(groups.where(~F.col("hot")).drop("hot"), "small")
    hot = settle(groups.where("hot").groupBy("grp", "set").agg(F.min("info").alias("info"), F.min("extra").alias("extra")), "hot")
    asking = small.select("set").union(hot.select("set")).distinct()
    firsts = settle(rows.where(F.col("grp").isNull() & F.col("set").isNotNull()).select("set", "n", "doc", "rid", "line", "sketch").join(asking, "set", "left_semi"), "firsts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column("text"), batch.column("_asked").to_pylist(), strict=True):
                data, at, _ = _lines(pa.array([text.as_py()]))
                lines = [data[at[x["line"]] : at[x["line"] + 1]].tobytes().decode("utf-8", "surrogateescape").rstrip("\n") for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array([x["set"] for x in asked], pa.int64()), pa.array(lines, pa.string())], names=["set", "text"])

    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = settle(wanted.join(firsts, "set").groupBy("rid", F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("set", "line")).alias("_asked")), "asked")
        asked = wanted.withColumnRenamed("rid", "_rid").hint("merge")
        texts = wanted_rows(own, wanted, "rid").join(asked, (F.col("rid") == F.col("_rid")) & F.col("doc").eqNullSafe(F.col("_doc"))).select("text", "_asked")
        return settle(texts.mapInArrow(released(cut), "set long, text string").dropDuplicates(["set"]), "texts")

    similar = _similar(small, hot, firsts, fetch, k, percent, block)
    last = firsts.join(similar.withColumnRenamed("a", "_a"), F.col("set") == F.col("_a"), "left_semi").groupBy("rid").agg(F.collect_list("line").alias("gone"))
    return gone.union(last).groupBy(F.col("rid").alias("_rid")).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("_gone"))


def without_lines(texts: pa.Array, gone: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the texts without the lines that go, the number of lines that each had); null stays null, with no lines."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, at, counts = _lines(texts)
    first = np.cumsum(counts) - counts
    stays = np.ones(len(at) - 1, bool)
    if len(gone.flatten()):
        stays[first[pc.list_parent_indices(gone).to_numpy()] + gone.flatten().to_numpy()] = False
    length = np.diff(at)
    # the last line that stays ends without a break
    row = np.repeat(np.arange(len(counts)), counts)
    kept = np.flatnonzero(stays)
    last = np.ones(len(kept), bool)
    last[:-1] = row[kept][1:] != row[kept][:-1]
    last = kept[last]
    length[last[last != (first + counts - 1)[row[last]]]] -= 1
    body = data[spread(at[kept], length[kept])]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], length[kept], minlength=len(counts)).astype(np.int64))])
    out = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
    none = texts.is_null()
    return pc.if_else(none, None, out).cast(pa.string()), np.where(np.array(none), 0, counts)


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())]))
def _rest(texts: pa.Array, gone: pa.Array) -> pa.Array:
    found, counts = [], []
    rows = pa.RecordBatch.from_arrays([texts, gone], names=["text", "gone"])
    for part in pieces(rows, "text"):
        text, n = without_lines(part.column("text"), part.column("gone"))
        found.append(text)
        counts.append(n)
    text = pa.concat_arrays(found) if found else pa.array([], pa.string())
    return pa.StructArray.from_arrays([text, pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["text", "n_lines"])


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block: int = BLOCK, few: int = SMALL) -> DataFrame:
    """df with the text of the lines that stay, and n_lines, n_removed.

    Lines end at \\n and are compared as sets of k-word shingles of their lower-cased words;
    with fewer words the whole line is the one shingle; lines without words always stay. A
    line goes when an earlier one, by (key, text's hash, line number), has an equal set or
    one with Jaccard similarity of at least percent / 100, whether or not that one stays.
    Rows that are wholly equal count as one, and change alike. Null texts stay null with 0
    lines; null keys come first. Columns named n_lines and n_removed are replaced. block and
    few only set how groups are dealt out.
    """
    spark = df.sparkSession
    small_batches(spark)
    base = df.drop("n_lines", "n_removed")
    order_key, body = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")
    rid = F.xxhash64(order_key, body)
    own = base.where(body.isNotNull()).select(rid.alias("rid"), order_key.alias("doc"), body.alias("text"))
    gone = _removed(own, k, percent, block, few)
    out = base.withColumn("_own", rid).join(gone, F.col("_own") == F.col("_rid"), "left")
    out = out.withColumn("_gone", F.when(body.isNotNull(), F.col("_gone"))).withColumn("_rest", _rest(body, F.col("_gone")))
    out = out.withColumn("n_lines", F.col("_rest.n_lines")).withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    return out.withColumn(text, F.col("_rest.text")).drop("_own", "_rid", "_gone", "_rest")
