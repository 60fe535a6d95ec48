"""Token ids over a public vocabulary: merge-rank encoding, its inverse, framing and the cap on lengths.

The vocabulary is a file of byte strings with their ranks; its path is a parameter. Ids 0 to 14
are the special tokens', every vocabulary entry's id is its rank plus 15. Tokenizers are not
trained here.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import framed

# Fixed values.
SPECIAL_TOKENS = {
    "[PAD]": 0,
    "[UNK]": 1,
    "[CLS]": 2,
    "[SEP]": 3,
    "[CHUNK]": 4,
    "<DOC>": 5,
    "[I_0]": 6,
    "[I_1]": 7,
    "[I_2]": 8,
    "[I_3]": 9,
    "[I_4]": 10,
    "[I_5]": 11,
    "[I_6]": 12,
    "[I_7]": 13,
    "[I_NONE]": 14,
}
MAX_TOKEN_LENGTH = 512

_FIRST = len(SPECIAL_TOKENS)
#: Longer words are merged one by one with a priority queue, shorter ones all at once.
LONG_WORD = 48
#: Different words whose ids a task holds, and text bytes that it handles at once.
WORDS_HELD, SLICE = 1 << 18, 2 << 20
_NONE = np.iinfo(np.int32).max


def special_token_id(name: str) -> int:
    if name not in SPECIAL_TOKENS:
        raise KeyError(f"unknown special token: {name}")
    return SPECIAL_TOKENS[name]


def public_vocabulary() -> tuple[str, str]:
    """(path of the ranks, pattern of the words) of a public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Ranks:
    """A vocabulary by ranks. Two neighbours merge if their concatenation is an entry, lowest rank first."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            entries = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(word): int(rank) for word, rank in entries}
        self.size = max(self.ids.values(), default=-1) + 1
        self.words = [b""] * self.size
        for word, rank in self.ids.items():
            self.words[rank] = word
        self.of_byte = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.of_byte < 0).any():
            raise ValueError(f"{path}: a byte has no entry, so some texts could not be encoded")
        # every way to put an entry together from two others
        pairs = {(self.ids[w[:i]], self.ids[w[i:]]): r for w, r in self.ids.items() for i in range(1, len(w)) if w[:i] in self.ids and w[i:] in self.ids}
        keys = np.array([a * self.size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pairs, self.keys, self.ranks = pairs, keys[order], np.array(list(pairs.values()), np.int32)[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation, _NONE where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_long(self, word: bytes) -> list[int]:
        """One word by linked arrays and a priority queue of (rank, place): n log n."""
        n = len(word)
        part = [int(i) for i in self.of_byte[np.frombuffer(word, np.uint8)]]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.pairs.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if part[i] != left or j < 0 or part[j] != right:
                continue
            part[i], part[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.pairs.get((part[a], part[b]))) is not None:
                    heapq.heappush(queue, (r, a, part[a], part[b]))
        return [p for p in part if p >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The entries of all words, one after another, and the len + 1 starts.

        In each round every word that still has a pair merges its leftmost pair of the lowest rank.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        short = np.flatnonzero(sizes <= LONG_WORD)
        part = self.of_byte[np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)]
        word = np.repeat(short, sizes[short])
        done = [(np.full(len(ids), i), np.array(ids, np.int64)) for i in np.flatnonzero(sizes > LONG_WORD).tolist() for ids in [self.merge_long(words[i])]]
        while len(part):
            rank = np.full(len(part), _NONE, np.int32)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.rank(part[same], part[same + 1])
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[heads, len(part)])
            least = np.repeat(np.minimum.reduceat(rank, heads), lengths)
            settled = least == _NONE
            done.append((word[settled], part[settled]))
            hit = np.flatnonzero((rank == least) & ~settled)
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]] if len(hit) else hit
            part[hit] = rank[hit]
            keep = ~settled
            keep[hit + 1] = False
            part, word = part[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        of, ids = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        return ids[order], np.r_[0, np.cumsum(np.bincount(of, minlength=len(words)))].astype(np.int64)


class WordIds:
    """The ids of the words met so far, each merged once."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks, self.pattern = Ranks(path), regex.compile(pattern)
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def encode(self, texts: list[str | None]) -> pa.Array:
        if len(self.slots) > WORDS_HELD:
            self.clear()
        words = [self.pattern.findall(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for own in words for w in own) if w not in self.slots]
        if new:
            ids, ends = self.ranks.merge([w.encode("utf-8", "surrogatepass") for w in new])
            base = self.ends[-1]
            self.flat.frombytes((ids + _FIRST).astype(np.int32).tobytes())
            self.ends.frombytes((ends[1:] + base).astype(np.int64).tobytes())
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new)), strict=True))
        slot = np.array([self.slots[w] for own in words for w in own], np.int64)
        ends = np.frombuffer(self.ends, np.int64)
        count = ends[slot + 1] - ends[slot]
        place = np.arange(int(count.sum())) + np.repeat(ends[slot] - (np.cumsum(count) - count), count)
        rows = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        offsets = np.r_[0, np.cumsum(np.bincount(rows, count, len(texts)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(self.flat, np.int32)[place]))


def _appended(df: DataFrame, out: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(out)
    return kept, T.StructType([*kept.schema.fields, T.StructField(out, kind)])


def encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """df with the ids of each whole text, without frame; null and empty texts have none.

    Words are cut by the vocabulary's pattern, bytes merged by rank within a word. No shuffle;
    a task holds some MB of text and the ids of at most WORDS_HELD words and those of a slice.
    """
    path, pattern = vocabulary or public_vocabulary()
    kept, schema = _appended(df, out, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordIds(path, pattern)
        for batch in batches:
            sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _slices(batch, sizes, SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, table.encode(part.column(text).to_pylist())], names=schema.names)

    return kept.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about this total size."""
    groups = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """df with the text of each list of ids: padding, frame and other special ids are left out, bytes that are no UTF-8 become U+FFFD.

    A null list is null. An id beyond the vocabulary is an error.
    """
    path, _ = vocabulary or public_vocabulary()
    kept, schema = _appended(df, out, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [b""] * _FIRST + Ranks(path).words
        length = np.array([len(w) for w in words], np.int64)
        start, data = np.cumsum(length) - length, np.frombuffer(b"".join(words), np.uint8)
        for batch in batches:
            sizes = pc.list_value_length(batch.column(ids)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _slices(batch, sizes, SLICE // 4):
                lists = part.column(ids)
                own = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if len(own) and not (0 <= own.min() and own.max() < len(words)):
                    raise ValueError(f"an id is beyond the {len(words)} of the vocabulary")
                count = length[own]
                raw = data[np.arange(int(count.sum())) + np.repeat(start[own] - (np.cumsum(count) - count), count)].tobytes()
                rows = np.r_[0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
                ends = np.r_[0, np.cumsum(count)][rows]
                texts = [raw[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def over_cap(ids: Column, length: int = MAX_TOKEN_LENGTH) -> Column:
    """More ids than fit between the two of the frame."""
    return F.size(F.coalesce(ids, F.array().cast("array<int>"))) > length - 2


def token_ids(ids: Column, length: int = MAX_TOKEN_LENGTH) -> Column:
    """The framed ids of a row, padded to length; none where they are over the cap, so that the row stays and can be seen."""
    empty = F.array().cast("array<int>")
    return F.when(over_cap(ids, length), empty).otherwise(framed(F.coalesce(ids, empty), length))


def known_share(df: DataFrame, ids: str = "ids") -> DataFrame:
    """(tokens, unknown, coverage): the share of ids that are not [UNK]; 1 without ids."""
    unknown = F.size(F.filter(F.col(ids), lambda i: i == SPECIAL_TOKENS["[UNK]"]))
    sums = df.where(F.col(ids).isNotNull()).agg(F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("tokens"), F.coalesce(F.sum(unknown), F.lit(0)).alias("unknown"))
    return sums.withColumn("coverage", F.when(F.col("tokens") > 0, 1 - F.col("unknown") / F.col("tokens")).otherwise(F.lit(1.0)))
