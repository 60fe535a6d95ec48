"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of whitespace markers and what follows up to the next marker. Where no piece
of the vocabulary holds a marker after another character, no merge crosses the start of a chunk,
so a text's ids are its chunks' ids side by side. Each different chunk is segmented once; the
ids go back to where the chunk stands.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import SLICE_BYTES, pieces, released, spread, text_column, word_values

MARK = "▁"
#: Bytes of chunks and ids that a task's table holds before it starts anew.
TABLE_BYTES = 32 << 20
_SPACE = 0x20


def public_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class ChunkTable:
    """The ids of every chunk met so far. A chunk is given without its first marker, which the library adds itself."""

    def __init__(self, path: str, limit: int = TABLE_BYTES) -> None:
        self.processor = _processor(path)
        self.limit = limit
        ids = range(self.processor.vocab_size())
        self.marker = self.processor.piece_to_id(MARK)
        crossing = any(MARK in self.processor.id_to_piece(i).lstrip(MARK) for i in ids)
        if crossing or self.processor.is_unknown(self.marker) or sum(map(self.processor.is_byte, ids)) < 256 or self.processor.normalize(" Å ﬁ ") != f"{MARK * 2}Å{MARK}ﬁ{MARK}":
            raise ValueError(f"{path}: chunks are independent only if no piece crosses a marker, bytes stand in for unknown characters and texts are not normalised")
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.ends, self.held = array("i"), array("q", [0]), 0

    def lookup(self, chunks: list[bytes]) -> np.ndarray:
        """The slot of each chunk; new ones are segmented."""
        if self.held > self.limit:
            self.clear()
        new = [c for c in chunks if c not in self.slots]
        for chunk, ids in zip(new, self.processor.encode([c.decode() for c in new], num_threads=1), strict=True):
            self.slots[chunk] = len(self.ends) - 1
            # the library gives an empty text no marker, a chunk always has one
            self.ids.extend(ids if chunk else [self.marker])
            self.ends.append(len(self.ids))
            self.held += len(chunk) + 4 * len(ids) + 100
        return np.fromiter((self.slots[c] for c in chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text; null is empty."""
        data, starts = text_column(pc.replace_substring(texts.cast(pa.large_string()), MARK, " "))
        if not len(data):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        blank = data == _SPACE
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        heads = starts[:-1][starts[1:] > starts[:-1]]
        opens[heads] = True
        first = np.zeros(len(data), bool)
        first[heads] = True
        begin = np.flatnonzero(opens)
        coded = word_values(data, begin + ~first[begin], np.append(begin[1:], len(data))).dictionary_encode()
        slot = self.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy()[::2]]
        ends = np.frombuffer(self.ends, np.int64)
        count = ends[slot + 1] - ends[slot]
        ids = np.frombuffer(self.ids, np.int32)[spread(ends[slot], count)]
        rows = np.searchsorted(starts, begin, "right") - 1
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(rows, count, len(texts)), out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


class PieceTable:
    """The bytes of every piece, for decoding by gathering them."""

    def __init__(self, path: str) -> None:
        self.processor = _processor(path)
        size = self.processor.vocab_size()
        texts = [self.processor.id_to_piece(i) for i in range(size)]
        raw = [bytes([int(t[1:-1], 16)]) if self.processor.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(texts)]
        self.length = np.array([len(b) for b in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.marked = np.array([t.startswith(MARK) for t in texts])
        self.odd = np.array([self.processor.is_control(i) or self.processor.is_unknown(i) for i in range(size)])

    def decode(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids, a first piece without its marker. Control and unknown ids and bytes that are no UTF-8 are left to the library."""
        ids, offsets = lists.flatten(), np.r_[0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
        own = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        if len(own) and own.max() >= len(self.length):
            raise ValueError(f"id {own.max()} is beyond the {len(self.length)} pieces")
        strange = own < 0
        safe = np.where(strange, 0, own)
        strange |= self.odd[safe]
        count, start = self.length[safe], self.start[safe]
        full = offsets[1:] > offsets[:-1]
        heads = offsets[:-1][full]
        cut = heads[self.marked[safe[heads]]]
        count[cut] -= 1
        start[cut] += 1
        raw = self.data[spread(start, count)].tobytes()
        ends = np.r_[0, np.cumsum(count)][offsets]
        by_library = np.zeros(len(lists), bool)
        by_library[np.searchsorted(offsets, np.flatnonzero(strange), "right") - 1] = True
        texts: list[str | None] = []
        for row, (valid, library) in enumerate(zip(lists.is_valid().to_pylist(), by_library.tolist(), strict=True)):
            text = None
            if valid and not library:
                try:
                    text = raw[ends[row] : ends[row + 1]].decode()
                except UnicodeDecodeError:
                    library = True
            if valid and library:
                text = self.processor.decode([i for i in own[offsets[row] : offsets[row + 1]].tolist() if i >= 0])
            texts.append(text)
        return pa.array(texts, pa.string())


def _with_column(df: DataFrame, out: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(out)
    return kept, T.StructType([*kept.schema.fields, T.StructField(out, kind)])


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df with the ids of each whole text as the library gives them, without begin and end ids.

    Null and empty texts have no ids; repeated rows and other columns stay as they are, one
    called ``out`` is replaced. A narrow map: no shuffle; a task holds slices of a few MB of
    text (one longer text alone) and a table of at most TABLE_BYTES and one slice.
    """
    path = path or public_path()
    own = df.withColumn(text, df[text].cast("string"))
    kept, schema = (own, T.StructType([*own.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])) if out not in df.columns else _with_column(own, out, T.ArrayType(T.IntegerType()))
    if text == out:
        raise ValueError("the ids need a column of their own")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for batch in batches:
            for part in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, table.encode(part.column(text))], names=schema.names)

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """df with the text of each list of ids as the library's decode gives it.

    A null list is null, an empty one empty; null ids in a list are left out, ids beyond the
    vocabulary are an error. Other columns stay, one called ``out`` is replaced. No shuffle.
    """
    path = path or public_path()
    if ids == out:
        raise ValueError("the text needs a column of its own")
    kept, schema = _with_column(df, out, T.StringType())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(path)
        for batch in batches:
            sizes = pc.list_value_length(batch.column(ids)).fill_null(0).to_numpy(zero_copy_only=False)
            # runs of rows with about so many ids
            groups = (np.cumsum(sizes) - sizes) // (SLICE_BYTES // 4)
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, table.decode(part.column(ids))], names=schema.names)

    return kept.mapInArrow(run, schema)
