"""Periodic runs of words by Crochemore's partition refinement.

Places of a text are parted into classes of equal factors of length 1, 2, 3 and so on. Two
neighbouring members of a class at a distance equal to the length are a square with a primitive
root; squares of one period at consecutive places are a run. The first lengths are refined for
all texts of a slice at once. What is then left of a text, long repeats, is refined by smaller
halves: a class that splits hands on all parts but its largest, so a place is moved O(log n)
times whatever the number of lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import SPACES, pieces, released, spread, text_column, word_values, words

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Lengths that are refined for all texts of a slice at once.
LEVELS = 12


def squares_beyond(places: list[int], classes: list[int], n: int, level: int, last: int, members: int) -> dict[int, list[int]]:
    """period -> places of squares, for periods above level up to last, of one text of n words.

    ``places`` are those in classes of at least ``members`` at this level, ascending inside each
    class. Smaller classes go: with the asked exponent, a run leaves more members in each class.
    """
    of, after, before = [-1] * (n + 2), [-1] * (n + 2), [-1] * (n + 2)
    size: dict[int, int] = {}
    head: dict[int, int] = {}
    gaps: dict[int, list[int]] = {}
    found: dict[int, list[int]] = {}

    def link(name: int, own: list[int]) -> None:
        size[name], head[name] = len(own), own[0]
        left = -1
        for i in own:
            of[i], before[i], after[i] = name, left, -1
            if left >= 0:
                after[left] = i
                if level <= i - left <= last:
                    gaps.setdefault(i - left, []).append(left)
            left = i

    def unlink(i: int, name: int) -> None:
        left, right = before[i], after[i]
        if left >= 0:
            after[left] = right
        else:
            head[name] = right
        if right >= 0:
            before[right] = left
            if left >= 0 and right - left <= last:
                gaps.setdefault(right - left, []).append(left)
        size[name] -= 1

    def listed(name: int) -> list[int]:
        own, i = [], head[name]
        while i >= 0:
            own.append(i)
            i = after[i]
        return own

    grouped: dict[int, list[int]] = {}
    for i, c in zip(places, classes, strict=True):
        grouped.setdefault(c, []).append(i)
    for c, own in grouped.items():
        link(c, own)
    fresh = max(grouped, default=0)
    splitters = list(grouped.values())
    gone = [i + 1 for i in places if of[i + 1] < 0]
    while level < last and size:
        level += 1
        touched, lost = set(), []
        # a factor that goes on into a place of no use is of no use itself
        for j in gone:
            c = of[j - 1]
            if c >= 0:
                unlink(j - 1, c)
                of[j - 1] = -1
                lost.append(j - 1)
                touched.add(c)
        parts: dict[int, list[list[int]]] = {}
        for splitter in splitters:
            by_class: dict[int, list[int]] = {}
            for j in splitter:
                c = of[j - 1]
                if c >= 0:
                    by_class.setdefault(c, []).append(j - 1)
            for c, own in by_class.items():
                parts.setdefault(c, []).append(own)
        splitters = []
        for c, own in parts.items():
            rest = size[c] - sum(map(len, own))
            own.sort(key=len)
            largest = own[-1]
            if not rest:
                # the largest part keeps the class and splits nothing
                own.pop()
            for part in own:
                for i in part:
                    unlink(i, c)
                if len(part) < members:
                    for i in part:
                        of[i] = -1
                    lost += part
                    continue
                fresh += 1
                link(fresh, part)
                if part is not largest or rest >= len(part):
                    splitters.append(part)
            if 0 < rest < len(largest) and rest >= members:
                splitters.append(listed(c))
            touched.add(c)
        for c in touched:
            if size[c] < members:
                own = listed(c)
                for i in own:
                    of[i] = -1
                lost += own
                del size[c], head[c]
        gone = lost
        hits = {i for i in gaps.pop(level, ()) if of[i] >= 0 and after[i] == i + level}
        if hits:
            found[level] = sorted(hits)
    return found


def _merge(row: np.ndarray, place: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Squares of one period, by place, as runs: row, first place, length, period."""
    opens = np.ones(len(place), bool)
    opens[1:] = (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1])
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(place)) - 1
    return row[at], place[at], place[last] - place[at] + 2 * period, np.full(len(at), period)


def find_runs(codes: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs, by row, start and period; row r holds the codes from starts[r] to starts[r + 1].

    A run is a stretch of smallest period q of at least min_length and min_exponent * q codes
    that no neighbour extends.
    """
    n, counts = len(codes), np.diff(starts)
    rows = np.repeat(np.arange(len(counts)), counts)
    last = counts // min_exponent
    members = max(2, min_exponent - 1)
    found = []

    def classes(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[at, len(key)])
        enough = sizes >= members
        return place[np.repeat(enough, sizes)], np.repeat(np.arange(enough.sum()), sizes[enough])

    place = np.flatnonzero(last[rows] >= 1)
    key = rows[place] * (int(codes.max(initial=0)) + 1) + codes[place]
    of = np.full(n + 1, -1, np.int64)
    for level in range(1, LEVELS + 1):
        place, own = classes(key, place)
        if not len(place):
            break
        hit = (own[1:] == own[:-1]) & (place[1:] - place[:-1] == level)
        squares = np.sort(place[:-1][hit])
        if len(squares):
            found.append(_merge(rows[squares], squares - starts[rows[squares]], level))
        if level == LEVELS:
            break
        of[:] = -1
        of[place] = own
        place = np.sort(place)
        after = of[place + 1]
        goes_on = (after >= 0) & (last[rows[place]] > level) & (place + level < starts[rows[place] + 1])
        place = place[goes_on]
        key = of[place] * (int(own[-1]) + 1) + after[goes_on]
    long = last[rows[place]] > LEVELS
    place, own = (place[long], own[long]) if long.any() else (place[:0], place[:0])
    order = np.lexsort((place, rows[place]))
    place, own = place[order], own[order]
    edges = np.flatnonzero(np.r_[True, np.diff(rows[place]) > 0, True]) if len(place) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        r = int(rows[place[a]])
        for period, squares in squares_beyond((place[a:b] - starts[r]).tolist(), own[a:b].tolist(), int(counts[r]), LEVELS, int(last[r]), members).items():
            found.append(_merge(np.full(len(squares), r), np.array(squares), period))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    row, start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = length >= np.maximum(min_length, min_exponent * period)
    row, start, length, period = row[keep], start[keep], length[keep], period[keep]
    order = np.lexsort((period, start, row))
    return row[order], start[order], length[order], period[order]


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(df: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """df with the runs of each whole text's words, by start and period, and the text collapsed.

    Collapsed are the words joined by one space, without those that a run repeats: of each run
    its first period stays, as far as no other run drops it. Null and empty texts have no runs
    and collapse to the empty text. Repeated rows and other columns stay; columns called like
    the new ones are replaced. A narrow map: no shuffle, slices of a few MB of text (one longer
    text alone). Words are told apart by their bytes, not by hashes.
    """
    if text in (runs, collapsed):
        raise ValueError("runs and collapsed text need columns of their own")
    kept = df.drop(runs, collapsed).withColumn(text, df[text].cast("string"))
    schema = T.StructType([*kept.schema.fields, T.StructField(runs, RUN), T.StructField(collapsed, T.StringType())])

    def columns(texts: pa.Array) -> list[pa.Array]:
        data, at = text_column(texts)
        begin, end, rows = words(data, at, SPACES)
        codes = word_values(data, begin, end).dictionary_encode().indices.to_numpy()[::2].astype(np.int64) if len(begin) else np.zeros(0, np.int64)
        starts = np.searchsorted(rows, np.arange(len(texts) + 1))
        row, start, length, period = find_runs(codes, starts, min_length, min_exponent)
        lists = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], names=["start", "length", "period"]))
        edge = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edge, starts[row] + start + period, 1)
        np.add.at(edge, starts[row] + start + length, -1)
        stays = np.cumsum(edge[:-1]) == 0
        begin, end, rows = begin[stays], end[stays], rows[stays]
        # each word with one byte more, which becomes the space after it
        size = end - begin + 1
        out = np.append(data, np.uint8(0x20))[spread(begin, size)]
        ends = np.cumsum(size)
        out[ends - 1] = 0x20
        last = np.searchsorted(rows, np.arange(1, len(texts) + 1)) - 1
        has = np.bincount(rows, minlength=len(texts)) > 0
        keep = np.ones(len(out), bool)
        keep[ends[last[has]] - 1] = False
        total = np.cumsum(np.bincount(rows, size, len(texts)).astype(np.int64) - has)
        joined = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.r_[0, total].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[keep])))
        return [found, joined.cast(pa.string())]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *columns(part.column(text))], names=schema.names)

    return kept.mapInArrow(run, schema)
