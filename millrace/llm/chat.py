"""Chat formatting: turns assembled as columns of bytes into one preallocated Arrow buffer.

A turn is written ``<s>[INST] role [/INST]text</s>``. In roles and texts a backslash is
doubled, and a control string gets a backslash after its first character, so that no
control string of the output comes from a text and reading back restores every byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, spread, text_column

#: Bytes of one conversation after which it goes on in a further fragment.
FRAGMENT_BYTES = 4 << 20
#: Turn numbers of one fragment at most; longer conversations are dealt out by these blocks.
FRAGMENT_TURNS = 512


@dataclass(frozen=True)
class ChatTemplate:
    turn_open: str = "<s>[INST] "
    role_close: str = " [/INST]"
    turn_close: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    escape: str = "\\"

    def unescape(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({e})?", lambda m: m[1] or "", text)

    def turn_pattern(self) -> re.Pattern[str]:
        a, b, c = map(re.escape, (self.turn_open, self.role_close, self.turn_close))
        return re.compile(f"{a}(.*?){b}(.*?){c}", re.S)


def escaped(data: np.ndarray, starts: np.ndarray, template: ChatTemplate) -> tuple[np.ndarray, np.ndarray]:
    """The column with its control strings broken up, and its new row starts."""
    mark = ord(template.escape)
    found = [np.flatnonzero(data == mark)]
    for control in template.controls:
        want = np.frombuffer(control.encode(), np.uint8)
        at = np.flatnonzero(data == want[0])
        at = at[at + len(want) <= len(data)]
        for i in range(1, len(want)):
            at = at[data[at + i] == want[i]]
        row = np.searchsorted(starts, at, "right") - 1
        found.append(at[at + len(want) <= starts[row + 1]] + 1)
    before = np.sort(np.concatenate(found))
    if not len(before):
        return data, starts
    out = np.full(len(data) + len(before), mark, np.uint8)
    own = np.ones(len(out), bool)
    own[before + np.arange(len(before))] = False
    out[own] = data
    return out, starts + np.searchsorted(before, starts, "left")


def assemble(roles: pa.Array, texts: pa.Array, template: ChatTemplate) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, the n + 1 turn starts, starts and ends of the texts within the bytes)."""
    n = len(roles)
    role, role_at = escaped(*text_column(roles), template)
    text, text_at = escaped(*text_column(texts), template)
    head, middle, tail = (np.frombuffer(s.encode(), np.uint8) for s in (template.turn_open, template.role_close, template.turn_close))
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    lengths = len(head) + role_len + len(middle) + text_len + len(tail)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    out = np.empty(int(at[-1]), np.uint8)
    role_to = at[:-1] + len(head)
    middle_to = role_to + role_len
    text_to = middle_to + len(middle)
    tail_to = text_to + text_len
    for part, to in ((head, at[:-1]), (middle, middle_to), (tail, tail_to)):
        out[(to[:, None] + np.arange(len(part))).ravel()] = np.tile(part, n)
    out[spread(role_to, role_len)] = role
    out[spread(text_to, text_len)] = text
    return out, at, text_to, tail_to


def format_chats(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
    template: ChatTemplate | None = None,
) -> DataFrame:
    """Formatted conversations: (conv, block, fragment, n_turns, formatted, loss_starts, loss_ends).

    Turns are ordered by turn, then role and text, so ties and repeated rows have one order.
    A conversation is one row, unless it has turn numbers of several blocks of FRAGMENT_TURNS
    or more than FRAGMENT_BYTES; then its rows by (block, fragment), concatenated, are the
    whole, and a conversation with a third of all turns is spread over many tasks. The loss
    spans are byte offsets into the row's own UTF-8. Null conversations form one conversation,
    null turns come first, null roles and texts are empty; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    template = template or ChatTemplate()
    own = df.select(
        df[conv].cast("long").alias("conv"), df[turn].cast("long").alias("turn"), df[role].cast("string").alias("role"), df[text].cast("string").alias("text")
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / FRAGMENT_TURNS), F.lit(-(1 << 62))))
    dealt = own.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "role", "text")

    def emit(rows: pa.Table, seqs: list[int], bounds: np.ndarray) -> pa.RecordBatch:
        roles, texts = (rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0) for c in ("role", "text"))
        data, at, text_at, text_end = assemble(roles, texts, template)
        begins = at[bounds[:-1]]
        loss = np.isin(np.array(roles.fill_null("").to_pylist(), object), loss_roles) if len(roles) else np.zeros(0, bool)
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        spans = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(group[loss], minlength=len(bounds) - 1))]).astype(np.int32)
        formatted = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at[bounds].astype(np.int32)), pa.py_buffer(data))
        lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x[loss] - begins[group[loss]])) for x in (text_at, text_end)]
        first = pa.array(bounds[:-1])
        arrays = [rows.column("conv").take(first).combine_chunks(), rows.column("block").take(first).combine_chunks(), pa.array(seqs, pa.int64()), pa.array(np.diff(bounds)), formatted, *lists]
        return pa.RecordBatch.from_arrays(arrays, names=["conv", "block", "fragment", "n_turns", "formatted", "loss_starts", "loss_ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last, seq = None, 0

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal last, seq
            if not rows.num_rows:
                return
            keys = list(zip(rows.column("conv").to_pylist(), rows.column("block").to_pylist(), strict=True))
            size = np.array([len(t or "") for t in rows.column("text").to_pylist()], np.int64) * 2
            cuts, seqs, filled = [0], [], 0
            for i, k in enumerate(keys):
                if i == cuts[-1]:
                    seq = seq + 1 if k == last else 0
                    seqs.append(seq)
                elif k != last or filled + size[i] > FRAGMENT_BYTES:
                    cuts.append(i)
                    seq = seq + 1 if k == last else 0
                    seqs.append(seq)
                    filled = 0
                filled += int(size[i])
                last = k
            yield emit(rows, seqs, np.array([*cuts, rows.num_rows]))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            keys = [(rows.column("conv")[i].as_py(), rows.column("block")[i].as_py()) for i in (0, rows.num_rows - 1)] if rows.num_rows else []
            if not keys:
                continue
            tail = rows.num_rows
            end = keys[1]
            convs, blocks = rows.column("conv").to_pylist(), rows.column("block").to_pylist()
            while tail and (convs[tail - 1], blocks[tail - 1]) == end:
                tail -= 1
            yield from flush(rows.slice(0, tail))
            held = rows.slice(tail)
            if held.nbytes > 2 * FRAGMENT_BYTES:
                yield from flush(held)
                held = None
        if held is not None:
            yield from flush(held)

    return dealt.mapInArrow(run, "conv long, block long, fragment long, n_turns long, formatted string, loss_starts array<bigint>, loss_ends array<bigint>").withColumnRenamed("conv", conv)


def read_back(fragment: str, template: ChatTemplate | None = None) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted fragment; an error if it holds anything else."""
    template = template or ChatTemplate()
    turns, at = [], 0
    for m in template.turn_pattern().finditer(fragment):
        if m.start() != at:
            raise ValueError(f"text outside a turn at {at}")
        turns.append((template.unescape(m[1]), template.unescape(m[2])))
        at = m.end()
    if at != len(fragment):
        raise ValueError(f"text outside a turn at {at}")
    return turns
