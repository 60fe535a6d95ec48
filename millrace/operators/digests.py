"""Digests over all values of a group in order, without the group in memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_digest(df: DataFrame, group: str, value: str, separator: str = ",", out: str = "digest") -> DataFrame:
    """(group, n, out): the SHA-256 of a group's values in ascending byte order, joined by the separator; nulls are left out.

    A digest takes its bytes one after another, so a group is one task's work; but its values
    stream through, sorted and spilled by the shuffle, and only the digest's state is held.
    """
    rows = df.select(group, F.col(value).cast("string").alias("_v")).where(F.col("_v").isNotNull())
    dealt = rows.repartition(group).sortWithinPartitions(group, "_v")
    kind = rows.schema[group].dataType.simpleString()
    gap = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state = None, 0, hashlib.sha256()

        def done(name: pa.Scalar) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name.as_py()], name.type), pa.array([n]), pa.array([state.hexdigest()])], names=[group, "n", out])

        for batch in batches:
            runs, values, at = pc.run_end_encode(batch.column(0)), batch.column(1).to_pylist(), 0
            for to, name in zip(runs.run_ends.to_pylist(), runs.values, strict=True):
                if now is None or not name.equals(now):
                    if now is not None:
                        yield done(now)
                    now, n, state = name, 0, hashlib.sha256()
                own = [v.encode("utf-8", "surrogatepass") for v in values[at:to]]
                state.update((gap if n else b"") + gap.join(own))
                n, at = n + len(own), to
        if now is not None:
            yield done(now)

    return dealt.mapInArrow(run, f"`{group}` {kind}, n long, `{out}` string")
