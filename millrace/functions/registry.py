"""What SQL text can call once it is registered, and the open lists of labellers and checks.

Table functions take a source (or the two sides of a pair) and are joined laterally. Labellers and
checks are builders of Columns over the features of both sides, so a list of them is one
projection: nothing is parsed again for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import code
from millrace.operators.walk import ChangedNodes

#: (before text, after text, features before, features after) -> confidence from 0 to 1.
Labeller = Callable[[Column, Column, Column, Column], Column]
#: (features before, features after) -> whether the pair is rejected.
Check = Callable[[Column, Column], Column]

LABELLERS: dict[str, Labeller] = {}
CHECKS: dict[str, Check] = {}


def labeller(name: str) -> Callable[[Labeller], Labeller]:
    """Add a labeller after those there are; on ties the earlier one wins."""

    def add(builder: Labeller) -> Labeller:
        if name in LABELLERS or name == "NONE":
            raise ValueError(f"labeller {name} is there already")
        LABELLERS[name] = builder
        return builder

    return add


def check(name: str) -> Callable[[Check], Check]:
    """Add a check after those there are; the first that rejects names the reason."""

    def add(builder: Check) -> Check:
        if name in CHECKS:
            raise ValueError(f"check {name} is there already")
        CHECKS[name] = builder
        return builder

    return add


def _own(name: str) -> Labeller:
    return lambda before, after, b, a: code.confidences(before, after, b, a)[name]


def _first(name: str) -> Check:
    return lambda b, a: F.coalesce(code.safety(b, a) == name, F.lit(False))


for _name in code.INTENTS:
    LABELLERS[_name] = _own(_name)
for _name in code.CHECKS:
    CHECKS[_name] = _first(_name)


def judged(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs with intent, confidence and rejected_by (null if no check rejects), from all registered labellers and checks.

    Sides that do not parse have NONE with 0, and no check rejects them.
    """
    own = code.with_features(pairs, {before: "_b", after: "_a"})
    b, a = F.col("_b"), F.col("_a")
    both = F.coalesce(b["parses"] & a["parses"], F.lit(False))
    scores = {name: F.when(both, F.coalesce(build(F.col(before), F.col(after), b, a), F.lit(0.0))).otherwise(F.lit(0.0)).cast("double") for name, build in LABELLERS.items()}
    scored = own.withColumn("_scores", F.array(*[F.struct(s.alias("confidence"), F.lit(-i).alias("place"), F.lit(n).alias("intent")) for i, (n, s) in enumerate(scores.items())]))
    best = F.array_max("_scores")
    rejected = F.coalesce(*[F.when(both & F.coalesce(build(b, a), F.lit(False)), F.lit(name)) for name, build in CHECKS.items()])
    return scored.select(
        *pairs.columns,
        F.when(best["confidence"] > 0, best["intent"]).otherwise(F.lit("NONE")).alias("intent"),
        F.greatest(best["confidence"], F.lit(0.0)).alias("confidence"),
        rejected.alias("rejected_by"),
    )


class Chunks:
    """A table function: the chunks of a source; none where it does not parse."""

    def eval(self, source: str | None) -> Iterator[tuple[str, str, int, int, str]]:
        for c in code.chunks(source):
            yield c["qualname"], c["kind"], c["start_line"], c["end_line"], c["source"]


def macro_f1(labels: pd.Series, predicted: pd.Series, counts: pd.Series) -> float:
    """Macro-F1 of a table of counts (label, predicted, n): as many rows as pairs of classes, whatever the data."""
    table = pd.DataFrame({"t": labels, "p": predicted, "n": counts})
    true, guessed = table.groupby("t")["n"].sum(), table.groupby("p")["n"].sum()
    right = table[table["t"] == table["p"]].groupby("t")["n"].sum()
    classes = sorted(set(true.index) | set(guessed.index))
    if not classes:
        return 0.0
    return float(sum(2.0 * right.get(c, 0) / (true.get(c, 0) + guessed.get(c, 0)) for c in classes) / len(classes))


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL text of this session; returns their names. Registering again changes nothing."""
    spark.udtf.register("source_chunks", F.udtf(Chunks, returnType="qualname string, kind string, start_line int, end_line int, source string", useArrow=True))
    spark.udtf.register("changed_nodes", F.udtf(ChangedNodes, returnType="node_qualname string, source_before string, source_after string", useArrow=True))
    spark.udf.register("macro_f1", F.pandas_udf(macro_f1, "double", F.PandasUDFType.GROUPED_AGG))
    return ["source_chunks", "changed_nodes", "macro_f1"]
