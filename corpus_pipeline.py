"""A corpus pipeline in five stages, from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all of docs, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns
of documents; other columns are left out. Rows are told apart by a hash of key and text, so null and repeated keys and
repeated rows are handled; wholly equal rows share one decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, lines, mixing, ngrams, packing
from millrace.session import forget, settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicate settings of the line and the document stage: words of a shingle, similarity in percent.
WORDS, PERCENT = 5, 80
#: A text whose best language is no more likely than this multiple of an even guess is rejected.
OVER_CHANCE = 1.2


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text", "source").alias("rid"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected are texts without a letter, null texts, and those for which no language is likelier than by chance."""
    model = language.train(docs, ~language.held_out())
    scored = language.identify(docs.select(*COLUMNS), model)
    least = min(1.0, OVER_CHANCE / max(1, len(model.languages))) if len(model.languages) > 1 else 0.0
    return scored.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go from the texts; a document goes when it had words and none are left."""
    kept = lines.dedup_lines(docs.select(*COLUMNS), k=WORDS, percent=PERCENT)
    has_words = F.col("text").rlike(mixing.WORD)
    kept = kept.where(F.col("text").isNull() | (F.col("n_removed") == 0) | has_words)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest key stays; of equal rows one."""
    rows = _marked(docs)
    groups = ngrams.near_duplicates(rows, "rid", "text", WORDS, PERCENT).select(F.col("rid").alias("of"), "component_id").distinct()
    first = rows.select("rid", "doc_id").join(groups, F.col("rid") == F.col("of")).groupBy("component_id").agg(F.min(F.struct("doc_id", "rid")).alias("first"))
    return rows.join(first.select(F.col("first.rid").alias("rid")), "rid", "left_semi").dropDuplicates(["rid"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    rows = _marked(docs)
    taken = mixing.mix(rows, "rid").where("taken > 0").groupBy(F.col("rid").alias("of")).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("copies"))
    return rows.join(taken, F.col("rid") == F.col("of")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 1024 tokens; the columns are those of ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the hash-ordered sample and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's input goes once its successor is written; that of the last stays, as its plan reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
