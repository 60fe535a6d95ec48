"""Rows of no fixed shape: the sink of overflow pairs, whose schema is united over all rows, and records checked as they are read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def united_schema(df: DataFrame, json: str) -> T.StructType:
    """The schema that all JSON objects of a column fit: fields of any row, each of the narrowest common type.

    Types are united pairwise on the map side, so one small value a partition is shuffled.
    Where two rows differ in kind (a number here, an object there) the field is a variant, which
    holds either. Rows that are no objects are an error.
    """
    variant = F.try_parse_json(F.col(json))
    odd = F.col(json).isNotNull() & ~F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    found = df.agg(F.schema_of_variant_agg(variant).alias("schema"), F.count_if(odd).alias("odd"), F.count_if(F.col(json).isNotNull()).alias("n")).first()
    if found["odd"]:
        raise ValueError(f"{found['odd']} rows hold no JSON object")
    return schema_of(found["schema"]) if found["n"] else T.StructType()


def schema_of(text: str) -> T.StructType:
    """A variant's schema as Spark states it, as a struct: objects become structs, fields that are null everywhere strings."""
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", text)
    ddl = re.sub(r"\bVOID\b", "STRING", ddl)
    kind = T._parse_datatype_string(ddl.replace("STRUCT<>", "VARIANT")) if ddl not in ("OBJECT", "STRUCT<>") else T.StructType()
    return kind if isinstance(kind, T.StructType) else T.StructType()


def write_loose(df: DataFrame, json: str, path: str) -> T.StructType:
    """Write the JSON objects of a column as typed Parquet columns; returns the schema. Null rows are rows of nulls; nothing is overwritten."""
    schema = united_schema(df, json)
    if not schema.fields:
        # Parquet has no rows without columns
        schema = T.StructType([T.StructField("_empty", T.StringType())])
    value = F.from_json(F.col(json), schema)
    df.select(*[value.getField(f.name).alias(f.name) for f in schema.fields]).write.parquet(path)
    return schema


def as_objects(df: DataFrame) -> Column:
    """Each row as canonical JSON without its absent fields, to compare what came back."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))


def load_records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of JSON files, one record a file or, with ``lines``, a line.

    rejected: (file, text) of what is no JSON or has a field of another type, whole and not cut
    down to the fields that fit. Absent fields are null, fields that the schema does not name
    are left out, blank files and lines are none.
    """
    kept = T._parse_datatype_string(schema)
    whole = T.StructType([*kept.fields, T.StructField("_rejected", T.StringType())])
    texts = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file")).where(F.trim("text") != "")
    parsed = F.from_json("text", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected"})
    rows = texts.select("file", "text", parsed.alias("_r"))
    fits = F.col("_r").isNotNull() & F.col("_r._rejected").isNull()
    return rows.where(fits).select(*[F.col("_r").getField(f.name).alias(f.name) for f in kept.fields]), rows.where(~fits).select("file", "text")
