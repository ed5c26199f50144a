"""Recorded inputs as strict JSON documents, one per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.receipts import canonical_json


def read_documents(spark: SparkSession, path: str, schema: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, text, value) of JSON files that fit the schema; text is canonical. Larger or malformed files are an error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    checked = raw.withColumn("value", F.when(F.octet_length("value") <= most_bytes, F.col("value")).otherwise(F.raise_error(F.lit("document is too large")).cast("string")))
    return checked.select("path", canonical_json("value").alias("text"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("value"))


def closed_shape(column: str, keys: list[str]):
    """Whether a JSON object has exactly these keys, each once."""
    found = F.json_object_keys(column)
    return found.isNotNull() & (F.array_sort(found) == F.array(*map(F.lit, sorted(keys))))
