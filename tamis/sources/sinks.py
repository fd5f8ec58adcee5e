"""Sinks: idempotent folders by partition, JSON, CSV with fixed columns, edges of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: str, kind: str = "parquet") -> None:
    """Only the partitions that df has are replaced, so writing the same rows again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).format(kind).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], separator: str = "|") -> None:
    """The listed columns in this order, under a header; arrays as their elements with a separator; absent columns empty."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.lit(None).cast("string") if c not in kinds else F.array_join(F.transform(c, lambda x: x.cast("string")), separator) if kinds[c].startswith("array") else F.col(c).cast("string")
    df.select(*(cell(c).alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def bucket_of(key: str, buckets: int = 256):
    """A partition column of bounded size for a key with many values."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def result_edges(results: DataFrame, key: str, check: str, evidence: str, role: str) -> DataFrame:
    """(signal_id, key, evidence, role): one row for each element of a result's evidence list."""
    rows = results.select(F.concat_ws("_", key, check).alias("signal_id"), key, F.explode(F.array_distinct(evidence)).alias("evidence"))
    return rows.select("signal_id", key, "evidence", F.lit(role).alias("role"))
