"""File sources: JSON objects with a fixed schema, folders in name order, new files only, parameters."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page of recognised blocks, as one JSON object a file; and a list of classified documents.
PAGE = (
    "dossier_id STRING, file STRING, original_path STRING, image_width INT, image_height INT, ocr_engine STRING, full_text STRING, error STRING, "
    "blocks ARRAY<STRUCT<text: STRING, x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE, score: DOUBLE>>"
)
MANIFEST = "dossier_id STRING, documents ARRAY<STRUCT<doc_id: STRING, file: STRING, doc_type: STRING, template_id: STRING, status: STRING>>"


def json_objects(spark: SparkSession, path: str, schema: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the JSON objects of a folder, one a file, with source_file; and files that aren't an object of this schema."""
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    df = df.select(F.col("_metadata.file_path").alias("source_file"), "value", parsed.alias("o"))
    fine = df["value"].rlike(r"^\s*\{") & F.col("o").isNotNull() & F.col("o._bad").isNull()
    good = df.filter(fine).select("o.*", "source_file").drop("_bad")
    bad = df.filter(~F.coalesce(fine, F.lit(False))).select("source_file", F.col("value").alias("content"))
    return good, bad


def with_ordinal(df: DataFrame, key: str, file: str = "source_file", out: str = "doc_ordinal") -> DataFrame:
    """df with the place, from 1, of each file among those of its key, by name."""
    from pyspark.sql import Window

    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(file)))


def key_of_path(df: DataFrame, file: str = "source_file", out: str = "dossier_id") -> DataFrame:
    """df with an id from the file's name (D and digits), else from the folder above it."""
    name = F.nullif(F.regexp_extract(file, r"(D\d+)[^/]*$", 1), F.lit(""))
    return df.withColumn(out, F.coalesce(name, F.nullif(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1), F.lit(""))))


def images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,tif,tiff,bmp}") -> DataFrame:
    """(source_file, length, modified): image files; their bytes aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select(F.col("path").alias("source_file"), "length", F.col("modificationTime").alias("modified"))


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of todo whose key isn't among the results yet; null keys are to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def manifest_documents(manifest: DataFrame, template: str | None = None) -> DataFrame:
    """(dossier_id, doc_id, ...): the documents of a manifest, of one template if given; a null doc_id is made of the file's name."""
    rows = manifest.select("dossier_id", F.explode("documents").alias("d")).select("dossier_id", "d.*")
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.concat_ws("_", "dossier_id", F.regexp_replace("file", r"\.[^.]*$", ""))))
    return rows if template is None else rows.filter(F.col("template_id") == template)


def original_of(docs: DataFrame, files: DataFrame, path: str = "original_path", name: str = "file") -> DataFrame:
    """docs with found_path: the file of the same path, else of the same name, else of the same stem; the first by path.

    files: (source_file); it is aggregated by name and stem before the joins, so no document is multiplied.
    """
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    stem = lambda c: F.regexp_replace(base(c), r"\.[^.]*$", "")
    by_path = files.select(F.col("source_file").alias("_p")).distinct()
    by_name = files.groupBy(base("source_file").alias("_n")).agg(F.min("source_file").alias("_by_name"))
    by_stem = files.groupBy(stem("source_file").alias("_s")).agg(F.min("source_file").alias("_by_stem"))
    out = docs.join(by_path, F.col(path) == F.col("_p"), "left").join(by_name, base(F.col(name)) == F.col("_n"), "left").join(by_stem, stem(F.col(name)) == F.col("_s"), "left")
    return out.select(*docs.columns, F.coalesce("_p", "_by_name", "_by_stem").alias("found_path"))


def parameters(path: str) -> dict:
    """Weights and thresholds from a small JSON file on the driver."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return found
