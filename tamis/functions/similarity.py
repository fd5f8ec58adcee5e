"""Similarity of texts: set measures as expressions, the sequence ratio as a vectorised UDF where they leave it open."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tamis.functions.text import words


@lru_cache(maxsize=100_000)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts, in the order given: it isn't symmetric. Null with null. Each worker keeps the ratios of
    the pairs it saw last."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def containment(a: Column, b: Column) -> Column:
    """Words in common as a share of the smaller set."""
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def _numbers(c: Column) -> Column:
    """The different words of figures only."""
    return F.array_sort(F.filter(words(c), lambda w: F.regexp_like(w, F.lit(r"^\d+$"))))


def add_text_similarity(df: DataFrame, a: str, b: str, out: str = "similarity", numbers: bool | Column = False) -> DataFrame:
    """df with the similarity of two normalised texts: the greatest of containment, Jaccard and the ratio of their sorted words.

    Blank or null texts give 0. With `numbers`, or where that condition holds, texts whose numbers differ give 0 if both have some. Only pairs that the
    set measures leave below 1 are rated by the UDF, in place: no shuffle.
    """
    x, y = F.col(a), F.col(b)
    asked = numbers if isinstance(numbers, Column) else F.lit(numbers)
    differ = F.lit(False) if numbers is False else F.coalesce(asked & (F.size(_numbers(x)) > 0) & (F.size(_numbers(y)) > 0) & (_numbers(x) != _numbers(y)), F.lit(False))
    native = F.coalesce(F.when(differ, 0.0).otherwise(F.greatest(containment(x, y), jaccard(x, y))), F.lit(0.0))
    ask = F.coalesce((native < 1) & ~differ & (F.trim(x) != "") & (F.trim(y) != ""), F.lit(False))
    ordered = lambda c: F.array_join(F.array_sort(words(c)), " ")
    # the ratio is asked where the rows are; a pair that needs none is null to it
    ratio = seq_ratio(F.when(ask, ordered(x)), F.when(ask, ordered(y)))
    return df.withColumn("_native", native).withColumn("_ratio", ratio).withColumn(out, F.round(F.greatest("_native", F.coalesce("_ratio", F.lit(0.0))), 6)).drop("_native", "_ratio")


def add_employer_similarity(df: DataFrame, label: str, employer: str, out: str = "similarity") -> DataFrame:
    """df with the likeness of a transaction label to an employer: 1 where it holds the name without spaces, else the share of the
    employer's words that it has, or the ratio of both texts."""
    compact = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    held = F.contains(compact(label), compact(employer)) & (compact(employer) != "")
    recall = F.when(F.size(words(F.col(employer))) > 0, F.size(F.array_intersect(words(F.col(label)), words(F.col(employer)))) / F.size(words(F.col(employer)))).otherwise(0.0)
    rated = df.withColumn("_native", F.coalesce(F.when(held, 1.0).otherwise(recall), F.lit(0.0)))
    ratio = seq_ratio(F.when(F.col("_native") < 1, F.col(label)), F.when(F.col("_native") < 1, F.col(employer)))
    return rated.withColumn("_ratio", ratio).withColumn(out, F.round(F.greatest("_native", F.coalesce("_ratio", F.lit(0.0))), 6)).drop("_native", "_ratio")
