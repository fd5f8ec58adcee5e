"""Controlled mutations of field rows, for tests of the operators that should notice them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import durable


def mutate_first(fields: DataFrame, key: str, name: str, value: str, order: str, names: tuple[str, ...], change: Column, mark: str = "mutated") -> DataFrame:
    """fields with the value of the first row of each key whose name is listed set to `change`; mark tells which row changed.

    A key without such a row stays as it is. Ties in order are taken by the smallest value.
    """
    fits = F.col(name).isin(*names)
    w = Window.partitionBy(key, fits).orderBy(order, value)
    return fields.withColumn(mark, F.coalesce(fits, F.lit(False)) & (F.row_number().over(w) == 1)).withColumn(value, F.when(F.col(mark), change).otherwise(F.col(value)))


def borrow_from_donor(fields: DataFrame, pairs: DataFrame, key: str, name: str, value: str, names: tuple[str, ...]) -> DataFrame:
    """fields with the listed values of a target key replaced by its donor's greatest value of that name; pairs: (target, donor), unique targets."""
    given = fields.filter(F.col(name).isin(*names)).groupBy(F.col(key).alias("donor"), F.col(name).alias("_name")).agg(F.max(value).alias("_given"))
    wanted = pairs.join(given, "donor").select(F.col("target").alias("_target"), "_name", "_given")
    joined = fields.join(wanted, (F.col(key) == F.col("_target")) & (F.col(name) == F.col("_name")), "left")
    return joined.withColumn(value, F.coalesce("_given", value)).select(*fields.columns)


def mutate_each(fields: DataFrame, key: str, name: str, value: str, order: str, changes: dict[str, Column], mark: str = "mutated") -> DataFrame:
    """fields with the first value of each listed name in each key set to its change; mark tells which rows changed."""
    w = Window.partitionBy(key, name).orderBy(order, value)
    first = F.col(name).isin(*changes) & (F.row_number().over(w) == 1)
    changed = F.coalesce(*(F.when(F.col(name) == n, c) for n, c in changes.items()))
    return fields.withColumn(mark, F.coalesce(first, F.lit(False))).withColumn(value, F.when(F.col(mark), changed).otherwise(F.col(value)))


def predecessors(ids: DataFrame, column: str) -> DataFrame:
    """(target, donor): every different non-null id with the id before it in order; the first has none and gives no row.

    The ids are sorted in ranges, one task each, and written; the last id of each range is carried to the next through a table with a
    row for each range, so no task sees all ids.
    """
    sorted_ids = ids.select(F.col(column).alias("target")).filter("target IS NOT NULL").distinct().repartitionByRange("target")
    ranged = durable(sorted_ids.withColumn("_range", F.spark_partition_id()))
    ends = ranged.groupBy("_range").agg(F.max("target").alias("_end"))
    carried = ends.select((F.lag("_end").over(Window.orderBy("_range"))).alias("_before"), "_range")  # a row for each range
    inside = F.lag("target").over(Window.partitionBy("_range").orderBy("target"))
    out = ranged.withColumn("_inside", inside).join(F.broadcast(carried), "_range")
    return out.select("target", F.coalesce("_inside", "_before").alias("donor")).filter("donor IS NOT NULL")
