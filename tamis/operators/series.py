"""Ordered data: neighbours, runs of periods, clusters by gaps, the largest gap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjacent_breaks(df: DataFrame, key: str, order: list[str], opening: str, closing: str, tolerance: float = 1.0) -> DataFrame:
    """(key, pairs, breaks, score): does each row open with what the row before closed with?

    Rows without an opening or a closing are skipped; a key with fewer than two rows left has a null score, else 1 with a break
    beyond the tolerance and 0 without. Ties in order keep the order of the further columns.
    """
    good = df.withColumn("_good", F.col(opening).isNotNull() & F.col(closing).isNotNull())
    w = Window.partitionBy(key).orderBy(*order)
    pairs = good.filter("_good").withColumn("_before", F.lag(closing).over(w))
    found = pairs.groupBy(key).agg(F.count("_before").alias("pairs"), F.count_if(F.abs(F.col("_before") - F.col(opening)) > tolerance).alias("breaks"))
    spine = df.select(key).distinct()
    score = F.when(F.col("pairs") > 0, F.when(F.col("breaks") > 0, 1.0).otherwise(0.0))
    return spine.join(found, key, "left").select(key, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("breaks", F.lit(0)).alias("breaks"), score.alias("score"))


def consecutive(df: DataFrame, key: str, period: str, count: int = 3) -> DataFrame:
    """(key, rows, periods, status): CONSECUTIVE if exactly `count` rows have `count` different consecutive periods, UNAVAILABLE if
    there are more or fewer rows or one has no period, else BROKEN. period is an integer that grows by one."""
    agg = df.groupBy(key).agg(F.count("*").alias("rows"), F.countDistinct(period).alias("periods"), F.count_if(F.col(period).isNull()).alias("_unknown"), (F.max(period) - F.min(period)).alias("_span"))
    status = F.when((F.col("rows") != count) | (F.col("_unknown") > 0), "UNAVAILABLE").when((F.col("periods") == count) & (F.col("_span") == count - 1), "CONSECUTIVE").otherwise("BROKEN")
    return agg.select(key, "rows", "periods", status.alias("status"))


def same_sets(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, equal): do both tables have the same set of values for a key? Keys of either side; a side without values has the empty set.

    Counted, not collected: a key may hold any number of values.
    """
    mark = lambda df, n: df.filter(F.col(value).isNotNull()).select(key, value, F.lit(n).alias("_side"))
    sides = mark(left, 1).unionByName(mark(right, 2)).groupBy(key, value).agg(F.countDistinct("_side").alias("n"))
    keys = left.select(key).unionByName(right.select(key)).distinct()
    return keys.join(sides.groupBy(key).agg((F.min("n") == 2).alias("equal")), key, "left").select(key, F.coalesce("equal", F.lit(True)).alias("equal"))


def gap_clusters(df: DataFrame, key: str, order: list[str], at: str, gap: float) -> DataFrame:
    """df with `cluster`, from 0: a new one begins where the value lies more than `gap` after the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    starts = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    return df.withColumn("_start", F.coalesce(starts, F.lit(0))).withColumn("cluster", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def _mean_clusters(gap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cluster, total, n = object(), 0, 0.0, 0
        for batch in batches:
            out = []
            for k, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    key, cluster, total, n = k, 0, 0.0, 0
                elif n and abs(y - total / n) > gap:
                    cluster, total, n = cluster + 1, 0.0, 0
                total, n = total + y, n + 1
                out.append(cluster)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "cluster"])

    return run


def mean_clusters(df: DataFrame, key: str, at: str, row_id: str, gap: float = 10.0) -> DataFrame:
    """(key, at, row_id, cluster): a new cluster begins where the value is more than `gap` from the mean of the current one.

    The mean depends on where the cluster began, so no window frame can give it: rows stream in order, one key after the other,
    and only a sum is held. Rows without a value are left out.
    """
    rows = df.filter(F.col(at).isNotNull()).select(key, F.col(at).cast("double").alias(at), row_id)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + ", cluster INT"
    return rows.repartition(key).sortWithinPartitions(key, at, row_id).mapInArrow(_mean_clusters(gap), schema)


def largest_gap(df: DataFrame, key: str, at: str, least: float = 5.0) -> DataFrame:
    """(key, gap, threshold, below, above): the widest gap between neighbouring values of a key and its middle, the first of equal
    ones; and how many values lie on each side. Keys without two values or a gap of `least` give no row."""
    rows = df.filter(F.col(at).isNotNull()).select(key, F.col(at).cast("double").alias("_x"))
    w = Window.partitionBy(key).orderBy("_x")
    pairs = rows.withColumn("_next", F.lead("_x").over(w)).withColumn("_gap", F.col("_next") - F.col("_x"))
    best = pairs.filter(F.col("_gap") >= least).groupBy(key).agg(F.max_by(F.struct("_gap", "_x", "_next"), F.struct("_gap", -F.col("_x"))).alias("b"))
    best = best.select(key, F.col("b._gap").alias("gap"), ((F.col("b._x") + F.col("b._next")) / 2).alias("threshold"))
    sides = rows.join(best, key).groupBy(key).agg(F.first("gap").alias("gap"), F.first("threshold").alias("threshold"), F.count_if(F.col("_x") <= F.col("threshold")).alias("below"), F.count_if(F.col("_x") > F.col("threshold")).alias("above"))
    return sides
