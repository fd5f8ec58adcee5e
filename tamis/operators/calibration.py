"""Measures of a score against labels, and thresholds chosen from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 (rounded to 4; null where undefined). Rows with a null are left out."""
    rows = df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull())
    y, p = F.col(label) == 1, F.col(predicted) == 1
    agg = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def threshold_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tp, fp, positives, negatives): of every different score, what lies at or above it.

    Labels are pre-aggregated by score. The running sums use ranges of scores: each range's total is added to the sums inside
    it, so no task holds all scores.
    """
    from pyspark.sql import Window

    counts = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    ranged = counts.repartitionByRange(F.desc("threshold")).withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    offsets = totals.select("_part", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_op"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"))
    everything = totals.agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    inside = Window.partitionBy("_part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.withColumn("tp", F.sum("p").over(inside)).withColumn("fp", F.sum("n").over(inside))
    out = sums.join(F.broadcast(offsets), "_part").join(F.broadcast(everything))
    return out.select("threshold", (F.col("tp") + F.col("_op")).alias("tp"), (F.col("fp") + F.col("_on")).alias("fp"), "positives", "negatives")


def youden(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (threshold, j): the score with the greatest true positive rate minus false positive rate, the highest of equal ones."""
    j = F.round(F.col("tp") / F.col("positives") - F.col("fp") / F.col("negatives"), 6)
    return threshold_table(df, label, score).filter("positives > 0 AND negatives > 0").agg(F.max_by(F.struct("threshold", j.alias("j")), F.struct(j, "threshold")).alias("b")).select("b.*")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (auc): the share of positive and negative pairs in the right order, ties as half; from counts by score, not from pairs."""
    t = threshold_table(df, label, score).withColumn("_area", F.lit(0.0))
    counts = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    both = t.join(counts, "threshold")
    # each negative at a score is beaten by the positives above it, and ties with those at it
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + 0.5 * F.col("n") * F.col("p"))
    return both.agg(F.round(area / (F.max("positives") * F.max("negatives")), 6).alias("auc"))


def percentile_of(df: DataFrame, score: str, q: float) -> DataFrame:
    """One row (value): the exact interpolated percentile, from counts by different value."""
    return df.agg(F.round(F.percentile(score, q), 6).alias("value"))
