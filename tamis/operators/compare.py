"""Comparisons inside a file: matched amounts, declared against summed totals, values against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.scores import AMOUNT_LADDER, at_least, at_most, relative_difference
from tamis.functions.similarity import add_text_similarity


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], value_left: str, value_right: str) -> DataFrame:
    """(keys, value_left, value_right, reason): both sides joined where each has exactly one row for the key.

    Pre-aggregated on both sides before the join, so repeated keys never multiply. reason is OK, or which side has none or
    several rows, or a null value; then the values are null. Keys of either side; null keys match nothing.
    """
    a = left.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(value_left).alias("_a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("_m"), F.max(value_right).alias("_b"))
    n, m = F.coalesce("_n", F.lit(0)), F.coalesce("_m", F.lit(0))
    reason = F.when(n == 0, "LEFT_MISSING").when(n > 1, "LEFT_SEVERAL").when(m == 0, "RIGHT_MISSING").when(m > 1, "RIGHT_SEVERAL").when(F.col("_a").isNull(), "LEFT_VALUE").when(F.col("_b").isNull(), "RIGHT_VALUE").otherwise("OK")
    return a.join(b, keys, "full").withColumn("reason", reason).select(*keys, F.when(F.col("reason") == "OK", F.col("_a")).alias(value_left), F.when(F.col("reason") == "OK", F.col("_b")).alias(value_right), "reason")


def amount_scores(matched: DataFrame, value: str, reference: str, ladder=AMOUNT_LADDER) -> DataFrame:
    """matched with score: the ladder of the relative difference; null where a side is."""
    return matched.withColumn("score", at_most(relative_difference(F.col(value), F.col(reference)), ladder))


def signed_totals(rows: DataFrame, key: str, amount: str, sign: str) -> DataFrame:
    """(key, debits, credits, unusable): sums of absolute amounts by direction; rows without a direction or an amount are unusable."""
    ok = F.col(sign).isin("C", "D") & F.col(amount).isNotNull()
    total = lambda s: F.coalesce(F.round(F.sum(F.when(ok & (F.col(sign) == s), F.abs(amount))), 2), F.lit(0.0))
    return rows.groupBy(key).agg(total("D").alias("debits"), total("C").alias("credits"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("unusable"))


def declared_against(declared: DataFrame, sums: DataFrame, key: str, pairs: dict[str, str], tolerance: float = 1.0) -> DataFrame:
    """(key, status): UNAVAILABLE if a declared value is null or a summed row unusable, TRIGGERED if one differs by more than the
    tolerance, else NORMAL. Keys without rows to sum have sums of 0."""
    joined = declared.join(sums, key, "left")
    off = [F.abs(F.col(d) - F.coalesce(F.col(s), F.lit(0.0))) > tolerance for d, s in pairs.items()]
    missing = [F.col(d).isNull() for d in pairs]
    status = F.when(_any(missing) | (F.coalesce("unusable", F.lit(0)) > 0), "UNAVAILABLE").when(_any(off), "TRIGGERED").otherwise("NORMAL")
    return joined.select(key, status.alias("status"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def roll_up(checks: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, status, score): a key is UNAVAILABLE as soon as one of its rows is, else TRIGGERED as soon as one is, else NORMAL."""
    agg = checks.groupBy(key).agg(F.bool_or(F.col(status) == "UNAVAILABLE").alias("_u"), F.bool_or(F.col(status) == "TRIGGERED").alias("_t"))
    s = F.when(F.col("_u"), "UNAVAILABLE").when(F.col("_t"), "TRIGGERED").otherwise("NORMAL")
    return agg.select(key, s.alias("status"), F.when(~F.col("_u"), F.when(F.col("_t"), 1.0).otherwise(0.0)).alias("score"))


def signal(checks: DataFrame, key: str, check: str, score: str) -> DataFrame:
    """(key, score, n_checks, n_available, triggered): the greatest available score of a key, null if none is available."""
    names = F.array_sort(F.collect_set(F.when(F.col(score) > 0, F.col(check))))  # bounded by the number of checks
    return checks.groupBy(key).agg(F.round(F.max(score), 4).alias("score"), F.count("*").alias("n_checks"), F.count(score).alias("n_available"), F.array_join(names, "|").alias("triggered"))


def majority_reference(rows: DataFrame, keys: list[str], value: str, priority: Column, document: str) -> DataFrame:
    """(keys, value, votes): the value that most rows have; ties by the best priority, then the first document, then the value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(F.struct(priority.alias("p"), F.col(document).alias("d"))).alias("_best"))
    tied = Window.partitionBy(*keys).orderBy(F.desc("votes"), F.col("_best.p"), F.col("_best.d"), F.col(value))
    return counts.withColumn("_r", F.row_number().over(tied)).filter("_r = 1").select(*keys, value, "votes")


def exact_consistency(rows: DataFrame, keys: list[str], value: str, priority: Column, document: str) -> DataFrame:
    """(keys, reference, compared, different, score): every value against the majority's, for keys with values in two documents.

    The score is 1 with a difference and 0 without, null where fewer than two documents have a value.
    """
    some = rows.filter(F.col(value).isNotNull())
    ref = majority_reference(rows, keys, value, priority, document).withColumnRenamed(value, "reference")
    agg = some.join(ref, keys).groupBy(*keys).agg(F.first("reference").alias("reference"), F.countDistinct(document).alias("compared"), F.count_if(F.col(value) != F.col("reference")).alias("different"))
    return agg.select(*keys, "reference", "compared", "different", F.when(F.col("compared") > 1, F.when(F.col("different") > 0, 1.0).otherwise(0.0)).alias("score"))


def medoids(units: DataFrame, keys: list[str], similarity, block: int = 500) -> DataFrame:
    """(keys, a, doc, worst, docs): of the values with the best p, the one most alike those of all other documents, and the greatest score
    against them; ties by the first document, then the value.

    units: (keys, doc, value, p, n), each (doc, value) once with its number of rows. similarity(df) adds s, the likeness of a to b, and w,
    the score of b against a. A value isn't held against its own document; where there is no other the mean is 1. Both sides of a key
    lie in blocks of about `block` values, and each pair of blocks is a key of the join of its own: a key with many values
    spreads over many tasks.
    """
    size = units.groupBy(*keys).agg(F.min("p").alias("_best"), F.countDistinct("doc").alias("docs"), F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    placed = units.join(size, keys).withColumn("_at", F.pmod(F.xxhash64("doc", "value"), "_parts").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    a = placed.filter(F.col("p") == F.col("_best")).select(*keys, F.col("value").alias("a"), F.col("doc").alias("doc_a"), "docs", F.col("_at").alias("_i"), others.alias("_j"))
    b = placed.select(*keys, F.col("value").alias("b"), F.col("doc").alias("doc_b"), "n", F.col("_at").alias("_j"), others.alias("_i"))
    pairs = similarity(a.join(b, [*keys, "_i", "_j"])).withColumn("_other", F.col("doc_a") != F.col("doc_b"))
    of = lambda c: F.when(F.col("_other"), c)
    rated = pairs.groupBy(*keys, "a", "doc_a").agg(
        F.max("docs").alias("docs"),
        F.round(F.coalesce(F.sum(of(F.col("s") * F.col("n"))) / F.sum(of(F.col("n"))), F.lit(1.0)), 9).alias("mean"),
        F.max(of(F.col("w"))).alias("worst"),
        F.min(of(F.col("s"))).alias("least"),
    )
    best = rated.groupBy(*keys).agg(F.min_by(F.struct("a", F.col("doc_a").alias("doc"), "worst", "least", "docs"), F.struct(-F.col("mean"), "doc_a", "a")).alias("_r"))
    return best.select(*keys, "_r.*")


def medoid_reference(rows: DataFrame, keys: list[str], value: str, priority: Column, document: str, block: int = 500) -> DataFrame:
    """(keys, reference, score): among the values of the best priority, the one most alike those of all other documents, and the ladder
    score of the value least alike it; ties by the first document, then the value. Null and blank values and null documents don't
    take part; keys with one document have a null score. See medoids() for the work it does."""
    some = rows.filter((F.trim(F.col(value)) != "") & F.col(document).isNotNull())
    units = some.groupBy(*keys, F.col(document).alias("doc"), F.col(value).alias("value")).agg(F.min(priority).alias("p"), F.count("*").alias("n"))
    rate = lambda pairs: add_text_similarity(pairs, "a", "b", "s").withColumn("w", at_least(F.col("s")))
    found = medoids(units, keys, rate, block)
    return found.select(*keys, F.col("a").alias("reference"), F.when(F.col("docs") > 1, at_least(F.col("least"))).alias("score"))
